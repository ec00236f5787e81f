"""Registered clustering queries (C0-C5, E8-E11) over the ``vectors`` binding."""

from __future__ import annotations

from pyspark.sql import functions as F

from clarion.operators import cluster as cl
from clarion.operators import embedding as em
from clarion.operators import evaluate as ev
from clarion.operators import neighbors as nb
from clarion.plans.common import Registry, finish
from clarion.plans.sql import VECTORS_CTE, r6, with_ctes
from clarion.sources import bindings as b

REG = Registry()
KNN_K = 5
# The embeddings are unit vectors (pairwise distances about 1.0 to 1.4), so the
# reference's eps of 1.5 would put every point in one cluster; this binding
# uses a radius that leaves sparse neighbourhoods.  min_samples is unchanged.
DBSCAN_EPS = 1.2
DBSCAN_MIN = cl.DBSCAN_MIN_SAMPLES
N_CLUSTERS = 10   # the embeddings carry 10 labels


def _dist_sql(a: str, c: str) -> str:
    return (f"sqrt(list_reduce(list_transform(range(1, len({a}) + 1), "
            f"lambda i: ({a}[i] - {c}[i]) * ({a}[i] - {c}[i])), lambda x, y: x + y))")


AXIS_SQL = ("axis AS (SELECT vec_id AS id, v, true_label, CASE WHEN list_max(v) < 0 THEN -1 "
            "ELSE list_position(v, list_max(v)) - 1 END AS cluster FROM vectors)")


def axis_clusters(spark, d):
    vec = b.vectors(spark, d)
    return cl.nearest_axis_clusters(vec, "vec_id", "v").join(
        vec.select(F.col("vec_id").alias("id"), "v", "true_label"), "id")


def _ari_nmi_sql(src: str, truth: str, pred: str) -> list[str]:
    return [
        f"ct AS (SELECT {truth} AS t, {pred} AS p, count(*) AS nij FROM {src} GROUP BY ALL)",
        "ra AS (SELECT t, sum(nij) AS ai FROM ct GROUP BY t)",
        "cb AS (SELECT p, sum(nij) AS bj FROM ct GROUP BY p)",
        "nt AS (SELECT sum(ai) AS n, count(*) AS n_true, sum(CAST(ai AS DOUBLE) * ai) AS sa2, "
        "sum(-(ai * ln(ai))) AS ha_raw FROM ra)",
        "nc AS (SELECT count(*) AS n_pred, sum(CAST(bj AS DOUBLE) * bj) AS sb2, sum(-(bj * ln(bj))) AS hb_raw FROM cb)",
        """cs AS (SELECT sum(CAST(nij AS DOUBLE) * nij) AS s2,
              sum((nij / CAST(n AS DOUBLE)) * (ln(nij) - ln(CAST(n AS DOUBLE)))
                  + (nij / CAST(n AS DOUBLE)) * (-ln(CAST(ai AS DOUBLE) * bj) + ln(CAST(n AS DOUBLE)) + ln(CAST(n AS DOUBLE))))
              AS mi_raw
           FROM ct JOIN ra USING (t) JOIN cb USING (p), nt)""",
        """m AS (SELECT CAST(n AS BIGINT) AS n, n_true, n_pred, s2 - n AS tp, sb2 - s2 AS fp, sa2 - s2 AS fn,
              CAST(n AS DOUBLE) * n - (sb2 - s2) - (sa2 - s2) - s2 AS tn,
              CASE WHEN n_true = 1 OR n_pred = 1 THEN 0.0 ELSE greatest(mi_raw, 0.0) END AS mi,
              ha_raw / CAST(n AS DOUBLE) + ln(CAST(n AS DOUBLE)) AS ha, hb_raw / CAST(n AS DOUBLE) + ln(CAST(n AS DOUBLE)) AS hb
           FROM cs, nt, nc)""",
    ]


_ARI_NMI_BODY = f"""
SELECT n, {r6('CASE WHEN fn = 0 AND fp = 0 THEN 1.0 ELSE 2.0 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)) END')} AS ari,
       {r6('CASE WHEN n_true = 1 AND n_pred = 1 THEN 1.0 WHEN mi = 0 THEN 0.0 ELSE mi / ((ha + hb) / 2.0) END')} AS nmi
FROM m"""


@REG.add("ari_nmi", with_ctes(VECTORS_CTE, AXIS_SQL, *_ari_nmi_sql("axis", "true_label", "cluster"),
                              body=_ARI_NMI_BODY))
def ari_nmi(spark, d):
    return finish(ev.ari_nmi(axis_clusters(spark, d), "true_label", "cluster"))


@REG.add("silhouette_sq", with_ctes(VECTORS_CTE, AXIS_SQL, """
valid AS (SELECT id, v, cluster FROM axis WHERE cluster <> -1)""", """
sz AS (SELECT cluster, count(*) AS nk FROM valid GROUP BY cluster)""", f"""
pd AS (SELECT a.id, a.cluster AS ka, q.cluster AS kb,
              sum({_dist_sql('a.v', 'q.v')} * {_dist_sql('a.v', 'q.v')}) AS s
       FROM valid a JOIN valid q ON TRUE GROUP BY ALL)""", """
ab AS (SELECT pd.id,
              max(CASE WHEN pd.ka = pd.kb THEN (CASE WHEN sz.nk = 1 THEN NULL ELSE pd.s / (sz.nk - 1) END) END) AS a,
              max(CASE WHEN pd.ka = pd.kb THEN sz.nk END) AS own_n,
              min(CASE WHEN pd.ka <> pd.kb THEN pd.s / sz.nk END) AS b
       FROM pd JOIN sz ON sz.cluster = pd.kb GROUP BY pd.id)""", body=f"""
SELECT {r6('avg(CASE WHEN own_n = 1 THEN 0.0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0.0 END)')}
       AS silhouette_sq, count(*) AS n FROM ab WHERE b IS NOT NULL"""))
def silhouette_sq(spark, d):
    return finish(ev.silhouette_sq_frame(axis_clusters(spark, d), "id", "v", "cluster"))


@REG.add("knn_top5", with_ctes(VECTORS_CTE, f"""
pd AS (SELECT a.vec_id AS id, q.vec_id AS nid, {_dist_sql('a.v', 'q.v')} AS dist
       FROM vectors a JOIN vectors q ON a.vec_id <> q.vec_id)""", """
rk AS (SELECT id, nid, dist, row_number() OVER (PARTITION BY id ORDER BY dist, nid) AS rank FROM pd)""", body=f"""
SELECT id, CAST(rank AS INTEGER) AS rank, nid, {r6('dist')} AS dist FROM rk WHERE rank <= {KNN_K}"""))
def knn_top5(spark, d):
    return finish(nb.knn(b.vectors(spark, d), "vec_id", "v", KNN_K).withColumn("rank", F.col("rank").cast("int")))


def _dbscan_sql() -> str:
    return f"""WITH RECURSIVE {VECTORS_CTE},
pairs AS (SELECT a.vec_id AS id, q.vec_id AS nid FROM vectors a JOIN vectors q ON a.vec_id <> q.vec_id
          WHERE {_dist_sql('a.v', 'q.v')} <= {DBSCAN_EPS!r}),
deg AS (SELECT id, count(*) + 1 AS n_eps FROM pairs GROUP BY id),
core AS (SELECT id FROM deg WHERE n_eps >= {DBSCAN_MIN}),
ce AS (SELECT p.id, p.nid FROM pairs p JOIN core c1 ON p.id = c1.id JOIN core c2 ON p.nid = c2.id),
reach(id, r) AS (SELECT id, id FROM core UNION SELECT ce.nid, reach.r FROM reach JOIN ce ON ce.id = reach.id),
comp AS (SELECT id, min(r) AS comp FROM reach GROUP BY id),
ord AS (SELECT comp, CAST(row_number() OVER (ORDER BY comp) - 1 AS INTEGER) AS cluster FROM (SELECT DISTINCT comp FROM comp)),
core_lab AS (SELECT c.id, o.cluster FROM comp c JOIN ord o USING (comp)),
border AS (SELECT p.id, min(cl.cluster) AS cluster FROM pairs p JOIN core_lab cl ON cl.id = p.nid
           WHERE p.id NOT IN (SELECT id FROM core) GROUP BY p.id),
lab AS (SELECT * FROM core_lab UNION ALL SELECT * FROM border)
SELECT v.vec_id AS id, CAST(coalesce(lab.cluster, -1) AS INTEGER) AS cluster FROM vectors v LEFT JOIN lab ON lab.id = v.vec_id"""


@REG.add("dbscan_labels", _dbscan_sql())
def dbscan_labels(spark, d):
    return cl.dbscan(b.vectors(spark, d), "vec_id", "v", DBSCAN_EPS, DBSCAN_MIN)


@REG.add("kmeans_clusters")
def kmeans_clusters(spark, d):
    """C1 (training-dependent: rows-only check; invariants in tests)."""
    return cl.kmeans_best(b.vectors(spark, d), "vec_id", "v", N_CLUSTERS)


@REG.add("pca_projection")
def pca_projection(spark, d):
    """C4 (component signs are arbitrary: rows-only check)."""
    return finish(cl.pca_project(b.vectors(spark, d), "vec_id", "v", 2), 4)


@REG.add("hierarchical_clusters")
def hierarchical_clusters(spark, d):
    """Divisive hierarchical clustering (training-dependent: rows-only check)."""
    return cl.bisecting_kmeans(b.vectors(spark, d), "vec_id", "v", N_CLUSTERS)


@REG.add("clustering_summary")
def clustering_summary(spark, d):
    """Methods x (silhouette_sq, ARI, NMI) against the true labels."""
    vec = b.vectors(spark, d).cache()
    methods = {
        "kmeans": cl.kmeans_best(vec, "vec_id", "v", N_CLUSTERS),
        "hierarchical": cl.bisecting_kmeans(vec, "vec_id", "v", N_CLUSTERS),
        "dbscan": cl.dbscan(vec, "vec_id", "v", DBSCAN_EPS, DBSCAN_MIN),
    }
    labels = cl.clusterings_long(methods).join(
        vec.select(F.col("vec_id").alias("id"), "v", "true_label"), "id")
    sil = ev.silhouette_sq_frame(labels, "id", "v", "cluster", ["method"]).select("method", "silhouette_sq")
    scores = ev.ari_nmi(labels, "true_label", "cluster", ["method"]).select("method", "ari", "nmi")
    return finish(scores.join(sil, "method", "left"), 3)


@REG.add("projection_feed")
def projection_feed(spark, d):
    """PCA 2-D coordinates (rounded 4) joined by id to the decoded label
    (label 0 as 'Benign', others 'Malignant') and the k-means cluster."""
    vec = b.vectors(spark, d)
    proj = cl.pca_project(vec, "vec_id", "v", 2)
    truth = vec.select(F.col("vec_id").alias("id"), (F.col("true_label") != 0).cast("int").alias("label"))
    clusters = cl.kmeans_best(vec, "vec_id", "v", N_CLUSTERS)
    return cl.projection_feed(proj, truth, clusters, "label")


@REG.add("neighbour_projection")
def neighbour_projection(spark, d):
    """Laplacian eigenmap of all vectors (signs are arbitrary: rows-only check)."""
    return finish(em.laplacian_eigenmap(b.vectors(spark, d), "vec_id", "v", 2))
