"""Clustering and projection (C1-C5, C7) and connected components.

Everything iterative cuts its lineage with a reliable ``checkpoint`` into the
folder named by ``spark.checkpoint.dir`` (see ``clarion.session``).
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clarion.operators.neighbors import Blocks
from clarion.session import cut_lineage, kept

# Reference defaults (fixed values).
KMEANS_K = 2
KMEANS_RESTARTS = 10
RESTARTS_AT_A_TIME = 4
SEED = 42
DBSCAN_EPS = 1.5
DBSCAN_MIN_SAMPLES = 5


def kmeans_best(df: DataFrame, id_col: str, vec_col: str, k: int = KMEANS_K,
                restarts: int = KMEANS_RESTARTS, seed: int = SEED) -> DataFrame:
    """K-means with ``restarts`` seeds, the lowest training cost wins:
    (id, cluster)."""
    data = df.select(F.col(id_col).alias("id"), array_to_vector(vec_col).alias("features")).cache()

    def fitted(i: int):
        return KMeans(k=k, seed=seed + i, featuresCol="features", predictionCol="cluster").fit(data)

    with ThreadPool(RESTARTS_AT_A_TIME) as pool:
        models = pool.map(inheritable_thread_target(df.sparkSession)(fitted), range(restarts), chunksize=1)
    best = min(models, key=lambda m: m.summary.trainingCost)  # the first of equal ones
    data.unpersist()
    return best.transform(data).select("id", F.col("cluster").cast("int").alias("cluster"))


def bisecting_kmeans(df: DataFrame, id_col: str, vec_col: str, k: int = KMEANS_K, seed: int = SEED) -> DataFrame:
    """Divisive hierarchical clustering; every level is distributed work, at any row count."""
    data = df.select(F.col(id_col).alias("id"), array_to_vector(vec_col).alias("features"))
    model = BisectingKMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(data)
    return model.transform(data).select("id", F.col("cluster").cast("int").alias("cluster"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex gets an edge to the smallest vertex around it."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
    return both.where(F.col("dst") > F.col("src")).join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours get an edge to the smallest of them."""
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = down.groupBy("src").agg(F.min("dst").alias("m"))
    moved = down.join(least, "src").where(F.col("dst") != F.col("m")).select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return moved.unionByName(least.withColumnRenamed("m", "dst")).distinct()


def contracted(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges (src, dst) from every vertex to the smallest of its component, and the rounds it took.

    Alternating large and small stars; the rounds grow with the logarithm of a
    component's size, not with its diameter.  Each round is written, so a lost
    executor costs its tasks only.
    """
    edges = kept(edges.where(F.col("src") != F.col("dst")).select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("src", "dst")), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
    before, rounds = mark(edges), 0
    while before[0]:
        edges, rounds = kept(_small_star(_large_star(edges)), "edges"), rounds + 1
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges, rounds


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, comp) with comp = smallest id in the component; ``edges`` (src, dst) have no direction."""
    stars, _ = contracted(edges)
    return vertices.select("id").join(stars.withColumnRenamed("src", "id"), "id", "left").select("id", F.coalesce("dst", "id").alias("comp"))


def numbered(df: DataFrame, col: str, out: str) -> DataFrame:
    """``df`` of distinct ``col`` plus ``out``, its place 0, 1, ... in order of ``col``: range partitions and their prefix-summed counts."""
    # cut, so that the partitions that are counted are those that are numbered
    parted = cut_lineage(df.repartitionByRange(F.col(col)).withColumn("_pid", F.spark_partition_id()))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = parted.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n")).select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"))
    place = F.col("_n0") + F.row_number().over(Window.partitionBy("_pid").orderBy(col)) - 1
    return parted.join(F.broadcast(starts), "_pid").select(*df.columns, place.cast("int").alias(out))


def dbscan(df: DataFrame, id_col: str, vec_col: str, eps: float = DBSCAN_EPS,
           min_samples: int = DBSCAN_MIN_SAMPLES) -> DataFrame:
    """(id, cluster) with -1 for noise.

    core: at least ``min_samples`` points within eps including itself; clusters
    are connected components of the core graph, numbered by their smallest
    core id; a border point joins the smallest adjacent cluster.
    """
    pts = df.select(F.col(id_col).alias("id"))
    data = kept(df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")), "vectors")
    # the pairs within the radius grow with the square: they are counted and joined where they are found
    near = Blocks(data, "id", "v", None, float(eps)).gathered("counts").groupBy("id").agg(F.sum("n").alias("n")).where("n > 0")
    core = kept(near.where(F.col("n") + 1 >= min_samples).select("id"), "core")
    links = Blocks(data.join(core, "id", "left_semi"), "id", "v", None, float(eps)).gathered("links")
    comps = kept(connected_components(core, links.select(F.col("id").alias("src"), F.col("nid").alias("dst"))), "components")
    # number clusters 0..K-1 in order of their smallest core id (table of K rows)
    # by the id itself: strings and longs beyond 2 ** 53 keep their order
    order = numbered(comps.select("comp").distinct(), "comp", "cluster")
    core_lab = kept(comps.join(order, "comp").select("id", "cluster"), "core-labels")
    tagged = data.join(core_lab, "id", "left").select("id", "v", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    border = Blocks(tagged, "id", "v", None, float(eps), tag_col="cluster").gathered("least").groupBy("id").agg(F.min("label").alias("cluster"))
    lab = core_lab.unionByName(border)
    return pts.join(lab, "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"))


def pca_project(df: DataFrame, id_col: str, vec_col: str, k: int = 2, standardize: bool = True) -> DataFrame:
    """C4: (id, x, y[, z]) PCA projection (columns centred, optionally scaled
    by population std).  Component signs are arbitrary."""
    from pyspark.ml.feature import StandardScaler
    data = df.select(F.col(id_col).alias("id"), array_to_vector(vec_col).alias("v"))
    scaler = StandardScaler(inputCol="v", outputCol="s", withMean=True, withStd=standardize).fit(data)
    scaled = scaler.transform(data)
    model = PCA(k=k, inputCol="s", outputCol="p").fit(scaled)
    arr = model.transform(scaled).select("id", vector_to_array("p").alias("p"))
    names = ["x", "y", "z"][:k]
    return arr.select("id", *[F.col("p")[i].alias(n) for i, n in enumerate(names)])


def projection_feed(proj: DataFrame, truth: DataFrame, clusters: DataFrame, label_col: str = "label",
                    digits: int = 4) -> DataFrame:
    """Coordinates rounded, decoded true label and cluster as a string;
    ``z`` only when present.  Joined on id (not by position)."""
    from clarion.functions.columns import decode_label
    coords = [F.bround(c, digits).alias(c) for c in ("x", "y", "z") if c in proj.columns]
    return (proj.join(truth.select("id", label_col), "id").join(clusters, "id")
            .select("id", *coords, decode_label(label_col).alias("trueDiagnosis"),
                    F.col("cluster").cast("string").alias("kmeansCluster")))


def nearest_axis_clusters(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """A deterministic partition for metric checks: the index of the largest
    coordinate; -1 (noise) when that largest value is negative."""
    mx = F.array_max(vec_col)
    idx = F.array_position(F.col(vec_col), mx) - 1
    return df.select(F.col(id_col).alias("id"),
                     F.when(mx < 0, F.lit(-1)).otherwise(idx).cast("int").alias("cluster"))


def clusterings_long(methods: dict[str, DataFrame]) -> DataFrame:
    """(method, id, cluster) from several (id, cluster) frames."""
    out = None
    for name, frame in methods.items():
        part = frame.select(F.lit(name).alias("method"), "id", "cluster")
        out = part if out is None else out.unionByName(part)
    return out
