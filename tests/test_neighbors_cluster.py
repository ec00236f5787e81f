import numpy as np
import pytest

from clarion.operators import cluster as cl
from clarion.operators import imbalance as im
from clarion.operators import neighbors as nb


def _vectors(spark, n=120, d=6, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    return spark.createDataFrame([(i, [float(v) for v in x[i]], int(i % 2)) for i in range(n)],
                                 "id long, v array<double>, label int"), x


def test_knn_matches_brute_force(spark):
    df, x = _vectors(spark)
    got = {(r["id"], r["rank"]): r["nid"] for r in nb.knn(df, "id", "v", 5).collect()}
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        order = sorted(range(len(x)), key=lambda j: (d[j], j))[:5]
        assert [got[(i, k + 1)] for k in range(5)] == order


def test_dbscan_two_blobs_noise_and_border(spark):
    pts = [(0, [0.0, 0.0]), (1, [0.1, 0.0]), (2, [0.0, 0.1]), (3, [0.1, 0.1]), (4, [0.05, 0.05]),
           (10, [5.0, 5.0]), (11, [5.1, 5.0]), (12, [5.0, 5.1]), (13, [5.1, 5.1]), (14, [5.05, 5.05]),
           (20, [50.0, 50.0])]
    df = spark.createDataFrame(pts, "id long, v array<double>")
    lab = {r["id"]: r["cluster"] for r in cl.dbscan(df, "id", "v", eps=0.2, min_samples=5).collect()}
    assert lab[20] == -1
    assert len({lab[i] for i in range(5)}) == 1 and len({lab[i] for i in range(10, 15)}) == 1
    assert lab[0] != lab[10]


def test_smote_balances_and_stays_on_segments(spark):
    df, _ = _vectors(spark, n=90)
    df = df.withColumn("label", (df["id"] % 3 == 0).cast("int"))
    res = im.smote(df, "id", "v", "label", 5, 42)
    counts = {r["label"]: r["count"] for r in res.groupBy("label").count().collect()}
    assert counts[0] == counts[1] == 60
    assert res.where("synthetic").count() == 30


def test_bisecting_two_groups(spark):
    pts = [(i, [float(i % 2) * 10 + 0.01 * i, 0.0]) for i in range(20)]
    df = spark.createDataFrame(pts, "id long, v array<double>")
    lab = {r["id"]: r["cluster"] for r in cl.bisecting_kmeans(df, "id", "v", 2).collect()}
    assert len({lab[i] for i in range(0, 20, 2)}) == 1 and lab[0] != lab[1]


def test_knn_keeps_collinear_neighbours(spark):
    for a, b in ((1.0, 1.0), (3.0, 7.0)):
        df = spark.createDataFrame([(i, [a * i * 0.1, b * i * 0.1]) for i in range(60)], "id long, v array<double>")
        counts = {r["id"]: r["count"] for r in nb.knn(df, "id", "v", 5).groupBy("id").count().collect()}
        assert counts == {i: 5 for i in range(60)}


def test_dbscan_keeps_string_and_wide_ids(spark):
    pts = [(f"p{i}", 2 ** 60 + i, [0.01 * (i % 5) + 5.0 * (i // 5), 0.0]) for i in range(10)]
    df = spark.createDataFrame(pts, "s string, n long, v array<double>")
    for key in ("s", "n"):
        lab = {r["id"]: r["cluster"] for r in cl.dbscan(df, key, "v", eps=0.2, min_samples=3).collect()}
        assert [lab[p[0] if key == "s" else p[1]] for p in pts] == [0] * 5 + [1] * 5


def test_numbers_of_clusters_over_range_partitions(spark):
    from clarion.operators.cluster import numbered

    ids = [f"c{i:05d}" for i in range(0, 9_000, 3)]
    spread = spark.createDataFrame([(i,) for i in reversed(ids)], "comp string").repartition(7)
    out = numbered(spread, "comp", "cluster")
    assert {r.comp: r.cluster for r in out.collect()} == {c: k for k, c in enumerate(ids)}
    assert numbered(spread.limit(0), "comp", "cluster").count() == 0


def _brute(x, k):
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return [[(j, d[i, j]) for j in sorted(range(len(x)), key=lambda j: (d[i, j], j))[:k]] for i in range(len(x))]


def test_knn_over_many_blocks_and_a_hot_cell(spark):
    """A third of the points are equal, the others lie in clusters of very different density."""
    rng = np.random.default_rng(4)
    x = np.concatenate([np.full((700, 3), 0.25), rng.normal(0, 0.01, (700, 3)) + 5, rng.normal(0, 40, (700, 3))])
    df = spark.createDataFrame([(f"p{i:05d}", [float(c) for c in row]) for i, row in enumerate(x)], "id string, v array<double>")
    blocks = nb.Blocks(df, "id", "v", 3)
    assert blocks.table.agg({"n": "max"}).first()[0] < 1.5 * nb.BLOCK and blocks.table.count() >= 5
    got = {}
    for r in blocks.search().orderBy("id", "rank").collect():
        got.setdefault(int(r.id[1:]), []).append((int(r.nid[1:]), r.dist))
    for i, want in enumerate(_brute(x, 3)):
        assert [j for j, _ in got[i]] == [j for j, _ in want] and np.allclose([d for _, d in got[i]], [d for _, d in want])


def test_radius_pairs_match_brute_force(spark):
    df, x = _vectors(spark, 1_500, 2)
    got = {(r.id, r.nid) for r in nb.radius_pairs(df, "id", "v", 0.1).collect()}
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    assert got == {(i, j) for i, j in zip(*np.nonzero(d <= 0.1)) if i != j}
    assert nb.radius_pairs(df.limit(0), "id", "v", 0.1).count() == 0


def test_little_is_compared_in_few_dimensions(spark):
    """5 and 2 dimensions: far below all pairs."""
    df, _ = _vectors(spark, 20_000, 2)
    assert nb.Blocks(df, "id", "v", 5).compared() < 0.1
    from clarion.plans import models as pm

    docs = pm.scaled_docs(spark, "/root/testdata/sf0.1")
    assert nb.Blocks(docs, "doc_id", "v", 5).compared() < 0.35


def test_probed_search_has_its_recall(spark):
    """64 dimensions, points around 40 centres: half of the cells are never met."""
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (40, 64))[rng.integers(0, 40, 4_000)] + rng.normal(0, 0.3, (4_000, 64))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, v array<double>")
    blocks = nb.Blocks(df, "id", "v", 5)
    assert blocks.cells == 15 and nb.PROBES < blocks.cells
    assert nb.recall(blocks.search(nb.PROBES), blocks.search()) >= 0.9


def test_a_long_path_takes_few_rounds(spark):
    n = 10_000
    ids = np.random.default_rng(1).permutation(n).tolist()
    path = spark.createDataFrame(list(zip(ids, ids[1:])), "src long, dst long")
    stars, rounds = cl.contracted(path)
    assert rounds < 20
    assert stars.count() == n - 1 and stars.agg({"dst": "max"}).first()[0] == 0
    two = cl.connected_components(spark.range(5), spark.createDataFrame([(1, 2), (2, 1), (4, 4), (3, 1)], "src long, dst long"))
    assert {tuple(r) for r in two.collect()} == {(0, 0), (1, 1), (2, 1), (3, 1), (4, 4)}


def test_synthetic_rows_have_no_parent_in_the_held_fold(spark):
    df, x = _vectors(spark, 240, 3)
    df = df.selectExpr("id", "v", "CAST(id % 6 = 0 AS INT) AS label", "CAST(id % 4 AS INT) AS fold")
    fold = {str(r.id): r.fold for r in df.collect()}
    minor = [int(i) for i in range(240) if i % 6 == 0]
    rows = im.smote_in_folds(df, "id", "v", "label", "fold", 4, 3, 42).collect()
    want = {f: sum(1 for i in range(240) if i % 6 and i % 4 != f) - sum(1 for i in minor if i % 4 != f) for f in range(4)}
    assert {f: sum(r.held == f for r in rows) for f in range(4)} == want and len({r.id for r in rows}) == len(rows)
    for r in rows:
        assert r.label == 1 and fold[r.base] != r.held and fold[r.neighbour] != r.held and r.base != r.neighbour
        # the neighbour is one of the 3 nearest of the training part
        own = sorted((i for i in minor if i % 4 != r.held and i != int(r.base)), key=lambda i: np.linalg.norm(x[i] - x[int(r.base)]))[:3]
        assert int(r.neighbour) in own
        a, b, v = x[int(r.base)], x[int(r.neighbour)], np.array(r.v)
        u = np.dot(v - a, b - a) / np.dot(b - a, b - a)
        assert -1e-9 <= u <= 1 and np.allclose(v, a + u * (b - a))


def test_what_a_radius_gathers_has_no_row_per_pair(spark):
    """200 points that all lie within the radius make 39,800 pairs: counts, links and labels are some rows a point."""
    from clarion.operators import cluster as cl
    from clarion.operators.neighbors import Blocks
    rng = np.random.default_rng(0)
    v = np.r_[rng.normal(size=(200, 3)) * 0.1, rng.normal(size=(200, 3)) * 0.1 + 50, [[50.0, 50.0, 51.2], [0.0, 0.0, 99.0]]]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")
    blocks = Blocks(df, "id", "v", None, 1.0)
    d = np.sqrt(((v[:, None] - v) ** 2).sum(axis=2)) <= 1.0
    counts = {r.id: r.n for r in blocks.gathered("counts").groupBy("id").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert counts == {i: int(d[i].sum()) - 1 for i in range(len(v))}
    links = blocks.gathered("links").collect()
    assert len(links) <= 4 * len(v) and all(d[r.id, r.nid] or (r.id < 200) == (r.nid < 200) for r in links)
    found = {r.id: r.cluster for r in cl.dbscan(df, "id", "v", 1.0, 30).collect()}
    near = bool(d[400, 200:400].any())
    assert [found[i] for i in range(400)] == [0] * 200 + [1] * 200 and found[400] == (1 if near else -1) and found[401] == -1


def test_teams_do_not_grow_with_the_points(spark):
    """Each team may need every vector: there are teams for the cores, not for every so many points."""
    from clarion.operators.neighbors import TEAMS_A_CORE, Blocks
    rng = np.random.default_rng(1)
    most = TEAMS_A_CORE * spark.sparkContext.defaultParallelism
    for n in (6_000, 600):
        df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rng.normal(size=(n, 2)))], "id long, v array<double>")
        blocks = Blocks(df, "id", "v", 3)
        teams = blocks._stream(None).select("team").distinct().count()
        assert min(blocks.cells, most) // 2 <= teams <= most


@pytest.mark.parametrize("scale", [1e-20, 1e-3, 1.0, 1e9, 1e20])
def test_single_precision_only_chooses_pairs_to_compare(scale):
    """Near ties, points far from the origin and all sizes: the same neighbours as by distances in double precision."""
    rng = np.random.default_rng(41)
    v = np.concatenate([rng.normal(size=(300, 8)), 1 + rng.normal(size=(300, 8)) * 1e-6, np.repeat(rng.normal(size=(50, 8)), 4, axis=0)]) * scale
    ids, k = np.arange(len(v)), 5
    for tags in (1, 2):
        tag = (ids % tags).astype(np.int32)
        found = nb.Nearest(ids[:200], v[:200], k, np.inf, tags)
        for i in range(0, len(v), 64):
            found.meet(ids[i: i + 64], v[i: i + 64], tag[i: i + 64])
        found.settle()
        got = list(zip((found.key // tags).tolist(), (found.key % tags).tolist(), found.nid.tolist()))
        want = []
        for i in range(200):
            d = np.sqrt(((v[i] - v) ** 2).sum(axis=1))
            for t in range(tags):
                own = [j for j in ids[tag == t].tolist() if j != i]
                want += [(i, t, j) for j in sorted(own, key=lambda j: (d[j], j))[:k]]
        assert got == want
