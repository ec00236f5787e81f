import math

from pyspark.sql import functions as F

from clarion.functions.stats import exact_percentiles, running_totals
from clarion.operators import features as fe
from clarion.operators import quality as qa
from clarion.operators import split as sp


def test_dedup_keeps_one_copy(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (2, 1)], "a int, diagnosis int")
    assert qa.drop_exact_duplicates(df).count() == 2
    s = qa.duplicate_summary(df).first()
    assert (s["n_rows"], s["n_duplicates"]) == (3, 1)


def test_median_imputation(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0), (None, 2.0, 1), (3.0, 3.0, 0)], "a double, b double, diagnosis int")
    filled, med = qa.impute_median(df, ["a", "b"])
    assert sorted(r["a"] for r in filled.collect()) == [1.0, 2.0, 3.0]
    assert qa.missing_by_column(filled).count() == 0


def test_exact_percentiles_interpolate(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 10.0)], "x double")
    got = {round(r["p"], 2): r["value"] for r in exact_percentiles(df, "x", [0.5, 0.95]).collect()}
    assert got[0.5] == 2.5 and abs(got[0.95] - 8.95) < 1e-12


def test_exact_percentiles_grouped_with_hot_value(spark):
    rows = [(g, 7.0) for g in range(2) for _ in range(300)] + [(g, float(i)) for g in range(2) for i in range(100)]
    df = spark.createDataFrame(rows, "g int, x double")
    got = {(r["g"], r["p"]): r["value"] for r in exact_percentiles(df, "x", [0.1, 0.5, 0.9], ["g"]).collect()}
    import numpy as np
    vals = np.array([7.0] * 300 + list(range(100)), dtype=float)
    for p in (0.1, 0.5, 0.9):
        assert abs(got[(0, p)] - np.percentile(vals, p * 100)) < 1e-9


def test_running_totals_match_plain_window(spark):
    rows = [("m", float(i) / 97.0, i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "model string, score double, pos long")
    rt = running_totals(df, ["model"], "score", ["pos"], descending=True).collect()
    by = sorted(rows, key=lambda r: -r[1])
    cum, want = 0, {}
    for r in by:
        cum += r[2]
        want[r[1]] = cum
    assert all(r["cum_pos"] == want[r["score"]] for r in rt)


def test_running_totals_keep_null_scores(spark):
    df = spark.createDataFrame([("m", 0.5, 1), ("m", None, 1), ("m", 0.2, 1)], "model string, score double, pos long")
    rt = {r["score"]: r["cum_pos"] for r in running_totals(df, ["model"], "score", ["pos"]).collect()}
    assert rt == {0.5: 1, 0.2: 2, None: 3}


def test_quota_of_very_large_classes(spark):
    n = 3 * 10 ** 11
    counts = spark.createDataFrame([(0, n), (1, 2 * n)], "label int, n long")
    got = {r["label"]: r["k"] for r in sp.class_quota(counts, "label", 0.2).collect()}
    assert got == {0: n // 5, 1: 2 * n // 5}


def _frame(spark, n=1000):
    return spark.createDataFrame([(f"r{i}", float(i % 17), 1 if i % 3 == 0 else 0) for i in range(n)],
                                 "row_id string, x double, label int")


def test_stratified_split_exact_and_balanced(spark):
    df = _frame(spark)
    s = sp.stratified_split(df, "label", "row_id", 0.2, 42)
    counts = {(r["label"], r["split"]): r["count"] for r in s.groupBy("label", "split").count().collect()}
    assert sum(counts.values()) == 1000
    assert counts[(0, "test")] + counts[(1, "test")] == math.ceil(0.2 * 1000)
    tr = counts[(1, "train")] / (counts[(1, "train")] + counts[(0, "train")])
    te = counts[(1, "test")] / (counts[(1, "test")] + counts[(0, "test")])
    assert abs(tr - te) < 0.05


def test_split_does_not_depend_on_partitioning(spark):
    df = _frame(spark)
    a = sp.stratified_split(df.repartition(1), "label", "row_id").where("split = 'test'").select("row_id")
    b = sp.stratified_split(df.repartition(13), "label", "row_id").where("split = 'test'").select("row_id")
    assert sorted(r[0] for r in a.collect()) == sorted(r[0] for r in b.collect())


def test_folds_cover_classes_evenly(spark):
    f = sp.stratified_folds(_frame(spark), "label", "row_id", 5, 42)
    c = {(r["label"], r["fold"]): r["count"] for r in f.groupBy("label", "fold").count().collect()}
    for lab in (0, 1):
        sizes = [c[(lab, k)] for k in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_scaling_uses_population_std(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 8.0, 9.5)], "x double")
    (z,) = fe.standard_scale(df, ["x"])
    st = z.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).first()
    assert abs(st["m"]) < 1e-9 and abs(st["s"] - 1.0) < 1e-9


def test_correlation_prune_chain(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    a = rng.normal(size=400)
    c_part = rng.normal(size=400)
    b = a + c_part          # b ~ a and b ~ c, a !~ c below the threshold with the right scales
    rows = [(float(x), float(y), float(z)) for x, y, z in zip(a, a * 0.999 + 0.001 * c_part, 0.02 * a + c_part)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    kept = fe.kept_columns(fe.correlation_prune(df, ["a", "b", "c"], 0.95))
    assert kept[0] == "a" and "b" not in kept
    del b


def test_split_computes_its_rows_once(spark):
    """The rows of a split are written with their cells: readers of the split do not compute them again."""
    from clarion.operators import split as sp
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b
    df = spark.range(500).selectExpr("cast(id as string) as row_id", "cast(id % 3 = 0 as int) as label").mapInArrow(counted, "row_id string, label int")
    s = sp.stratified_split(df)
    assert s.where("split = 'test'").count() == 100 and s.count() == 500
    assert runs.value == 500
