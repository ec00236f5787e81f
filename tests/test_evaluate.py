import re

from pyspark.sql import functions as F

from clarion.functions.columns import risk_tier, specimen_tag
from clarion.operators import evaluate as ev


def _expand(spark, cells):
    rows = []
    for model, (tn, fp, fn, tp) in cells.items():
        rows += [(model, 0, 0)] * tn + [(model, 0, 1)] * fp + [(model, 1, 0)] * fn + [(model, 1, 1)] * tp
    return spark.createDataFrame(rows, "model string, label int, pred int")


def test_golden_confusion_matrices(spark):
    cells = {"ensemble_voting": (72, 0, 2, 40), "logistic_regression": (71, 1, 2, 40), "random_forest": (71, 1, 3, 39)}
    rep = {r["model"]: r for r in ev.report_from_counts(ev.confusion_counts(_expand(spark, cells))).collect()}
    assert [round(rep["ensemble_voting"][k], 4) for k in ("accuracy", "precision", "recall", "f1")] == [0.9825, 1.0, 0.9524, 0.9756]
    assert [round(rep["logistic_regression"][k], 4) for k in ("accuracy", "precision", "recall", "f1")] == [0.9737, 0.9756, 0.9524, 0.9639]
    assert [round(rep["random_forest"][k], 4) for k in ("accuracy", "precision", "recall", "f1")] == [0.9649, 0.975, 0.9286, 0.9512]


def test_zero_division_is_zero(spark):
    df = spark.createDataFrame([("m", 0, 0), ("m", 0, 0)], "model string, label int, pred int")
    r = ev.report_from_counts(ev.confusion_counts(df)).first()
    assert r["precision"] == 0.0 and r["recall"] == 0.0


def test_auc_ties_and_order(spark):
    tied = spark.createDataFrame([("m", i % 2, 0.5) for i in range(10)], "model string, label int, score double")
    assert ev.auc(tied).first()["auc"] == 0.5
    perfect = spark.createDataFrame([("m", 1, 0.9), ("m", 1, 0.8), ("m", 0, 0.2)], "model string, label int, score double")
    assert ev.auc(perfect).first()["auc"] == 1.0
    one_class = spark.createDataFrame([("m", 1, 0.9)], "model string, label int, score double")
    assert ev.auc(one_class).first()["auc"] is None


def test_auc_invariant_to_monotone_map(spark):
    rows = [("m", i % 3 == 0, (i * 37 % 101) / 101.0) for i in range(300)]
    df = spark.createDataFrame([(m, int(l), s) for m, l, s in rows], "model string, label int, score double")
    a = ev.auc(df).first()["auc"]
    b = ev.auc(df.withColumn("score", F.col("score") ** 3)).first()["auc"]
    assert abs(a - b) < 1e-12


def test_roc_drops_collinear_points(spark):
    df = spark.createDataFrame([("m", l, s) for l, s in [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.6), (1, 0.55)]],
                               "model string, label int, score double")
    pts = sorted((r["idx"], r["fpr"], r["tpr"]) for r in ev.roc_curve(df).collect())
    assert pts[0][1:] == (0.0, 0.0) and pts[-1][1:] == (1.0, 1.0)


def test_ari_nmi_invariance_and_trivial(spark):
    rows = [(t, p) for t, p in [(0, 5), (0, 5), (1, 7), (1, 7), (2, -1), (2, -1)]]
    df = spark.createDataFrame(rows, "t int, p int")
    r = ev.ari_nmi(df, "t", "p").first()
    assert abs(r["ari"] - 1.0) < 1e-12 and abs(r["nmi"] - 1.0) < 1e-12
    single = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (1, 0)], "t int, p int")
    s = ev.ari_nmi(single, "t", "p").first()
    assert abs(s["ari"]) < 1e-12 and s["nmi"] == 0.0


def test_risk_tier_boundaries(spark):
    df = spark.createDataFrame([(0.34996,), (0.35,), (0.5,), (0.65,)], "p double")
    assert [r[0] for r in df.select(risk_tier("p")).collect()] == ["Low", "Moderate", "Moderate", "High"]


def test_specimen_tag_fixture(spark):
    df = spark.createDataFrame([("scan_001.png",)], "name string")
    assert df.select(specimen_tag("name")).first()[0] == "SPEC-7GP5PM"


def test_curves_are_not_dealt_by_model(spark):
    df = spark.range(6_000).select(F.concat(F.lit("m"), F.col("id") % 2).alias("model"), (F.col("id") % 3 == 0).cast("int").alias("label"), (F.col("id") * 37 % 5_003 / 5_003).alias("score"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        roc = ev.roc_curve(df)
        down = ev.roc_downsample(roc)
        for out in (roc, down):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert not re.search(r"hashpartitioning\(model#\d+, \d+\)", plan)
        assert down.count() > 2 * 60
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
