from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from clarion.operators import explain as ex


def _fit(spark):
    rows = [(str(i), float(i % 7), float((i * 3) % 5), 1 if (i % 7) + ((i * 3) % 5) > 5 else 0) for i in range(120)]
    df = spark.createDataFrame(rows, "rid string, a double, b double, label int")
    va = VectorAssembler(inputCols=["a", "b"], outputCol="features")
    lr = LogisticRegression(featuresCol="features", labelCol="label", maxIter=50).fit(
        va.transform(df).select("features", F.col("label").cast("double").alias("label")))
    return df, PipelineModel(stages=[lr])


def test_shapley_local_accuracy(spark):
    df, model = _fit(spark)
    rows = df.where("rid IN ('3', '17')")
    bg = df.limit(1)                     # a single background row: exact local accuracy
    sv = ex.shapley_sampled(model, rows, "rid", ["a", "b"], bg, n_permutations=4)
    tot = {r["rid"]: r["s"] for r in sv.groupBy("rid").agg(F.sum("contribution").alias("s")).collect()}
    va = VectorAssembler(inputCols=["a", "b"], outputCol="features")
    from pyspark.ml.functions import vector_to_array
    f = {r["rid"]: r["p"] for r in model.transform(va.transform(rows)).select(
        "rid", vector_to_array("probability")[1].alias("p")).collect()}
    f0 = model.transform(va.transform(bg)).select(vector_to_array("probability")[1]).first()[0]
    for rid in f:
        assert abs(tot[rid] - (f[rid] - f0)) < 1e-9


def test_local_surrogate_shape(spark):
    df, model = _fit(spark)
    out = ex.local_surrogate(model, df.where("rid = '5'"), "rid", ["a", "b"], df, n_samples=60, num_features=2)
    rows = out.collect()
    assert len(rows) == 2 and {r["feature_name"] for r in rows} == {"a", "b"}
    assert all(isinstance(r["weight"], float) for r in rows)


def test_registered_logistic_regressions_are_the_same(spark, monkeypatch):
    from clarion.plans import models as pm

    used = []
    monkeypatch.setattr(pm, "_fit_eval", lambda name, params, train, test: used.append(params) or test.selectExpr("label", "0.5D AS score"))
    pm.resampling_effect(spark, "/root/testdata/sf0.001")
    assert used == [{"C": 1.0}] * 2


def test_registered_shapley_explains_every_feature_of_every_test_row(spark, monkeypatch):
    from clarion.plans import explain as pe
    from clarion.sources import bindings as b

    used, sampled = [], ex.shapley_sampled
    monkeypatch.setattr(ex, "shapley_sampled", lambda *a, **kw: used.append(kw) or sampled(*a, **kw))
    d = "/root/testdata/sf0.001"
    out = pe.shapley_contributions(spark, d)
    n = pe._scaled_split(spark, d).where("split = 'test'").count()
    assert {r["feature"]: r["count"] for r in out.groupBy("feature").count().collect()} == {f: n for f in b.LINE_FEATURES}
    assert used == [{}]


class _Linear:
    """Stands for a fitted model: probability 0.1 + 0.02 a + 0.05 b."""

    def transform(self, df):
        v = vector_to_array("features")
        p = 0.1 + 0.02 * v[0] + 0.05 * v[1]
        return df.withColumn("probability", array_to_vector(F.array(1 - p, p)))


def test_sampled_shapley_by_plain_columns(spark):
    rows = spark.createDataFrame([("x", 1.0, 2.0), ("y", 3.0, 5.0)], "id string, a double, b double")
    out = ex.shapley_sampled(_Linear(), rows, "id", ["a", "b"], spark.createDataFrame([(1.0, 1.0)], "a double, b double"), n_permutations=4)
    got = {(r.id, r.feature): round(r.contribution, 9) for r in out.collect()}
    assert got == {("x", "a"): 0.0, ("x", "b"): 0.05, ("y", "a"): 0.04, ("y", "b"): 0.2}
    assert "array_position" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_scaled_split_is_read_from_written_rows(spark, tmp_path):
    """Models, bins, background means and explained rows read the scaled rows; none of them splits and scales the table again."""
    from clarion.plans import explain as pe
    rows = [(i // 4, i % 50, i % 10, i % 4, float(1 + i % 50), 100.0 + i, (i % 11) / 100, (i % 9) / 100, "RAN"[i % 3], "OF"[i % 2]) for i in range(400)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string").write.parquet(f"{d}/lineitem.parquet")
    z = pe._scaled_split(spark, d)
    plan = z._jdf.queryExecution().optimizedPlan().toString()
    assert z.count() == 400 and "Join" not in plan and "Union" not in plan
