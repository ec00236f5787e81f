import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clarion.sources import files as fs


def test_header_variants():
    assert fs.alternate_name("mean radius") == "radius_mean"
    assert fs.alternate_name("worst concave points") == "concave_points_worst"
    assert fs.alternate_name("radius error") == "radius_se"


def test_labelled_csv(spark, tmp_path):
    p = tmp_path / "data.csv"
    p.write_text("id,Diagnosis,Radius Mean,Unnamed: 32\n1,M,10.5,\n2,B,nan,\n")
    df = fs.read_labelled_csv(spark, str(p))
    assert df.columns == ["diagnosis", "radius_mean"]
    rows = sorted(df.collect(), key=lambda r: -r["diagnosis"])
    assert rows[0]["diagnosis"] == 1 and rows[1]["radius_mean"] is None


def test_missing_columns_lists_first_eight(spark, tmp_path):
    p = tmp_path / "up.csv"
    p.write_text("a,b\n1,2\n")
    with pytest.raises(fs.MissingColumnsError) as e:
        fs.read_upload_csv(spark, str(p), [f"c{i}" for i in range(10)] + ["a"])
    assert "missing 10" in str(e.value) and "and 2 more" in str(e.value)


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert set(df.columns) >= {"model", "accuracy", "precision", "recall", "f1", "roc_auc"}
    assert df.count() >= 0
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["class_balance", "model_comparison", "roc_points", "glcm_features", "knn_top5"])
def test_oracle_small(spark, name):
    import duckdb

    import __spark_entry__ as E
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ["lineitem", "embeddings", "documents", "labels", "events", "pages"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    sdf = E.queries()[name](spark, d)
    res = con.execute(E.oracle_sql()[name])
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(sdf.columns)

    def canon(names, rows):
        idx = sorted(range(len(names)), key=lambda i: names[i])
        return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in idx) for r in rows), key=repr)
    assert canon(sdf.columns, [tuple(r) for r in sdf.collect()]) == canon(cols, res.fetchall())


def _png(array, depth=8):
    """A PNG file's bytes from rows of gray (h, w) or colour (h, w, 3) values."""
    a = np.asarray(array)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + row.astype(">u2" if depth == 16 else np.uint8).tobytes() for row in a)
    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], depth, 2 if a.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_image_files_to_texture_values(spark, tmp_path):
    from clarion.operators import raster as ra

    rng = np.random.default_rng(0)
    gray, colour = rng.integers(0, 256, (9, 7)), rng.integers(0, 256, (8, 5, 3))
    files = {"benign/a.png": _png(gray), "Malignant/deep/b.PNG": _png(colour), "benign/bad.png": b"no image", "benign/empty.png": b"", "benign/wide.png": _png(rng.integers(0, 60_000, (4, 4)), 16),
             "other/c.png": _png(gray), "benign/notes.txt": b"text"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    accepted, rejects = fs.read_class_folders(spark, str(tmp_path))
    assert {(r.path.rsplit("/", 1)[1], r.label) for r in accepted.collect()} == {("a.png", 0), ("b.PNG", 1)}
    assert {r.path.rsplit("/", 1)[1]: r.reason for r in rejects.collect()} == {
        "bad.png": "not an image", "wide.png": "more than 8 bits a channel", "c.png": "unknown class folder", "notes.txt": "unsupported extension"}
    px = fs.image_pixels(accepted)
    got = {k: np.zeros(s, int) for k, s in (("a.png", (9, 7)), ("b.PNG", (8, 5)))}
    for r in px.collect():
        got[r.image_id.rsplit("/", 1)[1]][r.r, r.c] = r.level
    assert np.array_equal(got["a.png"], gray)
    red, green, blue = (colour[..., k].astype(int) for k in range(3))
    assert np.array_equal(got["b.PNG"], (blue * 1868 + green * 9617 + red * 4899 + 8192) >> 14)
    rows = ra.texture_row(px).collect()
    assert len(rows) == 2 and all(np.isfinite(v) for r in rows for v in r.asDict().values() if not isinstance(v, str))


def test_manifest_paths_match_their_files(spark, tmp_path):
    (tmp_path / "masks").mkdir()
    for n in ("m1.png", "m2.png", "m3.png"):
        (tmp_path / "masks" / n).write_bytes(b"x")
    p = tmp_path / "manifest.csv"
    p.write_text("image_path,mask_path,label,patient_id\n"
                 f"i1.png,masks/m1.png,1,p1\ni2.png,{tmp_path}/masks/m2.png,0,p2\ni3.png,file://{tmp_path}/masks/m3.png,1,p3\ni4.png,masks/gone.png,1,p4\ni5.png,nan,0,p5\ni6.png,,0,p6\n")
    for root in (str(tmp_path), f"file://{tmp_path}", f"file://{tmp_path}/"):
        rows = {r.patient_id: r for r in fs.read_manifest(spark, str(p), root).collect()}
        assert {k: r.has_mask for k, r in rows.items()} == {"p1": True, "p2": True, "p3": True, "p4": False, "p5": False, "p6": False}
        assert rows["p5"].mask_path is None and rows["p1"].image_path == f"file:{tmp_path}/i1.png"
    desc = spark.createDataFrame([("m1.png", "malignant", "q1", "masks/m2.png"), ("m2.png", "BENIGN", "q2", None), ("zz.png", "BENIGN", "q3", None)], "image_name string, pathology string, patient_id string, mask_path string")
    made = {r.patient_id: r for r in fs.build_manifest(spark, f"file://{tmp_path}/masks", desc).collect()}
    assert set(made) == {"q1", "q2"} and made["q1"].label == 1 and made["q2"].label == 0
    assert made["q1"].image_path == f"file:{tmp_path}/masks/m1.png" and made["q1"].mask_path == f"file:{tmp_path}/masks/masks/m2.png"


def test_fallback_and_metric_tables_at_full_paths(spark, tmp_path):
    (tmp_path / "b.csv").write_text("diagnosis,x\nM,1\n")
    got = fs.read_with_fallback(spark, f"file://{tmp_path}/a.csv", f"file://{tmp_path}/b.csv")
    assert got.collect()[0].asDict() == {"diagnosis": 1, "x": 1.0}
    table = spark.createDataFrame([("svm", 0.123456, "rbf"), ("mlp", None, "relu")], "model string, recall double, kind string")
    fs.write_metric_table(table, f"file://{tmp_path}/metrics")
    back = {r.name: (r.recall, r.kind) for r in fs.read_metric_table(spark, f"file://{tmp_path}/metrics", ["kind"]).collect()}
    assert back == {"svm": (0.1235, "rbf"), "mlp": (None, "relu")}
    with pytest.raises(FileNotFoundError):
        fs.read_metric_table(spark, f"file://{tmp_path}/none")


def test_models_reports_and_results_are_written(spark, tmp_path):
    from pyspark.ml import PipelineModel

    from clarion.operators import models as mo
    from clarion.operators import score as sc

    rows = [(float(i % 7), float(i % 5), float((i % 7) + (i % 5) > 5)) for i in range(80)]
    data = mo.assemble(spark.createDataFrame(rows, "a double, b double, label double"), ["a", "b"])
    forest = mo.fallback_model(data)
    assert forest.stages[0].getNumTrees == 300
    fs.save_model(forest, f"file://{tmp_path}/model", {"trees": 300})
    again = PipelineModel.load(f"file://{tmp_path}/model/model")
    assert fs.load_params(spark, f"file://{tmp_path}/model") == {"trees": 300}
    one, two = (sc.score_with_model(m, data, model_name="forest", model_source="fallback", is_demo=True) for m in (forest, again))
    assert one.select("score").collect() == two.select("score").collect()
    assert {(r.model, r.model_source, r.is_demo) for r in one.collect()} == {("forest", "fallback", True)}
    report = sc.scored_report(one.withColumn("ts", F.lit("2024-01-02T03:04:05")), 'up, "load".csv', "ts")
    fs.write_scored_report(report, f"file://{tmp_path}/report")
    back = spark.read.option("header", True).option("escape", "\"").csv(f"file://{tmp_path}/report").collect()
    assert len(back) == 80 and back[0].input_source == 'up, "load".csv' and back[0].timestamp == "2024-01-02T03:04:05" and back[0].warning
    assert sc.scored_report(one.withColumn("is_demo", F.lit(False)), "x").select("warning").distinct().collect()[0][0] is None
    results = one.select("score", "predicted_class").withColumn("note", F.lit('a "b", c'))
    fs.write_batch_results(results, f"file://{tmp_path}/results")
    read = spark.read.option("header", True).option("escape", '"').csv(f"file://{tmp_path}/results")
    assert read.columns == ["score", "predicted_class", "note"] and read.select("note").distinct().collect()[0][0] == 'a "b", c'


def test_families_of_columns(spark):
    from clarion.operators import score as sc

    df = spark.createDataFrame([(1.0, 2.0, 3.0, 1)], "radius_mean double, radius_se double, area_mean double, diagnosis int")
    assert sc.select_family(df, "mean", ["diagnosis"]).columns == ["radius_mean", "area_mean", "diagnosis"]
    assert sc.select_family(df, ["radius_se", "radius_mean"]).columns == ["radius_mean", "radius_se"]
    for wrong in ("worst", ["radius_mean", "nothing"]):
        with pytest.raises(ValueError):
            sc.select_family(df, wrong)
