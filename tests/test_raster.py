from clarion.operators import raster as ra


def _grid(spark, values, h, w, image_id=1):
    return spark.createDataFrame([(image_id, i // w, i % w, v) for i, v in enumerate(values)],
                                 "image_id long, r int, c int, level int")


def test_histogram_last_bin_closed(spark):
    px = _grid(spark, [0, 254, 255, 128], 2, 2)
    h = {r["bin"]: r["count"] for r in ra.intensity_histogram(px).collect()}
    assert len(h) == 32 and h[0] == 1 and h[31] == 2 and h[16] == 1


def test_minmax_rescale_subtracts_the_minimum_first(spark):
    px = _grid(spark, [100, 150, 200, 100], 2, 2)
    assert sorted(r["value"] for r in ra.minmax_rescale(px, "level").collect()) == [0, 0, 127, 255]
    assert sorted(r["value"] for r in ra.minmax_rescale(px, "level", invert=True).collect()) == [0, 127, 255, 255]
    assert {r["value"] for r in ra.minmax_rescale(_grid(spark, [9] * 4, 2, 2), "level").collect()} == {0}


def test_concentration_edges(spark):
    zero = spark.createDataFrame([(1, i, 0, 0.0) for i in range(9)], "image_id long, r int, c int, heat double")
    assert ra.attention_concentration(zero).first()["concentration"] == 0.0
    hot = spark.createDataFrame([(1, i, 0, 1.0 if i == 4 else 0.0) for i in range(9)],
                                "image_id long, r int, c int, heat double")
    assert ra.attention_concentration(hot).first()["concentration"] == 1.0


def test_iou_empty_union_is_zero(spark):
    df = spark.createDataFrame([(1, 0, 0, 0.1, 0, True)], "image_id long, r int, c int, heat double, mask int, has_mask boolean")
    assert ra.heatmap_iou(df).first()["iou"] == 0.0


def test_texture_values_finite(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    px = _grid(spark, [int(x) for x in rng.integers(0, 255, 64)], 8, 8)
    row = ra.texture_row(px).first().asDict()
    assert len(row) == 10 and all(np.isfinite(v) for k, v in row.items() if k != "image_id")
    assert 0 < row["glcm_ASM"] <= 1 and 0 < row["glcm_energy"] <= 1


def test_edge_density_of_steps(spark):
    step = lambda top, low: [(low if i // 8 > 3 else top) if i % 8 > 3 else 0 for i in range(64)]
    px = _grid(spark, step(255, 255), 8, 8).unionByName(_grid(spark, step(30, 30), 8, 8, 2)).unionByName(_grid(spark, [7] * 64, 8, 8, 3))
    share = {r["image_id"]: r["canny_edge_density"] for r in ra.edge_density(px).collect()}
    assert share == {1: 8 / 64, 2: 0.0, 3: 0.0}  # one column of the strong step; a weak step alone is none
    mixed = ra.edge_density(_grid(spark, step(255, 40), 8, 8)).first()["canny_edge_density"]
    assert mixed >= 7 / 64  # the weak half hangs on the strong one
    assert ra.edge_density(_grid(spark, [], 1, 1)).count() == 0


def test_sobel_constant_image_is_zero(spark):
    px = _grid(spark, [100] * 16, 4, 4)
    r = ra.sobel_stats(px).first()
    assert r["sobel_mean"] == 0.0 and r["sobel_std"] == 0.0


def test_denoise_keeps_shape_and_rejects_unknown(spark):
    px = _grid(spark, list(range(16)), 4, 4)
    assert ra.denoise(px, "median").count() == 16 and ra.denoise(px, "gaussian").count() == 16
    import pytest
    with pytest.raises(KeyError, match="gaussian"):
        ra.denoise(px, "bilateral")


def test_losses_without_masks_are_zero(spark):
    df = spark.createDataFrame([(1, False, 10.0, 1.0)], "image_id long, has_mask boolean, logit double, target double")
    assert ra.segmentation_losses(df).first()["loss"] == 0.0
    perfect = spark.createDataFrame([(1, True, 10.0, 1.0)] * 256, "image_id long, has_mask boolean, logit double, target double")
    r = ra.segmentation_losses(perfect, mode="dice").first()
    assert r["loss"] < 1e-3


def test_clahe_keeps_shape_and_range(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    px = _grid(spark, [int(x) for x in rng.integers(0, 255, 64)], 8, 8)
    out = ra.clahe(px, 2.0, 2).collect()
    assert len(out) == 64 and all(0 <= r["level"] <= 255 for r in out)


def _random(spark, h, w, seed=0, image_id=1):
    import numpy as np
    g = np.random.default_rng(seed).integers(0, 256, (h, w))
    return g, _grid(spark, [int(x) for x in g.ravel()], h, w, image_id)


def test_neighbourhoods_across_strips(spark):
    """An image of several strips whose sides are no multiple of them, against numpy with the borders laid around."""
    import numpy as np
    g, px = _random(spark, 2 * ra.STRIP + 7, 5)
    shift = lambda p: np.stack([p[1 + dr: p.shape[0] - 1 + dr, 1 + dc: p.shape[1] - 1 + dc] for dr, dc in ra.AROUND])
    held = lambda df, col: np.array([r[col] for r in df.orderBy("r", "c").collect()]).reshape(g.shape)
    assert np.array_equal(held(ra.median_denoise(px), "level"), np.sort(shift(np.pad(g, 1, mode="edge")), axis=0)[4])
    around = shift(np.pad(g, 1, mode="reflect"))
    weights = np.array([(2 - abs(dr)) * (2 - abs(dc)) / 16 for dr, dc in ra.AROUND])
    assert np.allclose(held(ra.gaussian_denoise(px), "value"), np.tensordot(weights, around, 1))
    kernel = lambda k: np.tensordot(np.array([dict(((a, b), w) for a, b, w in k).get(o, 0) for o in ra.AROUND]), around, 1)
    assert np.allclose(held(ra.sobel_magnitude(px), "mag"), np.hypot(kernel(ra.SOBEL_X), kernel(ra.SOBEL_Y)))
    for h, w in ((1, 1), (1, 4), (3, 1), (ra.STRIP, 2), (ra.STRIP + 1, 2)):
        assert ra.sobel_magnitude(_random(spark, h, w)[1]).count() == h * w


def test_cooccurrence_across_strips(spark):
    from collections import Counter
    g, px = _random(spark, ra.STRIP + 5, 6, 1)
    want = Counter()
    for d, a, dr, dc in ra.glcm_offsets():
        for r in range(g.shape[0]):
            for c in range(g.shape[1]):
                if r + dr < g.shape[0] and 0 <= c + dc < g.shape[1]:
                    i, j = sorted((int(g[r, c]), int(g[r + dr, c + dc])))
                    want[d, a, i, j] += 1
    assert {(r.distance, r.angle, r.a, r.b): r.cnt for r in ra.glcm_cells(px).collect()} == want
    assert ra.glcm_cells(_random(spark, 2, 1)[1]).count() > 0


def test_clahe_of_sides_that_are_no_multiple(spark):
    g, px = _random(spark, 13, 9, 2)
    out = ra.clahe(px, 2.0, 4).collect()
    assert sorted((r["r"], r["c"]) for r in out) == [(r, c) for r in range(13) for c in range(9)]
    assert all(0 <= r["level"] <= 255 for r in out)
    flat = ra.clahe(_grid(spark, [100] * 35, 5, 7), 2.0, 2).collect()
    assert len({r["level"] for r in flat}) == 1


def test_grayscale_unit_scale_and_nearest(spark):
    bgr = spark.createDataFrame([(1, 0, 0, 255, 255, 255), (1, 0, 1, 255, 0, 0), (1, 1, 0, 0, 255, 0), (1, 1, 1, 0, 0, 255)], "image_id long, r int, c int, b int, g int, r_ int")
    assert [r.level for r in ra.grayscale(bgr).orderBy("r", "c").collect()] == [255, 29, 150, 76]
    assert [r.value for r in ra.unit_scale(_grid(spark, [0, 51, 255, 102], 2, 2)).orderBy("r", "c").collect()] == [0.0, 0.2, 1.0, 0.4]
    near = ra.nearest_resize(_grid(spark, list(range(16)), 4, 4), 2, 2).orderBy("r", "c").collect()
    assert [r.level for r in near] == [0, 2, 8, 10]


def test_clahe_moves_only_bins_that_occur(spark):
    """No row per bin of every tile: the plan makes no table of 256 levels and no window over one; sizes of several images against one alone."""
    plan = ra.clahe(_grid(spark, list(range(64)), 8, 8), 2.0, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "0 to 255" not in plan and "lag" not in plan
    a, b = _random(spark, 8, 8, 3, 1)[1], _random(spark, 13, 9, 4, 2)[1]
    both = sorted(map(tuple, ra.clahe(a.unionByName(b), 2.0, 2).collect()))
    assert both == sorted(map(tuple, ra.clahe(a, 2.0, 2).collect() + ra.clahe(b, 2.0, 2).collect()))


def test_clahe_tables_by_hand():
    """Two tiles' worth of one image: 4 pixels of one level are clipped at 1, the rest is dealt from level 0 on."""
    import pyarrow as pa
    b = pa.record_batch({"image_id": [7, 8], "th": pa.array([2, 2], pa.int32()), "tw": pa.array([2, 2], pa.int32()), "bin": [[10], None], "cnt": [[4], None]},
                        schema=pa.schema([("image_id", pa.int64()), ("th", pa.int32()), ("tw", pa.int32()), ("bin", pa.list_(pa.int64())), ("cnt", pa.list_(pa.int64()))]))
    out, = ra._tables(2.0, 1)(iter([b]))
    lut = out.column("lut").to_pylist()
    assert lut[0][0] == 64 and lut[0][9] == 64 and lut[0][10] == 128 and lut[0][85] == 191 and lut[0][255] == 255 and set(lut[1]) == {0}
