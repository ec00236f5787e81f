"""Registered raster-grid queries (R2, R5-R8, R13-R16) over the ``grids`` and
``heat_mask`` bindings, each with a DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from clarion.operators import raster as ra
from clarion.plans.common import Registry, finish
from clarion.plans.sql import GRIDS_CTE, HEAT_MASK_CTE, r6, with_ctes
from clarion.sources import bindings as b

REG = Registry()
RESIZE_TO = 3          # 8 x 8 -> 3 x 3: a non-integer area factor
LOGIT_GAIN = 8.0       # mask logit = 8 * (heat - 0.5) for the loss metrics


def _f(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


@REG.add("intensity_histogram", with_ctes(GRIDS_CTE, """
cnt AS (SELECT image_id, CAST(least(floor(level * 32.0 / 255.0), 31) AS INTEGER) AS bin, count(*) AS n
        FROM grids GROUP BY ALL)""", """
dense AS (SELECT image_id, CAST(t.b AS INTEGER) AS bin FROM (SELECT DISTINCT image_id FROM grids) i,
          range(0, 32) t(b))""", """
mom AS (SELECT image_id, avg(level) AS mean_intensity, stddev_pop(level) AS std_intensity FROM grids GROUP BY 1)""",
    body=f"""
SELECT d.image_id, d.bin, {r6(f'round_even((d.bin + 0.5) * {_f(255.0 / 32)}, 1)')} AS center,
       coalesce(cnt.n, 0) AS count, {r6('m.mean_intensity')} AS mean_intensity,
       {r6('m.std_intensity')} AS std_intensity
FROM dense d LEFT JOIN cnt USING (image_id, bin) JOIN mom m USING (image_id)"""))
def intensity_histogram(spark, d):
    g = b.grids(spark, d)
    return finish(ra.intensity_histogram(g).join(ra.intensity_moments(g), "image_id"))


def _glcm_offsets_sql() -> str:
    rows = ", ".join(f"({dist}, {ang}, {dr}, {dc})" for dist, ang, dr, dc in ra.glcm_offsets())
    return f"offs AS (SELECT * FROM (VALUES {rows}) t(distance, angle, dr, dc))"


@REG.add("glcm_features", with_ctes(GRIDS_CTE, _glcm_offsets_sql(), """
pairs AS (SELECT a.image_id, o.distance, o.angle, a.level AS i, q.level AS j
          FROM grids a CROSS JOIN offs o
          JOIN grids q ON q.image_id = a.image_id AND q.r = a.r + o.dr AND q.c = a.c + o.dc)""", """
mom AS (SELECT image_id, distance, angle, count(*) AS n,
               sum(CAST(i - j AS DOUBLE) * CAST(i - j AS DOUBLE)) AS s_con, sum(abs(CAST(i - j AS DOUBLE))) AS s_dis,
               sum(1.0 / (1.0 + CAST(i - j AS DOUBLE) * CAST(i - j AS DOUBLE))) AS s_hom,
               sum(i + j) AS s_ij, sum(i * i + j * j) AS s_sq, sum(i * j) AS s_x
        FROM pairs GROUP BY ALL)""", """
cells AS (SELECT image_id, distance, angle, least(i, j) AS a, greatest(i, j) AS bb, count(*) AS cnt
          FROM pairs GROUP BY ALL)""", """
asm AS (SELECT image_id, distance, angle,
               sum(CASE WHEN a = bb THEN cnt * cnt * CAST(4.0 AS DOUBLE) ELSE cnt * cnt * CAST(2.0 AS DOUBLE) END)
               AS asm_num FROM cells GROUP BY ALL)""", """
per AS (SELECT image_id, s_con / n AS contrast, s_hom / n AS homogeneity, s_dis / n AS dissimilarity,
               asm_num / ((2.0 * n) * (2.0 * n)) AS asm_v,
               s_ij / (2.0 * n) AS mu, s_sq / (2.0 * n) - (s_ij / (2.0 * n)) * (s_ij / (2.0 * n)) AS var,
               s_x / n - (s_ij / (2.0 * n)) * (s_ij / (2.0 * n)) AS cov
        FROM mom JOIN asm USING (image_id, distance, angle))""", body=f"""
SELECT image_id, {r6('avg(contrast)')} AS glcm_contrast, {r6('avg(homogeneity)')} AS glcm_homogeneity,
       {r6('avg(sqrt(asm_v))')} AS glcm_energy,
       {r6('avg(CASE WHEN sqrt(greatest(var, 0.0)) < 1e-15 THEN 1.0 ELSE cov / var END)')} AS glcm_correlation,
       {r6('avg(dissimilarity)')} AS glcm_dissimilarity, {r6('avg(asm_v)')} AS glcm_ASM
FROM per GROUP BY image_id"""))
def glcm_features(spark, d):
    return finish(ra.glcm_features(b.grids(spark, d)))


def _neighbours_sql(offsets_values: str, cols: str, border: str) -> list[str]:
    if border == "reflect101":
        def fix(x, n):
            return f"CASE WHEN {x} < 0 THEN -({x}) WHEN {x} >= {n} THEN 2 * ({n} - 1) - ({x}) ELSE {x} END"
    else:
        def fix(x, n):
            return f"least(greatest({x}, 0), {n} - 1)"
    return [
        "dims AS (SELECT image_id, max(r) + 1 AS h, max(c) + 1 AS w FROM grids GROUP BY image_id)",
        f"offs AS (SELECT * FROM (VALUES {offsets_values}) t({cols}))",
        f"""nb AS (SELECT t.image_id, t.r, t.c, o.*, {fix('t.r + o.dr', 'd.h')} AS sr, {fix('t.c + o.dc', 'd.w')} AS sc
                FROM grids t JOIN dims d USING (image_id) CROSS JOIN offs o)""",
        """nbv AS (SELECT nb.*, s.level AS v FROM nb JOIN grids s
                 ON s.image_id = nb.image_id AND s.r = nb.sr AND s.c = nb.sc)""",
    ]


def _sobel_values() -> str:
    wx = {(dr, dc): w for dr, dc, w in ra.SOBEL_X}
    wy = {(dr, dc): w for dr, dc, w in ra.SOBEL_Y}
    offs = sorted(set(wx) | set(wy))
    return ", ".join(f"({dr}, {dc}, {_f(wx.get((dr, dc), 0))}, {_f(wy.get((dr, dc), 0))})" for dr, dc in offs)


@REG.add("sobel_stats", with_ctes(GRIDS_CTE, *_neighbours_sql(_sobel_values(), "dr, dc, wx, wy", "reflect101"),
                                  "g AS (SELECT image_id, r, c, sum(wx * v) AS gx, sum(wy * v) AS gy FROM nbv GROUP BY ALL)",
                                  body=f"""
SELECT image_id, {r6('avg(sqrt(gx * gx + gy * gy))')} AS sobel_mean,
       {r6('stddev_pop(sqrt(gx * gx + gy * gy))')} AS sobel_std FROM g GROUP BY image_id"""))
def sobel_stats(spark, d):
    return finish(ra.sobel_stats(b.grids(spark, d)))


@REG.add("median_denoise", with_ctes(GRIDS_CTE, *_neighbours_sql(
    ", ".join(f"({dr}, {dc})" for dr in (-1, 0, 1) for dc in (-1, 0, 1)), "dr, dc", "replicate"), body="""
SELECT image_id, r, c, CAST(list_sort(list(v))[5] AS INTEGER) AS level FROM nbv GROUP BY image_id, r, c"""))
def median_denoise(spark, d):
    return ra.median_denoise(b.grids(spark, d))


@REG.add("area_resize", with_ctes(GRIDS_CTE, f"""
dims AS (SELECT image_id, max(r) + 1 AS h, max(c) + 1 AS w FROM grids GROUP BY image_id)""", f"""
j AS (SELECT g.image_id, g.r, g.c, CAST(g.level AS DOUBLE) AS v, d.h / {RESIZE_TO} AS sy, d.w / {RESIZE_TO} AS sx
      FROM grids g JOIN dims d USING (image_id))""", f"""
e AS (SELECT j.*, unnest(generate_series(CAST(floor(r / sy) AS INTEGER),
                                         CAST(least(ceil((r + 1) / sy) - 1, {RESIZE_TO - 1}) AS INTEGER))) AS RR FROM j)""",
    f"""
e2 AS (SELECT e.*, unnest(generate_series(CAST(floor(c / sx) AS INTEGER),
                                          CAST(least(ceil((c + 1) / sx) - 1, {RESIZE_TO - 1}) AS INTEGER))) AS CC FROM e)""",
    """
w AS (SELECT image_id, RR, CC, v,
             greatest(least(r + 1, (RR + 1) * sy) - greatest(r, RR * sy), 0.0)
           * greatest(least(c + 1, (CC + 1) * sx) - greatest(c, CC * sx), 0.0) AS wt FROM e2)""", body=f"""
SELECT image_id, CAST(RR AS INTEGER) AS r, CAST(CC AS INTEGER) AS c, {r6('sum(wt * v) / sum(wt)')} AS value
FROM w GROUP BY image_id, RR, CC"""))
def area_resize(spark, d):
    return finish(ra.area_resize(b.grids(spark, d), RESIZE_TO, RESIZE_TO))


@REG.add("mask_coverage", with_ctes(HEAT_MASK_CTE, body=f"""
SELECT image_id, {r6('avg(CAST(heat >= 0.5 AS DOUBLE))')} AS coverage FROM heat_mask GROUP BY image_id"""))
def mask_coverage(spark, d):
    return finish(ra.mask_coverage(b.heat_mask(spark, d)))


@REG.add("attention_concentration", with_ctes(HEAT_MASK_CTE, """
rk AS (SELECT image_id, heat, row_number() OVER (PARTITION BY image_id ORDER BY heat DESC) AS k,
              count(*) OVER (PARTITION BY image_id) AS n, sum(heat) OVER (PARTITION BY image_id) AS tot
       FROM heat_mask)""", body=f"""
SELECT image_id, {r6('CASE WHEN any_value(tot) <= 0 THEN 0.0 ELSE sum(CASE WHEN k <= greatest(1, floor(n * 0.1)) THEN heat ELSE 0.0 END) / any_value(tot) END')} AS concentration
FROM rk GROUP BY image_id"""))
def attention_concentration(spark, d):
    return finish(ra.attention_concentration(b.heat_mask(spark, d)))


@REG.add("heatmap_iou", with_ctes(HEAT_MASK_CTE, body=f"""
SELECT image_id, count(*) FILTER (WHERE heat >= 0.5 AND mask > 0.5) AS intersection,
       count(*) FILTER (WHERE heat >= 0.5 OR mask > 0.5) AS "union",
       {r6('CASE WHEN count(*) FILTER (WHERE heat >= 0.5 OR mask > 0.5) > 0 THEN count(*) FILTER (WHERE heat >= 0.5 AND mask > 0.5) / count(*) FILTER (WHERE heat >= 0.5 OR mask > 0.5) ELSE 0.0 END')} AS iou
FROM heat_mask WHERE has_mask GROUP BY image_id"""))
def heatmap_iou(spark, d):
    return finish(ra.heatmap_iou(b.heat_mask(spark, d)))


@REG.add("mean_iou", with_ctes(HEAT_MASK_CTE, """
per AS (SELECT image_id, count(*) FILTER (WHERE heat >= 0.5 AND mask > 0.5) AS i, count(*) FILTER (WHERE heat >= 0.5 OR mask > 0.5) AS u
        FROM heat_mask WHERE has_mask GROUP BY image_id)""", body=f"""
SELECT count(*) AS n_masked, {r6('avg(CASE WHEN u > 0 THEN i / u ELSE 0.0 END)')} AS mean_iou FROM per"""))
def mean_iou(spark, d):
    """R15 over all images with a mask."""
    return finish(ra.mean_iou(ra.heatmap_iou(b.heat_mask(spark, d))))


def _loss_frame(spark, d):
    hm = b.heat_mask(spark, d)
    return hm.select("image_id", "has_mask", (LOGIT_GAIN * (F.col("heat") - 0.5)).alias("logit"),
                     F.col("mask").cast("double").alias("target"))


LOSS_CTES = [f"""
lf AS (SELECT image_id, has_mask, {_f(LOGIT_GAIN)} * (heat - 0.5) AS x, CAST(mask AS DOUBLE) AS t FROM heat_mask)""", """
per AS (SELECT image_id, sum((1.0 / (1.0 + exp(-x))) * t) AS pt, sum(1.0 / (1.0 + exp(-x))) AS p, sum(t) AS tt,
               avg(greatest(x, 0.0) - x * t + ln(1 + exp(-abs(x)))) AS bce
        FROM lf WHERE has_mask GROUP BY image_id)""", """
agg AS (SELECT count(*) AS n_masked, avg(1.0 - (2.0 * pt + 1e-6) / (p + tt + 1e-6)) AS dice, avg(bce) AS bce FROM per)"""]


@REG.add("dice_bce", with_ctes(HEAT_MASK_CTE, *LOSS_CTES,
    body=f"""SELECT n_masked, {r6('coalesce(dice, 0.0)')} AS dice, {r6('coalesce(bce, 0.0)')} AS bce,
       {r6('coalesce(dice, 0.0) + coalesce(bce, 0.0)')} AS loss FROM agg"""))
def dice_bce(spark, d):
    return finish(ra.segmentation_losses(_loss_frame(spark, d), "logit", "target", "dice_bce"))


CLAHE_TILES_GRID = 2   # 8 x 8 grids -> 2 x 2 tiles of 4 x 4 pixels


_TILE = 8 // CLAHE_TILES_GRID


@REG.add("clahe_equalize", with_ctes(GRIDS_CTE, f"""
bins AS (SELECT image_id, ty, tx, level, coalesce(cnt, 0) AS cnt
  FROM (SELECT * FROM (SELECT DISTINCT image_id FROM grids), (SELECT unnest(range(0, {CLAHE_TILES_GRID})) AS ty), (SELECT unnest(range(0, {CLAHE_TILES_GRID})) AS tx), (SELECT unnest(range(0, 256)) AS level))
  LEFT JOIN (SELECT image_id, r // {_TILE} AS ty, c // {_TILE} AS tx, level, count(*) AS cnt FROM grids GROUP BY ALL) USING (image_id, ty, tx, level))""", f"""
clip AS (SELECT *, greatest(floor({_f(ra.CLAHE_CLIP)} * {_TILE * _TILE} / 256), 1)::BIGINT AS lim FROM bins)""", """
over AS (SELECT *, sum(greatest(cnt - lim, 0)) OVER (PARTITION BY image_id, ty, tx)::BIGINT AS excess FROM clip)""", """
spread AS (SELECT *, least(cnt, lim) + excess // 256 + CASE WHEN excess % 256 > 0 AND level % greatest(256 // greatest(excess % 256, 1), 1) = 0
    AND level // greatest(256 // greatest(excess % 256, 1), 1) < excess % 256 THEN 1 ELSE 0 END AS n FROM over)""", f"""
lut AS (SELECT image_id, ty, tx, level, least(greatest(round_even(sum(n) OVER (PARTITION BY image_id, ty, tx ORDER BY level) * (CAST(255.0 AS DOUBLE) / {_TILE * _TILE}), 0), 0.0), 255.0) AS v FROM spread)""", f"""
at_ AS (SELECT image_id, r, c, level, floor(r / {_f(_TILE)} - 0.5)::INTEGER AS y, r / {_f(_TILE)} - 0.5 - floor(r / {_f(_TILE)} - 0.5) AS ya,
    floor(c / {_f(_TILE)} - 0.5)::INTEGER AS x, c / {_f(_TILE)} - 0.5 - floor(c / {_f(_TILE)} - 0.5) AS xa FROM grids)""", body=f"""
SELECT p.image_id, p.r, p.c, least(greatest(round_even((l11.v * (1 - xa) + l12.v * xa) * (1 - ya) + (l21.v * (1 - xa) + l22.v * xa) * ya, 0), 0.0), 255.0)::INTEGER AS level
FROM at_ p
JOIN lut l11 ON l11.image_id = p.image_id AND l11.level = p.level AND l11.ty = greatest(y, 0) AND l11.tx = greatest(x, 0)
JOIN lut l12 ON l12.image_id = p.image_id AND l12.level = p.level AND l12.ty = greatest(y, 0) AND l12.tx = least(x + 1, {CLAHE_TILES_GRID - 1})
JOIN lut l21 ON l21.image_id = p.image_id AND l21.level = p.level AND l21.ty = least(y + 1, {CLAHE_TILES_GRID - 1}) AND l21.tx = greatest(x, 0)
JOIN lut l22 ON l22.image_id = p.image_id AND l22.level = p.level AND l22.ty = least(y + 1, {CLAHE_TILES_GRID - 1}) AND l22.tx = least(x + 1, {CLAHE_TILES_GRID - 1})"""))
def clahe_equalize(spark, d):
    """R4 on every grid (clip 2.0, 2 x 2 tiles); rows-only check, range and
    shape invariants in tests."""
    return ra.clahe(b.grids(spark, d), ra.CLAHE_CLIP, CLAHE_TILES_GRID)


@REG.add("minmax_rescale", with_ctes(GRIDS_CTE, """
mm AS (SELECT image_id, min(level) AS mn, max(level) AS mx FROM grids GROUP BY image_id)""", body="""
SELECT g.image_id, g.r, g.c,
       CAST(CASE WHEN mm.mx = mm.mn THEN 0 ELSE floor((g.level - mm.mn)::DOUBLE / (mm.mx - mm.mn)::DOUBLE * 255.0::DOUBLE) END AS INTEGER) AS value
FROM grids g JOIN mm USING (image_id)"""))
def minmax_rescale(spark, d):
    """R3 on the grids (as if they were not already 8-bit)."""
    g = b.grids(spark, d).withColumn("value", F.col("level").cast("double"))
    return finish(ra.minmax_rescale(g, "value"))


@REG.add("mask_binarize", with_ctes(GRIDS_CTE, body="""
SELECT image_id, r, c, CAST(level > 127 AS INTEGER) AS mask FROM grids"""))
def mask_binarize(spark, d):
    """V > 127 -> 1."""
    return ra.binarize_mask(b.grids(spark, d)).select("image_id", "r", "c", "mask")


# neighbours across the gradient: beside it, above and below it, or on the diagonal that it points along
_EDGE_SQL = with_ctes("RECURSIVE " + GRIDS_CTE, *_neighbours_sql(_sobel_values(), "dr, dc, wx, wy", "replicate"), """
gr AS (SELECT image_id, r, c, CAST(sum(wx * v) AS BIGINT) AS gx, CAST(sum(wy * v) AS BIGINT) AS gy FROM nbv GROUP BY ALL)""", """
mg AS (SELECT *, abs(gx) + abs(gy) AS m FROM gr)""", f"""
way AS (SELECT *, CASE WHEN abs(gy) * 32768 < abs(gx) * {ra.TAN_22_Q15} THEN 'h'
                       WHEN abs(gy) * 32768 > abs(gx) * {ra.TAN_22_Q15 + 65536} THEN 'v'
                       WHEN (gx < 0) <> (gy < 0) THEN 'f' ELSE 'd' END AS k FROM mg)""", """
step AS (SELECT *, CASE k WHEN 'h' THEN 0 ELSE 1 END AS sr, CASE k WHEN 'v' THEN 0 WHEN 'f' THEN -1 ELSE 1 END AS sc FROM way)""", """
weak AS (SELECT s.image_id, s.r, s.c, s.m FROM step s
         LEFT JOIN mg a ON a.image_id = s.image_id AND a.r = s.r - s.sr AND a.c = s.c - s.sc
         LEFT JOIN mg z ON z.image_id = s.image_id AND z.r = s.r + s.sr AND z.c = s.c + s.sc
         WHERE s.m > 100 AND s.m > coalesce(a.m, 0) AND (s.m > coalesce(z.m, 0) OR k IN ('h', 'v') AND s.m = coalesce(z.m, 0)))""", """
edge AS (SELECT image_id, r, c FROM weak WHERE m > 200
         UNION SELECT w.image_id, w.r, w.c FROM edge e JOIN weak w
               ON w.image_id = e.image_id AND abs(w.r - e.r) <= 1 AND abs(w.c - e.c) <= 1)""", body=f"""
SELECT d.image_id, {r6('count(e.image_id) / any_value(d.h * d.w)::DOUBLE')} AS canny_edge_density
FROM dims d LEFT JOIN edge e USING (image_id) GROUP BY d.image_id""")


@REG.add("edge_density", _EDGE_SQL)
def edge_density(spark, d):
    """R9 on every grid."""
    return finish(ra.edge_density(b.grids(spark, d)))


@REG.add("texture_row", f"""
SELECT * FROM ({REG.oracles["glcm_features"]}) JOIN ({_EDGE_SQL}) USING (image_id) JOIN ({REG.oracles["sobel_stats"]}) USING (image_id)""")
def texture_row(spark, d):
    """The nine texture values per image."""
    return finish(ra.texture_row(b.grids(spark, d)))


@REG.add("joint_loss", with_ctes(HEAT_MASK_CTE, *LOSS_CTES, f"""
ci AS (SELECT image_id, {_f(LOGIT_GAIN)} * (avg(heat) - 0.5) AS x FROM heat_mask GROUP BY image_id)""", """
cl AS (SELECT avg(greatest(x, 0.0) - x * (true_label % 2) + ln(1 + exp(-abs(x)))) AS classification
       FROM ci JOIN vectors ON vec_id = image_id)""", body=f"""
SELECT {r6('classification + 0.5 * (coalesce(dice, 0.0) + coalesce(bce, 0.0))')} AS total, {r6('classification')} AS classification,
       {r6('coalesce(dice, 0.0) + coalesce(bce, 0.0)')} AS lesion_guidance FROM cl, agg"""))
def joint_loss(spark, d):
    """Class BCE (image logit = 8 * (mean heat - 0.5), label = label of the
    embedding is odd) + 0.5 * Dice/BCE lesion loss."""
    hm = b.heat_mask(spark, d)
    cls = hm.groupBy("image_id").agg((LOGIT_GAIN * (F.avg("heat") - 0.5)).alias("class_logit")).join(
        b.vectors(spark, d).select(F.col("vec_id").alias("image_id"), (F.col("true_label") % 2).alias("label")),
        "image_id")
    seg = ra.segmentation_losses(_loss_frame(spark, d), "logit", "target", "dice_bce")
    return finish(ra.joint_loss(cls, seg, 0.5))
