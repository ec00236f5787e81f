"""Raster-grid operators on pixel tables ``(image_id, r, c, level)``.

Per-image library calls become relational jobs: a histogram is a ``groupBy``, a
top fraction is a rank inside one image (bounded by the image's resolution,
never by the data size).  Neighbourhoods work on ``strips``: some rows of an
image as arrays, with a halo of the rows around them, gathered in one shuffle;
the neighbours of a pixel are then places in the arrays, so nothing is joined
and a large image is many rows.  All grouping is keyed by ``image_id`` first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values (OpenCV / scikit-image conventions the reference relies on).
GRAY_WEIGHTS_Q14 = (1868, 9617, 4899)  # B, G, R weights of 0.114, 0.587, 0.299 in 14-bit fixed point
SOBEL_X = [(-1, -1, -1), (0, -1, -2), (1, -1, -1), (-1, 1, 1), (0, 1, 2), (1, 1, 1)]   # (dr, dc, w)
SOBEL_Y = [(-1, -1, -1), (-1, 0, -2), (-1, 1, -1), (1, -1, 1), (1, 0, 2), (1, 1, 1)]
GLCM_DISTANCES = (1, 3)
GLCM_ANGLES_DEG = (0, 45, 90, 135)
TAN_22_Q15 = 13573  # tan(22.5 degrees) in 15-bit fixed point
HIST_BINS = 32
EPS_DICE = 1e-6


def glcm_offsets() -> list[tuple[int, int, int, int]]:
    """(distance, angle, dr, dc): dr = round(sin(a) * d), dc = round(cos(a) * d)."""
    out = []
    for d in GLCM_DISTANCES:
        for a in GLCM_ANGLES_DEG:
            rad = math.radians(a)
            dr = int(math.floor(abs(math.sin(rad) * d) + 0.5)) * (1 if math.sin(rad) >= 0 else -1)
            dc_raw = math.cos(rad) * d
            dc = int(math.floor(abs(dc_raw) + 0.5)) * (1 if dc_raw >= 0 else -1)
            out.append((d, a, dr, dc))
    return out


def dims(px: DataFrame) -> DataFrame:
    """(image_id, h, w) from the pixel table."""
    return px.groupBy("image_id").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))


#: Rows of an image that make a strip.
STRIP = 64


def strips(px: DataFrame, halo: int, value: str = "level") -> DataFrame:
    """(image_id, first, own, w, top, lines): ``own`` rows of an image from row ``first`` on, each an array
    of doubles; ``lines`` also has the up to ``halo`` rows around them and begins with row ``top``.

    Images have all their pixels.  A strip is bounded by the image's width.
    """
    of = F.explode(F.sequence(F.greatest(F.floor((F.col("r") - halo) / STRIP), F.lit(0)), F.floor((F.col("r") + halo) / STRIP)))
    dealt = px.select("image_id", "r", "c", F.col(value).cast("double").alias("v"), of.alias("strip"))
    held = dealt.groupBy("image_id", "strip").agg(F.sort_array(F.collect_list(F.struct("r", "c", "v"))).alias("p"), (F.max("c") + 1).alias("w"),
                                                  F.min("r").alias("top"), F.max("r").alias("bottom"))
    first = (F.col("strip") * STRIP).cast("int")
    own = F.least(first + STRIP - 1, F.col("bottom")) - first + 1
    lines = F.transform(F.sequence(F.lit(0), F.col("bottom") - F.col("top")), lambda i: F.transform(F.slice("p", i * F.col("w") + 1, F.col("w")), lambda x: x["v"]))
    return held.where(F.col("bottom") >= first).select("image_id", first.alias("first"), own.alias("own"), "w", "top", "bottom", lines.alias("lines"))


def _mirrored(at, last):
    """OpenCV BORDER_REFLECT_101: -1 -> 1, last + 1 -> last - 1; a side of one stays."""
    back = F.when(at < 0, -at).when(at > last, 2 * last - at).otherwise(at)
    return F.least(F.greatest(back, F.lit(0)), last)


def _repeated(at, last):
    return F.least(F.greatest(at, F.lit(0)), last)


def neighbourhoods(px: DataFrame, of_pixel, border=_mirrored, halo: int = 1, value: str = "level") -> DataFrame:
    """(image_id, r, c, out): ``of_pixel(at)`` for every pixel, where ``at(dr, dc)`` is a neighbour's value."""
    held = strips(px, halo, value)
    # the border is laid around the strip, so that every neighbour is there
    line = lambda r: F.col("lines")[(F.greatest(F.least(border(r, F.col("bottom")), F.col("bottom")), F.col("top")) - F.col("top")).cast("int")]
    wide = lambda row: F.transform(F.sequence(F.lit(-halo), F.col("w") - 1 + halo), lambda c: row[border(c, F.col("w") - 1).cast("int")])
    held = held.withColumn("m", F.transform(F.sequence(F.col("first") - halo, F.col("first") + F.col("own") - 1 + halo), lambda r: wide(line(r))))
    made = F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda i: F.transform(
        F.sequence(F.lit(0), F.col("w") - 1), lambda c: of_pixel(lambda dr, dc: F.col("m")[(i + halo + dr).cast("int")][(c + halo + dc).cast("int")])))
    rows = held.select("image_id", "first", F.posexplode(made).alias("i", "line"))
    return rows.select("image_id", (F.col("first") + F.col("i")).alias("r"), F.posexplode("line").alias("c", "out"))


def grayscale(bgr: DataFrame) -> DataFrame:
    """(image_id, r, c, b, g, r_) -> level, fixed-point BGR weights with rounding."""
    wb, wg, wr = GRAY_WEIGHTS_Q14
    y = F.shiftright(F.col("b") * wb + F.col("g") * wg + F.col("r_") * wr + 8192, 14)
    return bgr.select("image_id", "r", "c", y.cast("int").alias("level"))


def sobel_magnitude(px: DataFrame) -> DataFrame:
    """Per pixel Sobel gx, gy (3x3, reflect-101 border) and magnitude."""
    def of_pixel(at):
        gx, gy = (sum((float(w) * at(dr, dc) for dr, dc, w in kernel[1:]), float(kernel[0][2]) * at(*kernel[0][:2])) for kernel in (SOBEL_X, SOBEL_Y))
        return F.struct(gx.alias("gx"), gy.alias("gy"))
    g = neighbourhoods(px, of_pixel).select("image_id", "r", "c", "out.gx", "out.gy")
    return g.withColumn("mag", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))


def sobel_stats(px: DataFrame) -> DataFrame:
    """(image_id, sobel_mean, sobel_std) -- population std."""
    return sobel_magnitude(px).groupBy("image_id").agg(
        F.avg("mag").alias("sobel_mean"), F.stddev_pop("mag").alias("sobel_std"))


AROUND = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1)]


def median_denoise(px: DataFrame) -> DataFrame:
    """R5 median 3x3 (replicated border): the 5th of the 9 sorted neighbours."""
    middle = lambda at: F.element_at(F.array_sort(F.array(*[at(dr, dc) for dr, dc in AROUND])), 5)
    return neighbourhoods(px, middle, _repeated).select("image_id", "r", "c", F.col("out").cast("int").alias("level"))


def gaussian_denoise(px: DataFrame) -> DataFrame:
    """R5 Gaussian 3x3 (kernel [1,2,1] x [1,2,1] / 16, reflect-101 border)."""
    blurred = lambda at: sum((at(dr, dc) * ((2 - abs(dr)) * (2 - abs(dc)) / 16.0) for dr, dc in AROUND), F.lit(0.0))
    return neighbourhoods(px, blurred).select("image_id", "r", "c", F.col("out").alias("value"))


#: R5 by name.
DENOISERS = {"median": median_denoise, "gaussian": gaussian_denoise}


def denoise(px: DataFrame, method: str = "median") -> DataFrame:
    if method not in DENOISERS:
        raise KeyError(f"denoiser {method!r}: one of {sorted(DENOISERS)}")
    return DENOISERS[method](px)


def area_resize(px: DataFrame, out_h: int, out_w: int, value: str = "level") -> DataFrame:
    """R2: area-weighted average resize (down-scaling); each output pixel is the
    overlap-weighted mean of the source pixels its footprint covers."""
    d = dims(px)
    j = px.join(d, "image_id").select(
        "image_id", "r", "c", F.col(value).cast("double").alias("v"),
        (F.col("h") / out_h).alias("sy"), (F.col("w") / out_w).alias("sx"))

    def spans(pos, scale, n_out):
        lo = F.floor(pos / scale)
        hi = F.least(F.ceil((pos + 1) / scale) - 1, F.lit(n_out - 1))
        return F.sequence(lo.cast("int"), hi.cast("int"))

    def overlap(pos, out_idx, scale):
        return F.greatest(F.least(pos + 1, (out_idx + 1) * scale) - F.greatest(pos, out_idx * scale), F.lit(0.0))

    e = j.select("*", F.explode(spans(F.col("r"), F.col("sy"), out_h)).alias("_oR")) \
         .select("*", F.explode(spans(F.col("c"), F.col("sx"), out_w)).alias("_oC"))
    wgt = overlap(F.col("r"), F.col("_oR"), F.col("sy")) * overlap(F.col("c"), F.col("_oC"), F.col("sx"))
    return e.groupBy("image_id", F.col("_oR").alias("r"), F.col("_oC").alias("c")).agg(
        (F.sum(wgt * F.col("v")) / F.sum(wgt)).alias("value"))


def nearest_resize(px: DataFrame, out_h: int, out_w: int, value: str = "level") -> DataFrame:
    """R2 (masks): nearest neighbour, source index floor(out_idx * in / out)."""
    d = dims(px)
    out = d.select("image_id", "h", "w", F.explode(F.sequence(F.lit(0), F.lit(out_h - 1))).alias("_oR")) \
           .select("*", F.explode(F.sequence(F.lit(0), F.lit(out_w - 1))).alias("_oC"))
    src_r = F.least(F.floor(F.col("_oR") * F.col("h") / out_h), F.col("h") - 1).cast("int")
    src_c = F.least(F.floor(F.col("_oC") * F.col("w") / out_w), F.col("w") - 1).cast("int")
    out = out.select("image_id", "_oR", "_oC", src_r.alias("r"), src_c.alias("c"))
    return out.join(px, ["image_id", "r", "c"]).select("image_id", F.col("_oR").alias("r"), F.col("_oC").alias("c"),
                                                        F.col(value).alias(value))


def minmax_rescale(px: DataFrame, value: str = "value", invert: bool = False) -> DataFrame:
    """(v - min) / (max - min) * 255 per image, truncated to 8 bits (0 when flat); optional inversion max - v."""
    st = px.groupBy("image_id").agg(F.min(value).alias("_mn"), F.max(value).alias("_mx"))
    j = px.join(st, "image_id")
    above = (F.col("_mx") - F.col(value)) if invert else (F.col(value) - F.col("_mn"))
    span = F.col("_mx") - F.col("_mn")
    scaled = F.when(span == 0, F.lit(0)).otherwise(F.floor(above / span * 255.0).cast("int"))
    return j.select("image_id", "r", "c", scaled.alias("value"))


def unit_scale(px: DataFrame, value: str = "level") -> DataFrame:
    """V / 255."""
    return px.withColumn("value", F.col(value) / 255.0)


def binarize_mask(px: DataFrame, value: str = "level", threshold: float = 127) -> DataFrame:
    """V > 127 -> 1 else 0."""
    return px.withColumn("mask", (F.col(value) > threshold).cast("int"))


def intensity_histogram(px: DataFrame, value: str = "level", bins: int = HIST_BINS) -> DataFrame:
    """Dense 32-bin histogram over [0, 255] (last bin closed) per image:
    (image_id, bin, center, count)."""
    width = 255.0 / bins
    b = F.least(F.floor(F.col(value) * float(bins) / 255.0), F.lit(bins - 1)).cast("int")
    counts = px.groupBy("image_id", b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    dense = px.select("image_id").distinct().select(
        "image_id", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = dense.join(counts, ["image_id", "bin"], "left")
    return out.select("image_id", "bin", F.bround((F.col("bin") + 0.5) * width, 1).alias("center"),
                      F.coalesce("count", F.lit(0)).alias("count"))


def intensity_moments(px: DataFrame, value: str = "level") -> DataFrame:
    """Per-image mean and population std of the 8-bit values."""
    return px.groupBy("image_id").agg(F.avg(value).alias("mean_intensity"),
                                      F.stddev_pop(value).alias("std_intensity"))


def glcm_cells(px: DataFrame) -> DataFrame:
    """(image_id, distance, angle, a, b, cnt): how often two levels a <= b lie at each of the 8 offsets.

    Pairs are places in the strips' arrays and are counted where they are made."""
    offsets = glcm_offsets()
    held = strips(px, max(dr for *_, dr, _ in offsets))

    none = F.array().cast("array<struct<k: int, i: int, j: int>>")

    def pairs(here, k, dr, dc):
        """Of the line ``here`` at one offset, where that stays in the image."""
        level = lambda r, c: F.col("lines")[r.cast("int")][c.cast("int")].cast("int")
        first = F.lit(max(0, -dc))
        made = F.transform(F.sequence(first, F.greatest(F.col("w") - 1 - max(0, dc), first)), lambda c: F.struct(F.lit(k).alias("k"), level(here, c).alias("i"), level(here + dr, c + dc).alias("j")))
        return F.when((here + dr < F.size("lines")) & (F.col("w") > abs(dc)), made).otherwise(none)
    rows = held.select("image_id", "first", "top", "w", "lines", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("i"))
    here = F.col("first") - F.col("top") + F.col("i")
    each = rows.select("image_id", F.explode(F.concat(*[pairs(here, k, dr, dc) for k, (_, _, dr, dc) in enumerate(offsets)])).alias("p"))
    at = F.array(*[F.struct(F.lit(d).alias("distance"), F.lit(a).alias("angle")) for d, a, _, _ in offsets])
    counts = each.groupBy("image_id", "p.k", F.least("p.i", "p.j").alias("a"), F.greatest("p.i", "p.j").alias("b")).agg(F.count(F.lit(1)).alias("cnt"))
    return counts.select("image_id", at[F.col("k")]["distance"].alias("distance"), at[F.col("k")]["angle"].alias("angle"), "a", "b", "cnt")


def glcm_features(px: DataFrame) -> DataFrame:
    """Symmetric, normalised GLCM properties averaged over the 8 offsets:
    contrast, homogeneity, energy, correlation, dissimilarity, ASM."""
    keys = ["image_id", "distance", "angle"]
    a, b, cnt = F.col("a"), F.col("b"), F.col("cnt")
    dd = (a - b).cast("double")
    # symmetric matrix: off-diagonal cells appear twice with cnt / 2n, diagonal once with 2cnt / 2n
    mom = glcm_cells(px).groupBy(*keys).agg(
        F.sum(cnt).alias("n"), F.sum(cnt * dd * dd).alias("s_con"), F.sum(cnt * F.abs(dd)).alias("s_dis"), F.sum(cnt / (1.0 + dd * dd)).alias("s_hom"),
        F.sum(cnt * (a + b)).alias("s_ij"), F.sum(cnt * (a * a + b * b)).alias("s_sq"), F.sum(cnt * a * b).alias("s_x"),
        F.sum(F.when(a == b, cnt * cnt * 4.0).otherwise(cnt * cnt * 2.0)).alias("_asm_num"))
    n2 = 2.0 * F.col("n")
    mu = F.col("s_ij") / n2
    var = F.col("s_sq") / n2 - mu * mu
    cov = F.col("s_x") / F.col("n") - mu * mu
    per = mom.select(
        "image_id",
        (F.col("s_con") / F.col("n")).alias("contrast"),
        (F.col("s_hom") / F.col("n")).alias("homogeneity"),
        (F.col("s_dis") / F.col("n")).alias("dissimilarity"),
        (F.col("_asm_num") / (n2 * n2)).alias("ASM"),
        F.when(F.sqrt(F.greatest(var, F.lit(0.0))) < 1e-15, F.lit(1.0)).otherwise(cov / var).alias("correlation"))
    per = per.withColumn("energy", F.sqrt("ASM"))
    props = ["contrast", "homogeneity", "energy", "correlation", "dissimilarity", "ASM"]
    return per.groupBy("image_id").agg(*[F.avg(p).alias(f"glcm_{p}") for p in props])


def _edges(grid: np.ndarray, low: float, high: float) -> np.ndarray:
    """Edge pixels of one image: 3x3 gradients with replicated borders, L1 magnitude, thinning
    across the gradient, then weak pixels (> low) that touch strong ones (> high) in a chain."""
    p = np.pad(grid, 1, mode="edge")
    down, right = p[:-2] + 2 * p[1:-1] + p[2:], p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    gx, gy = down[:, 2:] - down[:, :-2], right[2:] - right[:-2]
    mag = np.abs(gx) + np.abs(gy)
    around = np.pad(mag, 1)
    at = lambda dr, dc: around[1 + dr: 1 + dr + mag.shape[0], 1 + dc: 1 + dc + mag.shape[1]]
    ax, ay = np.abs(gx), np.abs(gy) << 15
    flat = ay < ax * TAN_22_Q15
    steep = ay > ax * (TAN_22_Q15 + (1 << 16))
    falling = (gx < 0) != (gy < 0)
    slant = np.where(falling, (mag > at(-1, 1)) & (mag > at(1, -1)), (mag > at(-1, -1)) & (mag > at(1, 1)))
    crest = np.where(flat, (mag > at(0, -1)) & (mag >= at(0, 1)), np.where(steep, (mag > at(-1, 0)) & (mag >= at(1, 0)), slant))
    weak = crest & (mag > low)
    out = weak & (mag > high)
    while True:
        near = np.pad(out, 1)
        near = near[:-2] | near[1:-1] | near[2:]
        grown = weak & (near[:, :-2] | near[:, 1:-1] | near[:, 2:])
        if (grown == out).all():
            return out
        out = grown


def edge_density(px: DataFrame, low: float = 100, high: float = 200) -> DataFrame:
    """Share of edge pixels per image: (image_id, canny_edge_density).

    Following weak edges from pixel to pixel is a loop over one image, so an image (bounded by its
    resolution) is one group; images are spread by the shuffle."""
    def share(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((pdf["r"].max() + 1, pdf["c"].max() + 1), np.int64)
        grid[pdf["r"], pdf["c"]] = pdf["level"]
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[:1], "canny_edge_density": _edges(grid, low, high).mean()})

    kind = px.schema["image_id"].dataType.simpleString()
    return px.select("image_id", "r", "c", "level").groupBy("image_id").applyInPandas(share, f"image_id {kind}, canny_edge_density double")


def texture_row(px: DataFrame) -> DataFrame:
    """The nine texture values, keyed by image: GLCM properties, edge density, Sobel statistics."""
    return glcm_features(px).join(edge_density(px), "image_id").join(sobel_stats(px), "image_id")


def mask_coverage(heat: DataFrame, value: str = "heat", threshold: float = 0.5) -> DataFrame:
    """Share of pixels with value >= threshold, per image."""
    return heat.groupBy("image_id").agg(F.avg((F.col(value) >= threshold).cast("double")).alias("coverage"))


def attention_concentration(heat: DataFrame, value: str = "heat", top_fraction: float = 0.1) -> DataFrame:
    """Share of the total in the hottest max(1, floor(n * f)) pixels;
    0 when the total is <= 0.  The rank runs inside one image."""
    w = Window.partitionBy("image_id").orderBy(F.col(value).desc())
    tot = heat.groupBy("image_id").agg(F.sum(value).alias("_tot"), F.count(F.lit(1)).alias("_n"))
    ranked = heat.join(tot, "image_id").withColumn("_rk", F.row_number().over(w))
    k = F.greatest(F.lit(1), F.floor(F.col("_n") * top_fraction))
    agg = ranked.groupBy("image_id").agg(
        F.sum(F.when(F.col("_rk") <= k, F.col(value)).otherwise(0.0)).alias("_top"), F.first("_tot").alias("_tot"))
    return agg.select("image_id", F.when(F.col("_tot") <= 0, F.lit(0.0))
                      .otherwise(F.col("_top") / F.col("_tot")).alias("concentration"))


def heatmap_iou(hm: DataFrame, heat: str = "heat", mask: str = "mask", threshold: float = 0.5) -> DataFrame:
    """IoU of (heat >= t) and (mask > 0.5) per image with a mask; 0 when the
    union is empty."""
    h, m = F.col(heat) >= threshold, F.col(mask) > 0.5
    agg = hm.where(F.col("has_mask")).groupBy("image_id").agg(
        F.count_if(h & m).alias("intersection"), F.count_if(h | m).alias("union"))
    return agg.withColumn("iou", F.when(F.col("union") > 0, F.col("intersection") / F.col("union")).otherwise(0.0))


def mean_iou(iou: DataFrame) -> DataFrame:
    """One row (n_masked, mean_iou) over the images with a mask; NULL mean without one."""
    return iou.agg(F.count(F.lit(1)).alias("n_masked"), F.avg("iou").alias("mean_iou"))


#: What the segmentation loss of a mode adds up.
LOSS_PARTS = {"dice": ("dice",), "bce": ("bce",), "dice_bce": ("dice", "bce")}


def segmentation_losses(px: DataFrame, logit: str = "logit", target: str = "target",
                        mode: str = "dice_bce") -> DataFrame:
    """Per-image Dice loss 1 - (2 sum pt + eps) / (sum p + sum t + eps) with
    p = sigmoid(logit), and mean pixel BCE-with-logits; averaged over images
    with a mask only, exactly 0 when no image has one.  One row:
    (n_masked, dice, bce, loss)."""
    summed = LOSS_PARTS.get(mode)
    if summed is None:
        raise KeyError(f"segmentation loss {mode!r}: one of {sorted(LOSS_PARTS)}")
    x, t = F.col(logit), F.col(target)
    p = 1.0 / (1.0 + F.exp(-x))
    bce = F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x)))
    per = px.where(F.col("has_mask")).groupBy("image_id").agg(
        F.sum(p * t).alias("_pt"), F.sum(p).alias("_p"), F.sum(t).alias("_t"), F.avg(bce).alias("_bce"))
    per = per.select(
        (1.0 - (2.0 * F.col("_pt") + EPS_DICE) / (F.col("_p") + F.col("_t") + EPS_DICE)).alias("_dice"), "_bce")
    agg = per.agg(F.count(F.lit(1)).alias("n_masked"), F.avg("_dice").alias("dice"), F.avg("_bce").alias("bce"))
    per_part = agg.select("n_masked", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("dice", "bce")])
    return per_part.withColumn("loss", sum((F.col(c) for c in summed[1:]), F.col(summed[0])))


def joint_loss(class_df: DataFrame, seg: DataFrame, weight: float = 0.5,
               logit: str = "class_logit", label: str = "label") -> DataFrame:
    """Mean classification BCE + weight * segmentation loss (weight 0 ->
    classification only)."""
    x, y = F.col(logit), F.col(label).cast("double")
    cls = class_df.agg(F.avg(F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))).alias("classification"))
    j = cls.crossJoin(seg.select(F.col("loss").alias("lesion_guidance")))
    lg = F.col("lesion_guidance") if weight > 0 else F.lit(0.0)
    return j.select((F.col("classification") + weight * lg).alias("total"), "classification",
                    lg.alias("lesion_guidance"))


# ------------------------------------------------------------------ R4 CLAHE

CLAHE_CLIP = 2.0
CLAHE_TILES = 8
LEVELS = 256


def _tables(clip_limit: float, tiles: int):
    """The look-up tables of an image's tiles in order, from the counts of (tile, level) bins."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = tiles * tiles * LEVELS
        level = np.arange(LEVELS)
        for b in (whole.slice(i, step) for step in (max(1, 4_000_000 // wide),) for whole in batches for i in range(0, whole.num_rows, step)):
            bins, cnt = b.column("bin"), b.column("cnt")
            count = np.zeros(b.num_rows * wide, np.int64)
            image = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(bins), 0).to_numpy(zero_copy_only=False))
            count[image * wide + bins.flatten().to_numpy()] = cnt.flatten().to_numpy()
            count = count.reshape(b.num_rows, tiles * tiles, LEVELS)
            total = (b.column("th").to_numpy().astype(np.int64) * b.column("tw").to_numpy())[:, None, None]
            limit = np.maximum(np.floor(clip_limit * total / LEVELS), 1).astype(np.int64)
            clipped = np.maximum(count - limit, 0).sum(axis=2, keepdims=True)
            batch, resid = clipped // LEVELS, clipped % LEVELS
            step = np.maximum(LEVELS // np.maximum(resid, 1), 1)
            extra = (resid > 0) & (level % step == 0) & (level // step < resid)
            cdf = (np.minimum(count, limit) + batch + extra).cumsum(axis=2)
            lut = np.clip(np.rint(cdf * (255.0 / total)), 0, 255).astype(np.int16).ravel()
            offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * wide)
            yield pa.RecordBatch.from_arrays([b.column("image_id"), b.column("th"), b.column("tw"), pa.ListArray.from_arrays(offsets, pa.array(lut))], names=["image_id", "th", "tw", "lut"])
    return run


def clahe(px: DataFrame, clip_limit: float = CLAHE_CLIP, tiles: int = CLAHE_TILES) -> DataFrame:
    """Contrast-limited adaptive histogram equalisation of 8-bit images
    whose sides are multiples of ``tiles``.

    Per tile: dense 256-bin histogram, bins clipped at
    max(int(clip * tile_pixels / 256), 1), the clipped excess spread evenly
    (remainder one count every 256 // residual bins), cumulative LUT
    round(cdf * 255 / tile_pixels); each pixel blends the LUTs of its four
    nearest tile centres bilinearly.  Only bins that occur travel; the tables, of
    small integers, meet an image's strips, not its pixels.
    """
    d = dims(px)
    # sides that are no multiple of the tiles are mirrored beyond their end for the histograms
    odd = (F.col("h") % tiles != 0) | (F.col("w") % tiles != 0)
    more = lambda side: F.when(odd, F.lit(tiles) - F.col(side) % tiles).otherwise(F.lit(0))
    sized = d.select("image_id", "h", "w", ((F.col("h") + more("h")) / tiles).cast("int").alias("th"), ((F.col("w") + more("w")) / tiles).cast("int").alias("tw"))
    p = px.select("image_id", "r", "c", "level").join(sized, "image_id")

    def places(at, side, tile):
        beyond = 2 * (F.col(side) - 1) - F.col(at)
        return F.when((beyond >= F.col(side)) & (beyond < F.col(tile) * tiles), F.array(F.col(at), beyond)).otherwise(F.array(F.col(at)))
    laid = p.select("image_id", "level", "c", "w", "th", "tw", F.explode(places("r", "h", "th")).alias("rr")).select(
        "image_id", "level", "th", "tw", "rr", F.explode(places("c", "w", "tw")).alias("cc"))
    ty, tx = ((F.col(at) / F.col(t)).cast("int") for at, t in (("rr", "th"), ("cc", "tw")))
    hist = laid.where(F.col("level").between(0, LEVELS - 1)).groupBy("image_id", ((ty * tiles + tx) * LEVELS + F.col("level")).alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))
    # one row per image: the counts of its tiles' bins that occur; a task makes the table of all its tiles, tiles x tiles x 256 values, of them
    kind = px.schema["image_id"].dataType.simpleString()
    counts = hist.groupBy("image_id").agg(F.collect_list("bin").alias("bin"), F.collect_list("cnt").alias("cnt"))
    luts = sized.join(counts, "image_id", "left").select("image_id", "th", "tw", "bin", "cnt").mapInArrow(_tables(clip_limit, tiles), f"image_id {kind}, th int, tw int, lut array<smallint>")
    held = strips(px, 0).join(luts, "image_id")

    def between(at, tile):
        """The tiles whose centres lie around a place, and how far it is from the first."""
        x = at / F.col(tile) - 0.5
        low = F.floor(x).cast("int")
        return F.greatest(low, F.lit(0)), F.least(low + 1, F.lit(tiles - 1)), x - F.floor(x)

    def blended(r, c, level):
        y1, y2, ya = between(r, "th")
        x1, x2, xa = between(c, "tw")
        at = lambda y, x: F.col("lut")[((y * tiles + x) * LEVELS + level).cast("int")]
        val = (at(y1, x1) * (1 - xa) + at(y1, x2) * xa) * (1 - ya) + (at(y2, x1) * (1 - xa) + at(y2, x2) * xa) * ya
        return F.least(F.greatest(F.bround(val, 0), F.lit(0.0)), F.lit(255.0)).cast("int")
    made = F.transform("lines", lambda line, i: F.transform(line, lambda v, c: blended(F.col("first") + i, c, v)))
    rows = held.select("image_id", "first", F.posexplode(made).alias("i", "line"))
    return rows.select("image_id", (F.col("first") + F.col("i")).alias("r"), F.posexplode("line").alias("c", "level"))
