"""Class rebalancing (F6 SMOTE, M10 helper).

SMOTE as a distributed job: exact k nearest neighbours inside each minority
class (C0), draws generated by ``spark.range`` (one row per synthetic sample,
so the work is partitioned like any other table), base row / neighbour /
interpolation weight chosen by content hash of (seed, class, draw), and the
new point x + u * (nn - x) built with ``zip_with``.  Originals first, then the
synthetic rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clarion.operators.neighbors import knn, knn_by_tag
from clarion.operators.split import _cell_offsets, _with_cells
from clarion.session import kept

SMOTE_K = 5
SEED = 42
_U_SCALE = 2 ** 31


def _rank_in_class(df: DataFrame, label: str, id_col: str, seed) -> DataFrame:
    """0-based rank of each row inside its class by content hash (cells + offsets,
    the window runs per (class, cell))."""
    cells = _with_cells(df, id_col, seed)
    offsets = _cell_offsets(cells, label).select(label, "_cell", "_before")
    rn = F.row_number().over(Window.partitionBy(label, "_cell").orderBy("_h"))
    return cells.join(F.broadcast(offsets), [label, "_cell"]).withColumn(
        "_rank", F.col("_before") + rn - 1).drop("_h", "_cell", "_before")


def smote(df: DataFrame, id_col: str, vec_col: str, label: str = "label", k: int = SMOTE_K,
          seed: int = SEED) -> DataFrame:
    """every non-majority class is raised to the majority count.

    Returns (id, label, v, synthetic) -- synthetic ids are "s:<class>:<draw>".
    """
    spark = df.sparkSession
    base = kept(df.select(F.col(id_col).cast("string").alias("id"), F.col(label).alias("label"),
                          F.col(vec_col).alias("v")), "smote")
    counts = {r["label"]: r["n"] for r in base.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_major = max(counts.values())
    originals = base.withColumn("synthetic", F.lit(False))
    out = originals
    for cls, n_c in sorted(counts.items()):
        need = n_major - n_c
        if need <= 0:
            continue
        members = base.where(F.col("label") == cls)
        kk = min(k, n_c - 1)
        if kk < 1:
            raise ValueError(f"class {cls} has {n_c} row(s); SMOTE needs at least 2")
        ranked = _rank_in_class(members, "label", "id", seed).select("id", "v", "_rank")
        nn = knn(members, "id", "v", kk).select(F.col("id").alias("_base"), F.col("rank").alias("_nr"),
                                                F.col("nid").alias("_nid"))
        draws = spark.range(need).select(F.col("id").alias("_draw"))
        h = lambda salt: F.xxhash64(F.lit(seed + salt), F.lit(str(cls)), F.col("_draw"))
        draws = draws.select(
            "_draw",
            F.pmod(h(0), F.lit(n_c)).alias("_rank"),
            (F.pmod(h(1), F.lit(kk)) + 1).cast("int").alias("_nr"),
            (F.pmod(h(2), F.lit(_U_SCALE)) / float(_U_SCALE)).alias("_u"))
        with_base = draws.join(ranked.select(F.col("id").alias("_base"), F.col("v").alias("_x"), "_rank"), "_rank")
        with_nn = with_base.join(nn, ["_base", "_nr"]).join(
            members.select(F.col("id").alias("_nid"), F.col("v").alias("_n")), "_nid")
        new_v = F.zip_with("_x", "_n", lambda a, b: a + F.col("_u") * (b - a))
        synth = with_nn.select(F.concat(F.lit(f"s:{cls}:"), F.col("_draw").cast("string")).alias("id"),
                               F.lit(cls).cast(base.schema["label"].dataType).alias("label"),
                               new_v.alias("v"), F.lit(True).alias("synthetic"))
        out = out.unionByName(synth)
    return out


def smote_in_folds(df: DataFrame, id_col: str, vec_col: str, label: str, fold: str, folds: int, k: int = SMOTE_K,
                   seed: int = SEED) -> DataFrame:
    """F6 without leakage: for every validation fold the synthetic rows of its training part.

    Returns (held, id, label, v, base, neighbour): ``held`` is the fold that is
    left out, and neither parent of a synthetic row lies in it.  The neighbours
    of every fold are found in one search; what is nearest among the folds that
    are not held is then a ranking of at most k x folds rows of a point.  Classes
    of fewer than two rows in a training part get none there.
    """
    rows = kept(df.select(F.col(id_col).cast("string").alias("id"), F.col(label).alias("label"), F.col(vec_col).alias("v"), F.col(fold).cast("int").alias("fold")), "folded")
    counts = [tuple(r) for r in rows.groupBy("label", "fold").count().collect()]  # classes x folds
    every = rows.sparkSession.range(folds).select(F.col("id").cast("int").alias("held"))
    out = None
    for cls in sorted({c for c, _, _ in counts}):
        members = rows.where(F.col("label") == cls)
        part = {f: sum(n for c, g, n in counts if c == cls and g != f) for f in range(folds)}
        most = {f: max(sum(n for c, g, n in counts if c == other and g != f) for other, _, _ in counts) for f in range(folds)}
        need = [(f, most[f] - part[f], part[f], min(k, part[f] - 1)) for f in range(folds) if most[f] > part[f] >= 2]
        if not need:
            continue
        near = knn_by_tag(members, "id", "v", "fold", folds, k).join(F.broadcast(every), F.col("held") != F.col("tag"))
        near = near.join(members.select("id", F.col("fold").alias("_own")), "id").where("_own <> held")
        near = near.withColumn("_nr", F.row_number().over(Window.partitionBy("held", "id").orderBy("dist", "nid"))).where(F.col("_nr") <= k)
        near = near.select("held", F.col("id").alias("base"), F.col("nid").alias("neighbour"), "_nr")
        # a training part's rows in order of their content hash, by cells as in ``smote``
        each = members.join(F.broadcast(every), F.col("held") != F.col("fold"))
        ranked = _rank_in_class(each, "held", "id", seed).select("held", F.col("id").alias("base"), F.col("v").alias("_x"), "_rank")
        wanted = rows.sparkSession.createDataFrame(need, "held int, _need long, _n long, _k int")
        draws = wanted.select("held", "_n", "_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_need") - 1)).alias("_draw"))
        h = lambda salt: F.xxhash64(F.lit(seed + salt), F.lit(str(cls)), F.col("held"), F.col("_draw"))
        draws = draws.select("held", "_draw", F.pmod(h(0), F.col("_n")).alias("_rank"), (F.pmod(h(1), F.col("_k")) + 1).cast("int").alias("_nr"), (F.pmod(h(2), F.lit(_U_SCALE)) / float(_U_SCALE)).alias("_u"))
        both = draws.join(ranked, ["held", "_rank"]).join(near, ["held", "base", "_nr"]).join(members.select(F.col("id").alias("neighbour"), F.col("v").alias("_y")), "neighbour")
        made = both.select("held", F.concat(F.lit(f"s:{cls}:"), F.col("held"), F.lit(":"), F.col("_draw")).alias("id"), F.lit(cls).cast(rows.schema["label"].dataType).alias("label"),
                           F.zip_with("_x", "_y", lambda a, b: a + F.col("_u") * (b - a)).alias("v"), "base", "neighbour")
        out = made if out is None else out.unionByName(made)
    if out is None:
        return rows.limit(0).select(F.col("fold").alias("held"), "id", "label", "v", F.col("id").alias("base"), F.col("id").alias("neighbour"))
    return out
