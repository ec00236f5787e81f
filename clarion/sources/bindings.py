"""Bindings of the operators to the driver's tables.

The operators take column names as parameters; these frames give them data
that grows with the given tables.  Every derivation is a narrow, per-row
projection or a key join, so it keeps the scan's partitioning and lets
Catalyst prune columns and push filters into the parquet reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clarion.functions.columns import cents, squash

LINE_FEATURES = ["quantity", "ext", "discount", "tax", "net", "charge", "unit"]
# Features that carry injected defects in ``with_missing`` (fixed choice).
DEFECT_COLUMNS = ["quantity", "tax"]
DOC_FEATURES = ["n_chars", "n_words", "mean_word_len", "digit_share", "unique_share"]
GRID_SIDE = 8  # 64-d embedding -> 8 x 8 raster
# Word separator: the explicit ASCII whitespace set, so Java and RE2 regex agree.
WORD_SPLIT = r"[ \t\n\x0B\f\r]+"


def spread(df: DataFrame) -> DataFrame:
    """Give per-row work at least one task per core.

    A scan of a file with a single row group reads everything in one task
    even when the file is split; then every per-row expression up to the
    first shuffle runs on one core.  When the scan has fewer partitions than
    the cluster's default parallelism, rows are spread round-robin.  On a
    large table (many more splits than cores) this adds nothing.
    """
    try:
        par = df.sparkSession.sparkContext.defaultParallelism
        n = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - e.g. Spark Connect: no RDD API, leave the scan as is
        return df
    return df.repartition(par) if n < par else df


def table(spark: SparkSession, sf_dir: str, name: str, spread_rows: bool = True) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if spread_rows else df


def row_key(*cols) -> F.Column:
    """md5 over a '|'-joined text of the columns; doubles go in as cents."""
    return F.md5(F.concat_ws("|", *cols))


def _lineitem_key() -> F.Column:
    return row_key(F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"),
                   F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string"),
                   cents("l_quantity").cast("string"), cents("l_extendedprice").cast("string"),
                   cents("l_discount").cast("string"), cents("l_tax").cast("string"),
                   F.col("l_returnflag"), F.col("l_linestatus"))


def _line_projection(li: DataFrame, keep_orderkey: bool = False) -> DataFrame:
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    cols = [
        _lineitem_key().alias("row_id"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("ext"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        net.alias("net"),
        (net * (1 + F.col("l_tax"))).alias("charge"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
    ]
    if keep_orderkey:
        cols.append(F.col("l_orderkey"))
    return li.select(*cols)


def line_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem -> (row_id, 7 numeric features, label = returnflag 'R')."""
    return _line_projection(table(spark, sf_dir, "lineitem"))


def with_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line_features`` with injected defects, for the quality/cleaning operators:
    NULL quantity and tax on orders whose key is divisible by 17, and an exact
    second copy of every line of orders whose key is divisible by 23.  The
    driver tables have neither NULLs nor duplicate rows, so defects must be made;
    all rows of lineitem still flow through.
    """
    base = _line_projection(table(spark, sf_dir, "lineitem"), keep_orderkey=True)
    hole = (F.col("l_orderkey") % 17) == 0
    damaged = base.select("row_id", *[F.when(hole, F.lit(None).cast("double")).otherwise(F.col(c)).alias(c)
                                      if c in DEFECT_COLUMNS else F.col(c) for c in LINE_FEATURES],
                          "label", "l_orderkey")
    copies = damaged.where((F.col("l_orderkey") % 23) == 0)
    return damaged.unionByName(copies).drop("l_orderkey")


def doc_features(spark: SparkSession, sf_dir: str, target: str = "quality") -> DataFrame:
    """documents |><| labels -> per-document text statistics over the whole text.

    label = 1 - quality (low quality is the positive, minority class) or toxic.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    labels = table(spark, sf_dir, "labels")
    words = F.filter(F.split(F.col("text"), WORD_SPLIT), lambda w: w != "")
    n_words = F.size(words)
    word_chars = F.aggregate(words, F.lit(0).cast("bigint"), lambda acc, w: acc + F.length(w))
    label = (1 - F.col("quality")) if target == "quality" else F.col("toxic")
    # the statistics are taken before the join: texts are not shuffled
    stats = docs.select(
        "doc_id",
        F.col("n_chars").cast("double").alias("n_chars"),
        n_words.cast("double").alias("n_words"),
        F.when(n_words == 0, F.lit(0.0)).otherwise(word_chars / n_words).alias("mean_word_len"),
        F.when(F.length("text") == 0, F.lit(0.0)).otherwise(
            F.length(F.regexp_replace("text", "[^0-9]", "")) / F.length("text")).alias("digit_share"),
        F.when(n_words == 0, F.lit(0.0)).otherwise(
            F.size(F.array_distinct(words)) / n_words).alias("unique_share"))
    return stats.join(labels.select("doc_id", label.cast("int").alias("label")), "doc_id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings -> (vec_id, v array<double>, true_label)."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"),
                      F.col("label").alias("true_label"))


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each 64-d embedding min-max quantised per row to 0..255 and laid out 8 x 8.

    Row-local (``array_min``/``array_max`` on the array), so no shuffle.
    """
    emb = vectors(spark, sf_dir)
    mn, mx = F.array_min("v"), F.array_max("v")
    exploded = emb.select(F.col("vec_id").alias("image_id"), mn.alias("_mn"), mx.alias("_mx"),
                          F.posexplode("v").alias("pos", "x"))
    level = F.when(F.col("_mx") == F.col("_mn"), F.lit(0)).otherwise(
        F.floor((F.col("x") - F.col("_mn")) / (F.col("_mx") - F.col("_mn")) * 255)).cast("int")
    return exploded.select("image_id", (F.col("pos") / GRID_SIDE).cast("int").alias("r"),
                           (F.col("pos") % GRID_SIDE).cast("int").alias("c"), level.alias("level"))


def heat_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heatmap = an image's own grid / 255; mask = the next image's grid > 127.

    The last image has no next image, hence no mask (``has_mask`` false, mask 0).
    An equi-join on (image_id + 1, r, c) -- no global ordering needed.
    """
    g = grids(spark, sf_dir)
    nxt = g.select((F.col("image_id") - 1).alias("image_id"), "r", "c", F.col("level").alias("_next"))
    has_next = g.select((F.col("image_id") - 1).alias("image_id")).distinct().withColumn("has_mask", F.lit(True))
    return (g.join(nxt, ["image_id", "r", "c"], "left")
            .join(has_next, "image_id", "left")
            .select("image_id", "r", "c", (F.col("level") / 255.0).alias("heat"),
                    F.when(F.col("_next") > 127, 1).otherwise(0).alias("mask"),
                    F.coalesce("has_mask", F.lit(False)).alias("has_mask")))


#: Families of line features (P2): the measures that end in a suffix, or are named.
FAMILIES = {"price": ["ext", "net"], "rate": ["discount", "tax"], "amount": ["quantity", "unit", "charge"]}

# Fixed-coefficient scorers (logit squashed to (0,1), see ``squash``) over line features (the same expressions
# are written in SQL for the oracle).  name -> (intercept, {feature: weight}).
SCORERS = {
    "scorer_a": (-0.8, {"quantity": 0.021, "discount": 3.5, "tax": -2.0}),
    "scorer_b": (0.4, {"ext": -0.0000135, "discount": -1.5, "tax": 4.0}),
    "scorer_c": (-0.2, {"unit": 0.00045, "quantity": -0.012}),
}


def scorer_logit(name: str) -> F.Column:
    b0, w = SCORERS[name]
    expr = F.lit(b0)
    for feat, coef in w.items():
        expr = expr + F.lit(coef) * F.col(feat)
    return expr


def scored(spark: SparkSession, sf_dir: str, features: DataFrame | None = None,
           keep: list[str] | tuple = ()) -> DataFrame:
    """``line_features`` scored by every fixed scorer: (row_id, [keep...], model, label, score)."""
    lf = features if features is not None else line_features(spark, sf_dir)
    models = F.array(*[F.struct(F.lit(n).alias("model"), squash(scorer_logit(n)).alias("score"))
                       for n in SCORERS])
    return lf.select("row_id", *keep, "label", F.inline(models)).select("row_id", *keep, "model", "label", "score")


def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> (event_id, ts, model, label = purchase, score = value / 500)."""
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", "ts", "event_type", F.lit("event_value").alias("model"),
                     (F.col("event_type") == "purchase").cast("int").alias("label"),
                     (F.col("value") / 500.0).alias("score"), "value")
