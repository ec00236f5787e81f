"""File sources and sinks.

Readers use explicit schemas or header-only inference of names (never a data
pass to infer types), normalise headers with column renames, and return
DataFrames; failures are typed exceptions, rejected rows go to a rejects frame.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clarion.functions.columns import half_even
from clarion.operators.raster import grayscale

# Fixed values of the reference's data conventions.
LABEL_MAP_CSV = {"M": 1, "B": 0}
CLASS_FOLDERS = {"0": 0, "benign": 0, "non_idc": 0, "1": 1, "malignant": 1, "idc": 1}
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".tif")
MANIFEST_REQUIRED = ("image_path", "label", "patient_id")
MAX_MISSING_LISTED = 8


class MissingColumnsError(ValueError):
    """Required columns absent; lists at most the first 8 plus the total."""

    def __init__(self, missing: Sequence[str]):
        self.missing = list(missing)
        shown = ", ".join(self.missing[:MAX_MISSING_LISTED])
        more = f" (and {len(self.missing) - MAX_MISSING_LISTED} more)" if len(self.missing) > MAX_MISSING_LISTED else ""
        super().__init__(f"missing {len(self.missing)} required column(s): {shown}{more}")


def _on_storage(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path: any storage that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _on_storage(spark, path)
    return files.exists(where)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark's listings give it."""
    files, where = _on_storage(spark, path)
    return files.makeQualified(where).toString().rstrip("/")


def _resolved(path: Column, root: str) -> Column:
    """Paths of a table as full ones: NULL where blank or nan, else under ``root`` (qualified), at its storage, or as they are."""
    text = F.trim(path)
    storage = re.match(r"[a-z0-9+.-]+:(//[^/]*)?", root)[0]
    full = (F.when(text.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:/"), F.regexp_replace(text, "^file:/+", "file:/"))
            .when(text.startswith("/"), F.concat(F.lit(storage), text)).otherwise(F.concat(F.lit(f"{root}/"), text)))
    return F.when(text.isNotNull() & (text != "") & (F.lower(text) != "nan"), full)


def _listing(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Full paths of the files under ``root``; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_replace("path", "^file:/+", "file:/").alias(name))


def normalise_header(name: str) -> str:
    """strip, lower, spaces -> '_'."""
    return name.strip().lower().replace(" ", "_")


#: How the alternate source spells a measure's family, and the suffix it gets here.
ALTERNATE_FORMS = ((r"mean (?P<measure>.+)", "mean"), (r"worst (?P<measure>.+)", "worst"), (r"(?P<measure>.+) error", "se"))


def alternate_name(name: str) -> str:
    """S2: 'mean X' -> x_mean, 'worst X' -> x_worst, 'X error' -> x_se, spaces -> '_'."""
    words = name.strip()
    forms = ((re.fullmatch(pattern, words), suffix) for pattern, suffix in ALTERNATE_FORMS)
    words = next((f"{m['measure']} {suffix}" for m, suffix in forms if m), words)
    return "_".join(words.split(" "))


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Raise when a required column is absent (extra columns pass)."""
    missing = [c for c in required if c not in set(df.columns)]
    if missing:
        raise MissingColumnsError(missing)
    return df


def read_labelled_csv(spark: SparkSession, path: str, label_col: str = "diagnosis",
                      strict: bool = True) -> DataFrame:
    """Header normalised; ``id`` and ``unnamed*`` dropped; label M -> 1, B -> 0.

    Features are read as doubles (NaN and empty -> NULL).  An unknown label
    raises at run time with ``strict``; otherwise the row's label is NULL.
    """
    raw = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    renamed = raw.toDF(*[normalise_header(c) for c in raw.columns])
    keep = [c for c in renamed.columns if c != "id" and not c.startswith("unnamed")]
    lab = F.upper(F.trim(F.col(label_col)))
    mapped = F.when(lab == "M", F.lit(1)).when(lab == "B", F.lit(0))
    if strict:
        mapped = mapped.otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.col(label_col))))
    cols = [mapped.cast("int").alias(c) if c == label_col else
            F.when(F.lower(F.col(c)) == "nan", F.lit(None)).otherwise(F.col(c)).cast("double").alias(c)
            for c in keep]
    return renamed.select(*cols)


def from_alternate_source(df: DataFrame, target_col: str = "target", label_col: str = "diagnosis") -> DataFrame:
    """Rename alternate-source columns and invert the target {0: 1, 1: 0}."""
    mapping = {c: alternate_name(c) for c in df.columns if c != target_col}
    out = df.withColumnsRenamed(mapping)
    return out.withColumn(label_col, (1 - F.col(target_col)).cast("int")).drop(target_col)


def read_with_fallback(spark: SparkSession, primary: str, fallback: str, reader=read_labelled_csv) -> DataFrame:
    """S3: the primary file when present, else the bundled copy (same schema)."""
    return reader(spark, primary if exists(spark, primary) else fallback)


def read_upload_csv(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """Batch upload -- header *not* normalised, required columns checked,
    extra columns pass through; unparsable files fail (FAILFAST)."""
    df = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    return require_columns(df, required)


def read_metric_table(spark: SparkSession, path: str, text_columns: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """Saved metric CSV, the first column as the row's name, the others numbers rounded to ``digits``
    (``text_columns`` stay text); missing file -> FileNotFoundError."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    df = spark.read.option("header", True).csv(path)
    first, *rest = df.columns
    return df.select(F.col(first).alias("name"), *[F.col(c) if c in text_columns else half_even(F.col(c).cast("double"), digits).alias(c) for c in rest])


def read_class_folders(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Files under ``root/<class>/**``; label from the class folder (lower
    case); known image extensions that decode to 8 bits a channel.  Returns
    (accepted, rejects) with (path, label, image) and (path, reason); ``image``
    is the struct of Spark's image source.  Spark does not list empty files."""
    base = qualified(spark, root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", "^file:/+", "file:/")
    folder = F.lower(F.split(F.substr(path, F.lit(len(base) + 2)), "/").getItem(0))
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    cmap = F.create_map(*[x for k, v in CLASS_FOLDERS.items() for x in (F.lit(k), F.lit(v))])
    png_depth = F.when(F.hex(F.substring("content", 1, 4)) == "89504E47", F.conv(F.hex(F.substring("content", 25, 1)), 16, 10).cast("int"))
    tagged = files.select(path.alias("path"), F.element_at(cmap, folder).alias("label"), ext.isin(*IMAGE_EXTENSIONS).alias("known"), png_depth.alias("depth"))
    images = spark.read.format("image").option("recursiveFileLookup", True).load(root).select(F.regexp_replace("image.origin", "^file:/+", "file:/").alias("path"), "image")
    reason = (F.when(F.col("label").isNull(), F.lit("unknown class folder"))
              .when(~F.col("known"), F.lit("unsupported extension"))
              .when(F.col("depth") > 8, F.lit("more than 8 bits a channel"))
              .when(F.col("image").isNull() | (F.col("image.height") <= 0), F.lit("not an image")))
    judged = tagged.join(images, "path", "left").withColumn("reason", reason)
    return judged.where("reason IS NULL").select("path", "label", "image"), judged.where("reason IS NOT NULL").select("path", "reason")


def image_pixels(images: DataFrame) -> DataFrame:
    """(image_id, r, c, level) from (path, image): the bytes of a decoded image, row by row, in gray.

    One channel is gray already; of four the last (opacity) is left out."""
    lines = images.select(F.col("path").alias("image_id"), "image.nChannels", "image.width", F.col("image.data").alias("data"), F.explode(F.sequence(F.lit(0), F.col("image.height") - 1)).alias("r"))
    lines = lines.withColumn("line", F.substr("data", F.col("r") * F.col("width") * F.col("nChannels") + 1, F.col("width") * F.col("nChannels")))
    cells = lines.select("image_id", "r", "nChannels", "line", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("c"))

    def byte(k: int) -> Column:
        at = F.col("c") * F.col("nChannels") + F.when(F.col("nChannels") == 1, 0).otherwise(k) + 1
        return F.conv(F.hex(F.substr("line", at, F.lit(1))), 16, 10).cast("int")
    return grayscale(cells.select("image_id", "r", "c", byte(0).alias("b"), byte(1).alias("g"), byte(2).alias("r_")))


def read_manifest(spark: SparkSession, manifest_path: str, root: str) -> DataFrame:
    """Manifest CSV (image_path, mask_path?, label, patient_id).

    Blank / NaN mask paths become NULL; relative paths are joined to ``root``;
    ``has_mask`` = a path is given AND the file exists -- a left join with the
    file listing, full paths on both sides, not a per-row existence probe."""
    raw = require_columns(spark.read.option("header", True).csv(manifest_path), MANIFEST_REQUIRED)
    if "mask_path" not in raw.columns:
        raw = raw.withColumn("mask_path", F.lit(None).cast("string"))
    base = qualified(spark, root)
    m = raw.select(*[_resolved(F.col(c), base).alias(c) for c in ("image_path", "mask_path")], F.col("label").cast("int").alias("label"), F.col("patient_id"))
    listing = _listing(spark, root, "mask_path").withColumn("_exists", F.lit(True))
    return (m.join(listing, "mask_path", "left")
            .withColumn("has_mask", F.col("mask_path").isNotNull() & F.coalesce("_exists", F.lit(False)))
            .drop("_exists"))


def build_manifest(spark: SparkSession, image_root: str, descriptions: DataFrame, key_col: str = "image_name",
                   label_col: str = "pathology", positive: str = "MALIGNANT") -> DataFrame:
    """File listing joined to a case-description table on the file name; mask paths as in ``read_manifest``."""
    listing = _listing(spark, image_root, "image_path").withColumn(key_col, F.regexp_extract("image_path", r"([^/]+)$", 1))
    mask = _resolved(F.col("mask_path"), qualified(spark, image_root)) if "mask_path" in descriptions.columns else F.lit(None).cast("string")
    d = descriptions.select(key_col, (F.upper(F.col(label_col)) == positive).cast("int").alias("label"), F.col("patient_id"), mask.alias("mask_path"))
    return listing.join(d, key_col).select("image_path", "mask_path", "label", "patient_id")


# ------------------------------------------------------------------ sinks

def write_metric_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """K1: a small metric table (a handful of rows) as one CSV/parquet file."""
    w = df.coalesce(1).write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))


def save_model(model, path: str, params: dict | None = None) -> None:
    """K2: a fitted MLlib model, and its best parameters as JSON text beside it (models of a search: ``search.save_models``)."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(params or {}, default=str, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/best_params")


def load_params(spark: SparkSession, path: str) -> dict:
    """The parameters that ``save_model`` wrote."""
    return json.loads(spark.read.text(f"{path}/best_params").first()[0])


def write_scored_report(report: DataFrame, path: str) -> None:
    """K3: the scored-row report as quoted CSV (distributed write)."""
    report.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", "\"").csv(path)


def write_batch_results(scored: DataFrame, path: str) -> None:
    """K4: original columns plus prediction columns, properly quoted CSV."""
    scored.write.mode("overwrite").option("header", True).option("escape", "\"").csv(path)
