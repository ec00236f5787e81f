"""Secret scan with corpus-wide ownership frequency.

A string that looks like a credential is worth a warning when it belongs to one
owner, and is an example when it is copied far and wide.  So candidates are
found in every text, their hashes are counted by distinct repositories and
owners over the whole corpus, and the counts decide:

* ``owned``: a single owner has it, in however many repositories;
* ``example``: ``WIDE`` owners or more have it;
* ``shared``: anything between.

Base candidates (``assign``, ``access``, ``hex``) are always reported, with
their standing beside them.  ``live`` candidates are further tokens that look
random (``looks_random``) and touch no base span; only owned ones are reported,
since nothing but their ownership speaks for them.

Everything is DataFrame expressions.  Texts are read once; what is written and
shuffled holds spans and hashes, never texts or secrets.  Counts are combined
before each shuffle: per (hash, owner, repository), then per (hash, owner), so a
key that a third of the corpus holds is a row per task; the join that brings the
standing back is one that Spark splits when a key is hot.

Null texts count as empty, null owners as ''.  A null repository is a repository
of its own.  Every input row gives one row, repeated ids and rows too (a row
repeated within one repository does not raise its counts).  Spans are code
points, end exclusive, in order of start, then kind as listed.  An empty table
gives no rows; other columns are ignored.  Texts are scanned whole; placing the
spans of one text takes time in the square of the number of its candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clarion.llm.common import stored

KINDS = ("assign", "access", "hex", "live")
#: Owners from which on a candidate is an example.
WIDE = 3

# letters in either case are written out: a flag would also fold letters beyond ASCII in some engines
ASSIGN = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
          r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # a run of fewer fails, and no part of it matches
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
#: A token looks random with so many different characters, among them a capital, a small letter and a digit.
LEAST_DIFFERENT = 12

_SPAN = "array<struct<start: int, kind: int, end: int, digest: string>>"


def placed(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """All matches of ``pattern`` with their places and the hash of ``group``, in order; the text between matches gives the places."""
    parts = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(F.regexp_extract_all(text, F.lit(pattern), 0))).alias("gap"),
                         F.regexp_extract_all(text, F.lit(pattern), 0).alias("hit"), F.regexp_extract_all(text, F.lit(pattern), group).alias("value"))
    none = F.from_json(F.lit("[]"), "array<struct<start: int, kind: int, end: int, digest: string, size: int, value: string>>")

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(
            start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.sha2(x["value"], 256).alias("digest"),
            F.length(x["value"]).alias("size"), x["value"].alias("value")))).alias("out"))
    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def looks_random(value: Column) -> Column:
    return (F.size(F.array_distinct(F.split(value, ""))) >= LEAST_DIFFERENT) & value.rlike("[A-Z]") & value.rlike("[a-z]") & value.rlike("[0-9]")


def _slim(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["digest"].alias("digest")))


def candidates(text: Column) -> tuple[Column, Column]:
    """Base spans and further random-looking tokens of a text; a cheap test keeps most texts from the patterns."""
    none = F.from_json(F.lit("[]"), _SPAN)
    found = lambda test, spans: F.when(test, _slim(spans)).otherwise(none)
    base = F.concat(
        found((text.contains("=") | text.contains(":")) & text.rlike(ASSIGN), F.filter(placed(text, ASSIGN, 0, 2), lambda s: s["size"] >= LEAST_ASSIGN)),
        found(text.contains("AKIA"), F.filter(placed(text, ACCESS, 1), lambda s: s["size"] >= LEAST_ACCESS)),
        found(text.rlike(HEX), placed(text, HEX, 2)))
    live = found(text.rlike(TOKEN), F.filter(placed(text, TOKEN, 3), lambda s: looks_random(s["value"])))
    return base, live


def ownership(found: DataFrame) -> DataFrame:
    """digest, owners, repositories from rows (digest, owner, repository)."""
    each = found.select("digest", "owner", "repository").distinct()
    by_owner = each.groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    return by_owner.groupBy("digest").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))


def standing(owners: Column, wide: int = WIDE) -> Column:
    return F.when(owners >= wide, "example").when(owners == 1, "owned").otherwise("shared")


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", wide: int = WIDE) -> DataFrame:
    """doc_id and ``spans``: array of (start, kind, end, digest, owners, repositories, standing), kind as its place in ``KINDS``."""
    base, live = candidates(F.coalesce("text", F.lit("")))
    read = docs.select("doc_id", F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), F.col(repository).alias("repository"), base.alias("base"), live.alias("live"))
    free = F.filter("live", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    rows = stored(read.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repository", F.concat("base", free).alias("found")), "candidates")

    each = rows.select("row", "doc_id", "owner", "repository", F.explode("found").alias("s")).select("row", "doc_id", "owner", "repository", "s.*")
    judged = each.join(ownership(each), "digest").withColumn("standing", standing(F.col("owners"), wide))
    span = F.struct("start", "kind", "end", "digest", "owners", "repositories", "standing")
    told = F.filter(F.array_sort(F.collect_list(span)), lambda s: (s["kind"] < KINDS.index("live")) | (s["standing"] == "owned"))
    with_spans = judged.groupBy("row", "doc_id").agg(told.alias("spans")).drop("row")
    clean = rows.where(F.size("found") == 0).select("doc_id", F.array().cast(with_spans.schema["spans"].dataType).alias("spans"))
    return with_spans.unionByName(clean)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts per base kind, digest and list of the spans, and counts by standing."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    as_ = lambda name: F.size(F.filter("spans", lambda s: s["standing"] == name)).cast("long")
    return scan(docs).select(
        "doc_id", *[of(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(_written(F.filter("spans", lambda s: s["kind"] < KINDS.index("live"))), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"),
        *[as_(x).alias(f"n_{x}") for x in ("owned", "shared", "example")])
