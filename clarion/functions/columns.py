"""Column-expression helpers (all JVM-side built-ins, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for the same results.
POSITIVE_NAME = "Malignant"
NEGATIVE_NAME = "Benign"
DEFAULT_THRESHOLD = 0.5
RISK_LOW_BELOW = 0.35          # p < 0.35 -> Low
RISK_MODERATE_BELOW = 0.65     # 0.35 <= p < 0.65 -> Moderate, else High
SPECIMEN_PREFIX = "SPEC-"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squash(c) -> Column:
    """Monotone map of a logit to (0, 1) with only + - * / and abs:
    0.5 + 0.5 * z / (1 + |z|).  Bit-identical on every IEEE engine (``exp``
    differs by an ulp between the JVM and C libraries), used by fixed fixture
    scorers whose ties must group identically in Spark and in the SQL oracle."""
    z = col_(c)
    return F.lit(0.5) + F.lit(0.5) * z / (F.lit(1.0) + F.abs(z))


def cents(c) -> Column:
    """Non-negative double -> integer cents, floor(x * 100 + 0.5): the same
    integer on Spark and DuckDB (and no per-value BigDecimal like ``round``)."""
    return F.floor(col_(c) * 100 + 0.5).cast("bigint")


def threshold_class(p, threshold: float = DEFAULT_THRESHOLD, strict: bool = False,
                    positive: str = POSITIVE_NAME, negative: str = NEGATIVE_NAME) -> Column:
    """``p >= t`` (services) or ``p > t`` (image training) -> class name."""
    cond = col_(p) > threshold if strict else col_(p) >= threshold
    return F.when(cond, F.lit(positive)).otherwise(F.lit(negative))


def threshold_label(p, threshold: float = DEFAULT_THRESHOLD, strict: bool = False) -> Column:
    cond = col_(p) > threshold if strict else col_(p) >= threshold
    return cond.cast("int")


def risk_tier(p, low: float = RISK_LOW_BELOW, high: float = RISK_MODERATE_BELOW) -> Column:
    """Tier from the *raw* probability (not the rounded one)."""
    return (F.when(col_(p) < low, "Low")
            .when(col_(p) < high, "Moderate")
            .otherwise("High"))


def decode_label(c) -> Column:
    """1 -> Malignant, 0 -> Benign."""
    return (F.when(col_(c) == 1, F.lit(POSITIVE_NAME))
            .when(col_(c) == 0, F.lit(NEGATIVE_NAME)))


def specimen_tag(name) -> Column:
    """32-bit rolling hash h*31+c over the characters of a name, base 36,
    upper case, left-padded to 6 and cut to 6, with a fixed prefix."""
    codes = F.transform(F.split(col_(name), ""), lambda ch: F.ascii(ch).cast("bigint"))
    h = F.aggregate(codes, F.lit(0).cast("bigint"),
                    lambda acc, c: F.pmod(acc * 31 + c, F.lit(4294967296)))
    return F.concat(F.lit(SPECIMEN_PREFIX), F.lpad(F.conv(h.cast("string"), 10, 36), 6, "0"))


def half_even(c, digits: int) -> Column:
    """P10: rounding for display; ties go to the even digit."""
    return F.bround(col_(c), digits)


def safe_div(num, den, zero_value=0.0) -> Column:
    """num/den with a fixed value when the denominator is 0 (0/0 -> 0 like the
    reference's ``zero_division=0``); ``zero_value=None`` yields NULL."""
    zv = F.lit(zero_value).cast("double") if zero_value is not None else F.lit(None).cast("double")
    return F.when(col_(den) == 0, zv).otherwise(col_(num).cast("double") / col_(den))
