"""Column expressions shared by the operators. All of them stay on the JVM side."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def micros(value: Column | str) -> Column:
    """Microseconds since the epoch of a TIMESTAMP column, exact."""
    return F.unix_micros(col(value))


def to_micros(seconds: float) -> int:
    return int(round(seconds * MICROS))


def seconds(value: Column) -> Column:
    return value.cast("double") / F.lit(float(MICROS))


def at_micros(value: Column) -> Column:
    return F.timestamp_micros(value)


def places(value: Column, digits: int = 6) -> Column:
    """Round half to even, the rounding of every published figure."""
    return F.bround(value, digits)


def ratio(numerator: Column | str, denominator: Column | str, digits: int = 6) -> Column:
    """Exact quotient of two counts, rounded half to even; null over zero."""
    top = col(numerator).cast("decimal(18,0)")
    bottom = col(denominator).cast("decimal(18,0)")
    return F.when(bottom > 0, F.bround(top / bottom, digits))


def mean_of(total: Column, count: Column, digits: int = 6, scale: int = 6) -> Column:
    """Mean from an exact decimal sum and a count, rounded half to even.

    The sum is narrowed to 30 digits, which leaves the quotient enough decimals for
    the rounding to see whether it is a tie.
    """
    exact = total.cast(f"decimal(30,{scale})") / count.cast("decimal(18,0)")
    return F.when(count > 0, F.bround(exact, digits))


def hit(value: Column | str, threshold: Column | str) -> Column:
    return (col(value) >= col(threshold)).cast("int")


def number_list(values: Sequence[float | str], sql_type: str) -> Column:
    return F.array(*[F.lit(str(v)).cast(sql_type) for v in values])


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))


def log_value(value: Column | str, cap: float = 1000.0) -> Column:
    """Natural log of a value bounded above, the scale every model works on."""
    return F.ln(F.least(col(value).cast("double"), F.lit(float(cap))))


def skill_pct(reference: Column, candidate: Column, empty: str = "null") -> Column:
    """Percent by which ``candidate`` loses less than ``reference``.

    A reference of zero (or less) gives null, or 0 with ``empty="zero"``.
    """
    other = F.lit(None).cast("double") if empty == "null" else F.lit(0.0)
    ref = reference.cast("double")
    value = places((ref - candidate.cast("double")) / ref * 100.0)
    return F.when(reference.isNull() | candidate.isNull(), F.lit(None)).otherwise(
        F.when(ref > 0, value).otherwise(other)
    )


def size_band(size: Column | str) -> Column:
    size = col(size)
    # The band edges and labels.
    return (
        F.when(size < 64, "<64")
        .when(size < 128, "64-127")
        .when(size < 256, "128-255")
        .when(size < 512, "256-511")
        .when(size < 1024, "512-1023")
        .when(size < 2048, "1024-2047")
        .otherwise("2048+")
    )


def short_number(value: Column | str) -> Column:
    """Shortest text of a bucket value: 5.0 -> 5, 0.10 -> 0.1 (up to 5 decimals)."""
    text = F.bround(col(value), 5).cast("decimal(20,5)").cast("string")
    return F.regexp_replace(text, r"\.?0+$", "")


def fingerprint_text(missing: str | None) -> Column:
    """``|e=..|z=..|h=..|u=..`` of the four fingerprint buckets.

    ``missing`` replaces a null bucket; with None the whole text is null then.
    """

    def part(name: str, text: Column) -> Column:
        shown = text if missing is None else F.coalesce(text, F.lit(missing))
        return F.concat(F.lit(name), shown)

    return F.concat(
        part("|e=", short_number("entropy")),
        part("|z=", short_number("zero_ratio")),
        part("|h=", short_number("high_bit_ratio")),
        part("|u=", F.col("unique_byte_bucket").cast("string")),
    )


def observation_signature() -> Column:
    """Token of an observation: direction, format, size band and, for binary ones,
    the fingerprint buckets (``na`` where one is missing)."""
    head = F.concat_ws(
        ":", F.col("direction"), F.col("payload_format"), size_band("payload_bytes")
    )
    return F.when(
        F.col("payload_format") == "binary", F.concat(head, fingerprint_text("na"))
    ).otherwise(head)


def strict_signature() -> Column:
    """Like the observation token without the format; null if any bucket is missing."""
    return F.concat(
        F.col("direction"), F.lit(":"), size_band("payload_bytes"), fingerprint_text(None)
    )


def token_id(prefix: str, *parts: Column) -> Column:
    """Deterministic id: prefix and the first 24 hex digits of SHA-256 over parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24))


def hash_bin(token: Column, bins: int) -> Column:
    """Signed hashing: bin from the first four digest bytes, sign from the fifth."""
    digest = F.sha2(token, 256)
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(bins))


def hash_sign(token: Column) -> Column:
    digit = F.conv(F.substring(F.sha2(token, 256), 10, 1), 16, 10).cast("int")
    return F.when(digit % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
