"""Text form of instants."""

from pyspark.sql import Column
from pyspark.sql import functions as F

UTC_PATTERN = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def utc_text(name: str | Column) -> Column:
    """Fixed-width UTC text, so that text order is time order."""
    return F.date_format(F.col(name) if isinstance(name, str) else name, UTC_PATTERN)


def instant(text: Column) -> Column:
    """Instant of an ISO text that carries an offset; null without one."""
    return F.when(text.rlike(r"([zZ]|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(text))
