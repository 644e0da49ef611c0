"""Filter strings for a renderer: where clips meet, what sounds when."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def transition_offset(cut: Column, duration: Column) -> Column:
    """Where a transition that ends at the cut begins, to the millisecond."""
    return F.bround(F.greatest(F.lit(0.0), cut - duration), 3)


def transition_filter(kind: Column, duration: Column, offset: Column) -> Column:
    """Null where there is no transition."""
    return F.when(kind.isNotNull() & (kind != ""), F.format_string("xfade=transition=%s:duration=%.2f:offset=%.2f", kind, duration.cast("double"), offset.cast("double")))


def delay_filter(at: Column) -> Column:
    """Both channels held back by whole milliseconds."""
    ms = F.floor(at * 1000).cast("long")
    return F.format_string("adelay=%d|%d", ms, ms)
