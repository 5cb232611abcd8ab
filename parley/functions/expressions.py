"""Column expressions shared by the operators: intervals, tokens, vectors, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that make a short turn a back-channel, and the signs stripped around them.
BACKCHANNEL_WORDS = ["yeah", "right", "okay", "sure", "yep", "mm-hmm", "uh-huh", "yes", "i see", "exactly"]
EDGE_SIGNS = ".,!?;:\"'"

TOKEN = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """Lower-case word tokens of a text; Unicode letters, digits and underscores make words."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


def stripped(text: Column) -> Column:
    return F.btrim(F.lower(text), F.lit(EDGE_SIGNS))


def is_backchannel(text: Column) -> Column:
    return stripped(text).isin(BACKCHANNEL_WORDS)


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Length that two intervals share; 0 for touching or separate ones."""
    return F.greatest(F.lit(0.0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Intersection over union of two intervals; 0 when either is empty or they only touch."""
    shared = overlap(a_start, a_end, b_start, b_end)
    union = F.greatest(a_end, b_end) - F.least(a_start, b_start)
    return F.when((a_end > a_start) & (b_end > b_start) & (shared > 0), shared / union).otherwise(0.0)


def strict_match(p_start: Column, p_end: Column, e_start: Column, e_end: Column, longest: float = 120.0) -> Column:
    """Whether a predicted interval hits an expected one: IoU of 0.3, or starts within 5 s with a quarter of the prediction inside."""
    shared = overlap(p_start, p_end, e_start, e_end)
    valid = (p_end > p_start) & (e_end > e_start) & ((p_end - p_start) <= longest) & (shared > 0)
    near = (F.abs(p_start - e_start) <= 5.0) & (shared / (p_end - p_start) >= 0.25)
    return F.coalesce(valid & ((iou(p_start, p_end, e_start, e_end) >= 0.3) | near), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda t, v: t + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def min_words(text: Column, least: int) -> Column:
    """Whether a text has at least so many white-space separated words; an empty text counts one."""
    return F.size(F.split(F.btrim(text), r"[ \t\n\r]+")) >= least


def mmss(seconds: Column) -> Column:
    whole = F.floor(seconds)
    return F.format_string("%d:%02d", (whole / 60).cast("long"), (whole % 60).cast("long"))


def min_max(value: Column, window) -> Column:
    """Min-max normalisation within a window: 1 where all values are equal, 0 for a missing value."""
    low, high = F.min(value).over(window), F.max(value).over(window)
    return F.when(value.isNull(), 0.0).when(high == low, 1.0).otherwise((value - low) / (high - low))


def signal_norm(value: Column, window) -> Column:
    """Like min_max, but equal values count 1 only where they are positive."""
    low, high = F.min(value).over(window), F.max(value).over(window)
    return F.when(value.isNull(), 0.0).when(high == low, F.when(high > 0, 1.0).otherwise(0.0)).otherwise((value - low) / (high - low))
