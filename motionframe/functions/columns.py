"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def missing_to_null(c) -> Column:
    """NaN to NULL; applied once, where data enters."""
    c = _col(c)
    return F.when(~F.isnan(c), c)


def null_to_zero(c) -> Column:
    """NULL, NaN and both infinities to 0, for model input."""
    c = _col(c)
    bad = F.isnan(c) | c.isin(float("inf"), float("-inf"))
    return F.when(c.isNull() | bad, F.lit(0.0)).otherwise(c)


def normalize_path(c) -> Column:
    """Forward slashes, no file scheme."""
    return F.regexp_replace(F.replace(_col(c), F.lit("\\"), F.lit("/")), r"^file:/+", "/")


def decoded_path(c) -> Column:
    """File paths of Spark's metadata column are percent-encoded; a plus sign there is a plus sign."""
    return F.url_decode(F.replace(_col(c), F.lit("+"), F.lit("%2B")))


def epoch_seconds(c) -> Column:
    """Timestamp of seconds since 1970, as run ids are."""
    return F.timestamp_seconds(_col(c))


def iso_timestamp(c) -> Column:
    """A timestamp as ISO 8601 text to the second, in the session's time zone."""
    return F.date_format(_col(c), "yyyy-MM-dd'T'HH:mm:ss")


def clip_seconds(n_frames, fps) -> Column:
    """Length of a clip; NULL without a frame rate."""
    return safe_ratio(_col(n_frames).cast("double"), fps)


def path_stem(c) -> Column:
    """File name without its directory and last extension."""
    return F.regexp_replace(F.element_at(F.split(_col(c), "/"), -1), r"\.[^.]*$", "")


def path_parent(c) -> Column:
    """Name of the directory that holds the file."""
    return F.element_at(F.split(_col(c), "/"), -2)


def subset_tag(subset, coords="xyz") -> Column:
    """Cache tag of a subset: lower case without underscores, coords appended unless xyz."""
    coords = F.lit(coords) if isinstance(coords, str) else coords
    tag = F.replace(F.lower(_col(subset)), F.lit("_"), F.lit(""))
    return F.when(coords == "xyz", tag).otherwise(F.concat(tag, F.lit("-"), coords))


def hash_order(seed: int, *keys) -> Column:
    """Seeded order key that does not depend on partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_col(k).cast("string") for k in keys]))


def safe_ratio(num, den) -> Column:
    """num / den, NULL where den is 0 or NULL."""
    num, den = _col(num), _col(den)
    return F.when(den != 0, num / den)


def ratio_or_zero(num, den) -> Column:
    return F.coalesce(safe_ratio(num, den), F.lit(0.0))


def nan_mean(a, b) -> Column:
    """Mean of two columns that skips NULL."""
    a, b = _col(a), _col(b)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise((a + b) / 2)


def digamma(c) -> Column:
    """Digamma for positive arguments: recurrence up to x+8, then the asymptotic series."""
    x = _col(c).cast("double")
    shifted = x + 8
    inv2 = F.lit(1.0) / (shifted * shifted)
    series = (F.log(shifted) - F.lit(0.5) / shifted
              - inv2 * (F.lit(1 / 12) - inv2 * (F.lit(1 / 120) - inv2 * F.lit(1 / 252))))
    tail = F.lit(0.0)
    for j in range(8):
        tail = tail + F.lit(1.0) / (x + j)
    return series - tail
