"""Scalar functions as Column expressions: Catalyst sees through all of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.config import SETTINGS


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Splits a double into two halves of 26 bits (Dekker); from here on doubles have no fractions.
_SPLIT, _WHOLE = float(2**27 + 1), float(2**52)


def _halves(x):
    t = x * _SPLIT
    high = t - (t - x)
    return high, x - high


def rounded(x: Column | str, digits: int) -> Column:
    """To so many digits, the nearest of the exact binary value and half to even, as Python's `round` and C's printf have it.

    The product with 10**digits is rounded itself; where it comes out as a tie, its error, which two halves of each factor
    give exactly, says on which side the value is.  No negative zero.
    """
    x, scale = col(x).cast("double"), float(10**digits)
    size = F.abs(x)
    product = size * scale
    (high, low), (scale_high, scale_low) = _halves(size), _halves(scale)
    error = low * scale_low - (((product - high * scale_high) - low * scale_high) - high * scale_low)
    whole = F.floor(product)
    beyond = product - whole - 0.5
    odd = whole % 2 == 1
    up = (beyond > 0) | ((beyond == 0) & ((error > 0) | ((error == 0) & odd)))
    # Products without a fraction may be half a step from the value.
    far = F.when((product >= _WHOLE) & (F.abs(error) == 0.5) & odd, F.signum(error)).otherwise(F.lit(0.0))
    near = (whole + up.cast("int") + far) / F.lit(scale)
    return F.when(product < 2 * _WHOLE, F.when(x < 0, -near).otherwise(near) + F.lit(0.0)).otherwise(x)


def price_change_rate(first: Column | str, last: Column | str) -> Column:
    """(last - first) / first to six digits; 0 if first is 0 or null."""
    first, last = col(first), col(last)
    return F.when(F.coalesce(first, F.lit(0.0)) == 0, F.lit(0.0)).otherwise(rounded((last - first) / first, 6))


def volume_surge_ratio(volume: Column | str, baseline: Column | str) -> Column:
    """volume / baseline to four digits; 0 if the baseline is 0 or null."""
    volume, baseline = col(volume), col(baseline)
    return F.when(F.coalesce(baseline, F.lit(0.0)) == 0, F.lit(0.0)).otherwise(rounded(volume / baseline, 4))


def sentiment_shift(current: Column | str, previous: Column | str) -> Column:
    return rounded(col(current) - col(previous), 4)


def signed_sentiment(label: Column | str, score: Column | str) -> Column:
    """A classifier's label and confidence as one number: -score, score, or 0 for anything but negative and positive."""
    label, score = F.lower(col(label)), col(score)
    return F.when(label == "negative", -score).when(label == "positive", score).otherwise(F.lit(0.0))


def signed_label(label: Column | str) -> Column:
    label = F.lower(col(label))
    return F.when(label.isin("negative", "positive"), label).otherwise(F.lit("neutral"))


def feature(name: str) -> Column:
    """A feature that may be missing counts as 0."""
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def ticker_or_default(name: str = "ticker") -> Column:
    return F.coalesce(F.col(name), F.lit("_default"))


def feature_gt(name: str, threshold: float) -> Column:
    return feature(name) > threshold


def feature_lt(name: str, threshold: float) -> Column:
    return feature(name) < threshold


def feature_gte(name: str, threshold: float) -> Column:
    return feature(name) >= threshold


def feature_abs_gt(name: str, threshold: float) -> Column:
    return F.abs(feature(name)) > threshold


def is_anomaly(score: Column | str, threshold: float = SETTINGS.threshold) -> Column:
    """Strictly below the threshold."""
    return col(score) < threshold


def grouped_number(x: Column | str) -> Column:
    """A whole number with commas between the thousands."""
    return F.format_number(col(x).cast("long"), 0)


def anomaly_reason(score: Column | str, s=SETTINGS) -> Column:
    """What stands out, joined by "; ", or the score if nothing does."""
    change, volume, shift = feature("price_change_rate"), feature("total_volume"), feature("sentiment_shift")
    parts = F.concat_ws(
        "; ",
        F.when(F.abs(change) > s.reason_price_change, F.format_string("large price move (%.2f%%)", rounded(change * 100, 2))),
        F.when(volume > s.reason_volume, F.concat(F.lit("high volume ("), grouped_number(volume), F.lit(")"))),
        F.when(F.abs(shift) > s.reason_sentiment_shift, F.format_string("sentiment shift (%.2f)", rounded(shift, 2))),
    )
    return F.when(parts == "", F.format_string("anomaly score=%.4f", col(score))).otherwise(parts)


def severity(score: Column | str, high: float = SETTINGS.severity_high) -> Column:
    return F.when(col(score) < high, "high").otherwise("normal")


def freshness(age_minutes: Column | str) -> Column:
    age = col(age_minutes)
    return F.when(age.isNull(), "NO DATA").when(age < 10, "LIVE").when(age < 30, "STALE").otherwise("DOWN")


def age_label(seconds: Column | str) -> Column:
    s = col(seconds).cast("long")
    return F.when(s < 120, F.concat(s.cast("string"), F.lit("s ago"))).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m ago")))


def from_epoch_millis(ms: Column | str) -> Column:
    return F.timestamp_millis(col(ms))


def to_epoch_millis(ts: Column | str) -> Column:
    return F.unix_millis(col(ts).cast("timestamp"))


def day_of(ts: Column | str) -> Column:
    """Midnight of a time's day."""
    return F.date_trunc("day", col(ts))


def point_label(events: Column | str) -> Column:
    return F.concat(F.lit("point:"), F.array_join(F.array_sort(col(events)), "+"))


def pattern_event(name: Column | str) -> Column:
    return F.concat(F.lit("PATTERN:"), col(name))


def headline_preview(text: Column | str, n: int = 60) -> Column:
    return F.substring(col(text), 1, n)
