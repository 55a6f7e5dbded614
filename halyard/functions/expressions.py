"""Column expressions: names, day counts, bands, labels and text.

Every function takes Columns (and ``as_of`` where the answer depends on the
clock) and returns a Column, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from halyard.functions.time import MICROS_PER_DAY, at, horizon_interval

# Fixed values that must match the reference's output text.
DASH = "—"                       # shown for a missing price or discount
BULLET = "•"                     # leads each line of the text digest
EXPIRY_TYPE = "package_expiry"        # notification_log.type
SOON_DAYS = 7                         # expiring_soon band and dashboard urgency
MAIL_URGENT_DAYS = 2                  # mail urgency
DEFAULT_DURATION_DAYS = 30            # package duration when none is known


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def full_name(first, last) -> Column:
    """First, space, last (both NOT NULL, so plain concat)."""
    return F.concat(_c(first), F.lit(" "), _c(last))


def days_left(expires_at, as_of, dtype=None) -> Column:
    """Whole days to expiry, truncated toward zero (EXTRACT(DAY FROM a - b))."""
    return F.extract(F.lit("DAY"), _c(expires_at) - at(as_of, dtype))


def days_until(expires_at, as_of, dtype=None) -> Column:
    """Days to expiry rounded up; NULL when there is no expiry."""
    micros = F.timestamp_diff("MICROSECOND", at(as_of, dtype), _c(expires_at))
    return F.ceil(micros / F.lit(float(MICROS_PER_DAY))).cast("int")


def expiry_band(days) -> Column:
    """By E3; ``expired`` below 0, ``expiring_soon`` for 0..7, else ``ok``."""
    d = _c(days)
    return (F.when(d.isNull(), F.lit(None).cast("string"))
            .when(d < 0, "expired").when(d <= SOON_DAYS, "expiring_soon").otherwise("ok"))


def dashboard_urgency(days_until_col) -> Column:
    """E5, screen variant: E3 <= 7 is urgent."""
    d = _c(days_until_col)
    return F.when(d.isNull(), F.lit(None).cast("string")).when(d <= SOON_DAYS, "urgent").otherwise("warning")


def mail_urgency(days_left_col) -> Column:
    """E5, mail variant: E2 <= 2 is urgent."""
    d = _c(days_left_col)
    return F.when(d.isNull(), F.lit(None).cast("string")).when(d <= MAIL_URGENT_DAYS, "urgent").otherwise("warning")


def relative_expiry(days) -> Column:
    """``Nd ago`` when E3 < 0, else ``in Nd``."""
    d = _c(days)
    return (F.when(d < 0, F.concat(F.abs(d).cast("string"), F.lit("d ago")))
            .when(d.isNotNull(), F.concat(F.lit("in "), d.cast("string"), F.lit("d"))))


def promotion_status(active, valid_until, as_of, dtype=None) -> Column:
    """Inactive, else Expired when valid_until < as_of, else Active.
    A future valid_from still reads Active."""
    return (F.when(~_c(active), "Inactive")
            .when(_c(valid_until) < at(as_of, dtype), "Expired").otherwise("Active"))


def number_text(x) -> Column:
    """A decimal as a JavaScript number prints: no trailing zeros, no bare dot."""
    s = _c(x).cast("string")
    s = F.regexp_replace(s, r"(\.[0-9]*[1-9])0+$", "$1")
    return F.regexp_replace(s, r"\.0+$", "")


def discount_label(percent, amount) -> Column:
    """``P%``, ``$A``, ``P% / $A`` or a dash."""
    p = F.when(_c(percent).isNotNull(), F.concat(number_text(percent), F.lit("%")))
    a = F.when(_c(amount).isNotNull(), F.concat(F.lit("$"), number_text(amount)))
    return F.coalesce(F.nullif(F.concat_ws(" / ", p, a), F.lit("")), F.lit(DASH))


def features_parse(text) -> Column:
    """Split on commas, trim whitespace, drop empty parts. Whitespace at
    the ends and around each comma is removed before the split, which trims
    every part without a lambda (so the projection stays in codegen)."""
    t = F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"^\s+|\s+$", "")
    t = F.regexp_replace(t, r"\s*,\s*", ",")
    return F.array_remove(F.split(t, ","), "")


def features_text(features) -> Column:
    """An array as ``a, b, c``; NULL reads as an empty list."""
    return F.array_join(F.coalesce(_c(features), F.array().cast("array<string>")), ", ")


def iso_date(ts) -> Column:
    """The UTC date as yyyy-MM-dd."""
    return F.date_format(_c(ts), "yyyy-MM-dd")


def price_text(price) -> Column:
    """``$`` and the NUMERIC text (two decimals kept), dash when NULL."""
    p = _c(price)
    return F.when(p.isNull(), F.lit(DASH)).otherwise(F.concat(F.lit("$"), p.cast("string")))


def revenue_text(x) -> Column:
    """Thousands separators and two decimals."""
    return F.format_number(_c(x).cast("double"), 2)


def html_escape(s) -> Column:
    """``&``, then ``<``, then ``>``."""
    out = F.replace(_c(s), F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;"))


def default_expiry(duration_days, as_of) -> Column:
    """Midnight UTC of (as_of's date + duration days), 30 days when unknown."""
    d = F.coalesce(_c(duration_days), F.lit(DEFAULT_DURATION_DAYS))
    return F.date_add(F.to_date(at(as_of)), d).cast("timestamp_ntz")


def horizon_end(start, days) -> Column:
    """``start + days`` with days (possibly fractional) as an interval."""
    return _c(start) + horizon_interval(days)


def money(x) -> Column:
    """Decimal money to double at the output boundary (0 stays 0)."""
    return _c(x).cast("double")
