"""Null-safe scalar rules and the normalisers of identity fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Street types and their short forms, in the order in which they are replaced.
STREET_TYPES = (("street", "st"), ("road", "rd"), ("avenue", "ave"), ("drive", "dr"), ("court", "ct"), ("place", "pl"), ("crescent", "cres"), ("highway", "hwy"))


def safe_divide(n: Column, d: Column) -> Column:
    """n / d, null where d is zero or null."""
    return F.try_divide(n.cast("double"), d.cast("double"))


def pct_change(recent: Column, prior: Column) -> Column:
    """(recent - prior) / prior, null unless prior is positive."""
    return F.when(prior > 0, (recent - prior) / prior)


def clip(x: Column, lo: float, hi: float) -> Column:
    """x limited to lo..hi; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))


def flag(condition: Column) -> Column:
    """A condition with unknown read as false."""
    return F.coalesce(condition, F.lit(False))


def zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def one_place(x: Column) -> Column:
    """Round half up to one place, the same in every engine."""
    return F.floor(x * 10 + 0.5 + 1e-9) / 10


def cents(x: Column) -> Column:
    """Money to two places, half up; sums whose last bits depend on the order of addition give the same cents."""
    return F.floor(x * 100 + 0.5 + 1e-6) / 100


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-5)), F.lit(1 - 1e-5))
    return F.ln(q / (1 - q))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def band(x: Column, cuts: list[tuple[float, str]], top: str) -> Column:
    """Left-closed bins: the label of the first upper end that x is below, else top."""
    out = None
    for end, label in cuts:
        out = F.when(x < end, label) if out is None else out.when(x < end, label)
    return F.when(x.isNotNull(), out.otherwise(top))


def month_age(d: Column, start: Column) -> Column:
    """Difference of calendar months."""
    return ((F.year(d) - F.year(start)) * 12 + F.month(d) - F.month(start)).cast("int")


def month_sin(d: Column) -> Column:
    return F.sin(2 * F.pi() * F.month(d) / 12)


def month_cos(d: Column) -> Column:
    return F.cos(2 * F.pi() * F.month(d) / 12)


def slope_p_value(r2: Column, n: Column) -> Column:
    """Two-sided p-value of a straight line's slope from its fit and number of points, by the finite series of the t distribution.

    With n - 2 degrees of freedom the squared cosine of the series' angle is 1 - r2. Null under three points.
    """
    free, sine, cos2 = n - 2, F.sqrt(r2), 1 - r2
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def series(last: Column, up: Column) -> Column:
        """1 + sum of products of (2k - 1 + up) / (2k + up) times cos2, k = 1 .. last."""
        step = lambda s, k: F.struct((s.term * cos2 * (2 * k - 1 + up) / (2 * k + up)).alias("term"), (s.total + s.term * cos2 * (2 * k - 1 + up) / (2 * k + up)).alias("total"))
        return F.when(last >= 1, F.aggregate(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), start, step, lambda s: s.total)).otherwise(1.0)

    even = sine * series((free / 2 - 1).cast("int"), F.lit(0))
    odd = F.asin(sine) + F.when(free > 1, sine * F.sqrt(cos2) * series(((free - 3) / 2).cast("int"), F.lit(1))).otherwise(0.0)
    inside = F.when(free % 2 == 0, even).otherwise(odd * 2 / F.pi())
    return F.when(free >= 1, F.greatest(F.lit(0.0), 1 - inside))


def clean_text(x: Column) -> Column:
    kept = F.regexp_replace(F.lower(F.trim(x)), r"[^a-z0-9\s]", "")
    return F.coalesce(F.trim(F.regexp_replace(kept, r"\s+", " ")), F.lit(""))


def normalise_email(x: Column) -> Column:
    """Lower case without spaces; dots and a +tag leave the local part."""
    plain = F.regexp_replace(F.lower(x), r"\s", "")
    local = F.regexp_replace(F.regexp_replace(F.substring_index(plain, "@", 1), r"\+.*$", ""), r"\.", "")
    return F.coalesce(F.when(plain.contains("@"), F.concat(local, F.substring(plain, F.instr(plain, "@"), F.length(plain)))).otherwise(plain), F.lit(""))


def normalise_phone(x: Column) -> Column:
    """Digits only; a leading 61 of 11 digits or more becomes 0."""
    digits = F.regexp_replace(x, r"\D", "")
    return F.coalesce(F.when(digits.startswith("61") & (F.length(digits) >= 11), F.concat(F.lit("0"), F.substring(digits, F.lit(3), F.length(digits)))).otherwise(digits), F.lit(""))


def normalise_address(x: Column) -> Column:
    out = F.lower(F.trim(x))
    for long, short in STREET_TYPES:
        out = F.regexp_replace(out, rf"\b{long}\b", short)
    return F.coalesce(F.trim(F.regexp_replace(F.regexp_replace(out, r"[^a-z0-9\s]", ""), r"\s+", " ")), F.lit(""))


def normalise_postcode(x: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.regexp_replace(x, r"\.0$", ""), r"\D", ""), F.lit(""))
