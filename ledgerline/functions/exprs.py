"""Column expressions shared by the operators (all JVM-side, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed thresholds of the reference's tiering rules.
INVENTORY_TIERS = ((0.85, "CRITICAL"), (0.65, "HIGH"), (0.35, "MEDIUM"))
DELAY_TIERS = ((0.85, "CRITICAL"), (0.7, "HIGH"), (0.4, "MEDIUM"))
SUPPLIER_TIERS = ((70.0, "CRITICAL"), (45.0, "HIGH"), (25.0, "MEDIUM"))
PRIORITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tier(x, thresholds, default: str = "LOW", strict: bool = False) -> Column:
    """Chained ``when``: first threshold met (>=, or > when strict) gives its label."""
    x = c(x)
    out = None
    for thr, label in thresholds:
        cond = (x > thr) if strict else (x >= thr)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(default)


def is_missing(x) -> Column:
    """Null or whitespace-only text (the reference's 'missing')."""
    x = c(x)
    return x.isNull() | (F.trim(x.cast("string")) == "")


def to_double(x) -> Column:
    """Parse a raw value to double; unparseable -> null (never an exception)."""
    return F.trim(c(x).cast("string")).try_cast("double")


_TIME = (r"(?:[T\s]+(?:[01]?\d|2[0-3])(?::[0-5]\d(?::[0-5]\d(?:[.,]\d+)?)?)?\s*(?:[AaPp][Mm])?\s*(?:Z|UTC|GMT|[+-]\d{2}:?\d{2})?)?")
_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
_GAP = r"[\s./,-]+"
#: Written forms of a date and where year, month and day stand in them; a time of day may follow any of them.
DATE_FORMS = (
    (r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", (1, 2, 3)),
    (r"(\d{4})(\d{2})(\d{2})", (1, 2, 3)),
    (r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})", (3, 1, 2)),
    (rf"(\d{{1,2}})(?:st|nd|rd|th)?[\s./-]*({_MONTH}){_GAP}(\d{{4}}|\d{{2}})", (3, 2, 1)),
    (rf"({_MONTH}){_GAP}(\d{{1,2}})(?:st|nd|rd|th)?{_GAP}(\d{{4}})", (3, 1, 2)),
    (rf"(\d{{4}}){_GAP}({_MONTH}){_GAP}(\d{{1,2}})", (1, 2, 3)),
)


def _any_form() -> tuple[str, str]:
    """One pattern for all forms, and its replacement: year, month, day and, for month/day/year in numbers, the separator,
    each behind a control character. Groups of the forms that don't match are empty."""
    patterns, groups, n = [], ([], [], [], []), 0
    for form, order in DATE_FORMS:
        numbers = order == (3, 1, 2) and form.startswith("(\\d")
        patterns.append(form.replace("[-/.]", "([-/.])", 1) if numbers else form)
        places = [order[0] + 1, order[1], order[2] + 1] if numbers else list(order)
        for name, place in zip(groups, places + ([2] if numbers else []), strict=False):
            name.append(n + place)
        n += 4 if numbers else 3
    return rf"(?i)^(?:{'|'.join(patterns)}){_TIME}$", "".join("\x01" + "".join(f"${g}" for g in name) for name in groups)


_WHOLE, _PARTS = _any_form()


def to_date_lenient(x, this_year: Column | int | None = None) -> Column:
    """Parse a raw value to a date; unparseable -> null.

    Accepts the usual written forms, alone or with a time of day (whose zone is
    not applied: the date is the one written): year first with ``- / .`` or
    nothing between, month/day/year (day first where the first number can't be
    a month), and English month names. Two-digit years are the ones within 50 years of ``this_year`` (today's).
    ISO dates are cast; anything else is rewritten by one pattern to its year, month and day.
    """
    text = F.trim(c(x).cast("string"))
    now = F.year(F.current_date()) if this_year is None else F.lit(this_year)

    def date(p: Column) -> Column:
        year, month, day = p[1], p[2], p[3]
        number = F.position(F.substring(month, 1, 3), F.lit("janfebmaraprmayjunjulaugsepoctnovdec"))
        month = F.when(month.rlike("^[a-z]"), ((number + 2) / 3).cast("int").cast("string")).otherwise(month)
        near = now - now % 100 + year.try_cast("int")
        near = F.when(near >= now + 50, near - 100).when(near < now - 50, near + 100).otherwise(near)
        year = F.when(F.length(year) == 2, near.cast("string")).otherwise(year)
        swap = (p[4] != "") & (month.try_cast("int") > 12)
        return F.try_to_timestamp(F.concat_ws("-", year, F.when(swap, day).otherwise(month), F.when(swap, month).otherwise(day)), F.lit("y-M-d")).cast("date")

    plain = F.lower(F.regexp_replace(F.translate(text, "\x01", "?"), r"^[A-Za-z]{3,9},\s*", ""))
    parts = F.split(F.regexp_replace(plain, _WHOLE, _PARTS), "\x01")
    written = F.transform(F.array(parts), lambda p: F.when(F.size(p) == 5, date(p)))[0]  # the parts are made once
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date")).otherwise(written)


def truthy(x) -> Column:
    """Text/number flag -> 0/1; {1, true, yes, y, t} are true, null -> 0."""
    s = F.lower(F.trim(c(x).cast("string")))
    num = s.try_cast("double")
    return F.when(s.isin("1", "true", "yes", "y", "t") | (F.coalesce(num, F.lit(0.0)) != 0), 1).otherwise(0)


def weekday0(x) -> Column:
    """Monday = 0 ... Sunday = 6 (pandas ``dayofweek``)."""
    return F.weekday(c(x))


def logistic_tail(z) -> Column:
    """1 / (1 + e^z); e^z overflows to +inf for large z, giving 0.0 (not an error)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(c(z)))


def clip(x, lo, hi) -> Column:
    return F.least(F.greatest(c(x), F.lit(lo)), F.lit(hi))


def nullif_zero(x) -> Column:
    """``x or default`` in Python treats 0 as missing: use coalesce(nullif(x, 0), default)."""
    x = c(x)
    return F.when(x != 0, x)


def ceil_long(x) -> Column:
    return F.ceil(c(x)).cast("long")


def round_stable(x, n: int) -> Column:
    """Round at ``n`` decimals after a first rounding at 9.

    Engines round a double differently when it sits one ulp below a decimal
    tie (28.724999999999998): Spark goes by the shortest decimal string, float
    arithmetic by ``x * 10^n``. Rounding to 9 decimals first turns such values
    into clean ties that every engine rounds the same way.
    """
    return F.round(F.round(c(x), 9), n)


def present_keys(df, preferred, fallbacks=()) -> list[str]:
    """Tie-break columns for a stable record order: ``preferred`` if the frame has them all, otherwise
    whichever ``fallbacks`` it has (e.g. an imported table's external id). May be empty."""
    if all(c in df.columns for c in preferred):
        return list(preferred)
    return [c for c in fallbacks if c in df.columns]
