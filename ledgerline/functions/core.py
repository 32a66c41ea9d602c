"""Column helpers that pin down cross-engine semantics.

* integer casts of averages round first (a plain cast truncates);
* percentages divide by ``nullif(den, 0)`` (ANSI mode raises on /0);
* newest-first puts NULL timestamps first, as the source database does;
* money is aggregated exactly in decimal and only the result is a double;
* timestamp literals are zone-less, like the fixture columns.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts_ntz(value) -> Column:
    """Zone-less timestamp literal (folds to a constant in the plan)."""
    if isinstance(value, _dt.datetime):
        value = value.isoformat(sep=" ")
    elif isinstance(value, _dt.date):
        value = f"{value.isoformat()} 00:00:00"
    return F.expr(f"TIMESTAMP_NTZ '{value}'")


def epoch_micros(c) -> Column:
    """Microseconds since 1970-01-01 of a zone-less timestamp, independent of the
    session time zone (day number plus time-of-day fields of the NTZ value)."""
    t = col(c)
    day = F.unix_date(F.to_date(t)).cast("long")
    secs = F.hour(t).cast("long") * 3600 + F.minute(t).cast("long") * 60
    return day * 86_400_000_000 + secs * 1_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")


def as_date(value) -> _dt.date:
    """The calendar day of an as-of value (``current_date`` of the report)."""
    if isinstance(value, str):
        value = _dt.datetime.fromisoformat(value)
    return value.date() if isinstance(value, _dt.datetime) else value


def ts_minus(as_of, interval: str) -> Column:
    """``as_of - INTERVAL <interval>`` as a folded literal, e.g. ``'6' MONTH``."""
    return ts_ntz(as_of) - F.expr(f"INTERVAL {interval}")


def month_start(as_of) -> Column:
    return F.date_trunc("MONTH", ts_ntz(as_of))


def round_int(c) -> Column:
    """``x::int`` of the source database: round half away from zero, then cast."""
    return F.round(col(c)).cast("int")


def round_long(c) -> Column:
    """As ``round_int`` for sums, which outgrow four bytes."""
    return F.round(col(c)).cast("long")


def nullif(c, value) -> Column:
    return F.nullif(col(c), F.lit(value))


def blank_to_null(c) -> Column:
    """JS/Python truthiness for strings: '' counts as missing."""
    return F.nullif(col(c), F.lit(""))


def pct(num, den, scale: int = 2) -> Column:
    """round(100 * num / den, scale) in double arithmetic; NULL when den = 0."""
    return F.round(col(num).cast("double") * 100 / F.nullif(col(den), F.lit(0)), scale)


def money(c) -> Column:
    return col(c).cast("double")


def exact_mean(c) -> Column:
    """Mean of a decimal column: exact decimal sum, one double division."""
    return F.sum(col(c)).cast("double") / F.nullif(F.count(col(c)), F.lit(0))


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def sum01(cond: Column) -> Column:
    """SUM(CASE WHEN cond THEN 1 ELSE 0 END) as BIGINT."""
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def newest_first(c) -> Column:
    return col(c).desc_nulls_first()


def ymd(c) -> Column:
    """``strftime('%Y-%m-%d')`` of a timestamp."""
    return F.date_format(col(c), "yyyy-MM-dd")


def sum3(a, b, c) -> Column:
    """a + b + c with SQL NULL propagation (a NULL part drops the row from sums)."""
    return col(a) + col(b) + col(c)


def income(prefix: str = "") -> Column:
    return sum3(f"{prefix}income_receivable", f"{prefix}income_cash", f"{prefix}income_bank")


def expense(prefix: str = "") -> Column:
    return sum3(f"{prefix}expense_payable", f"{prefix}expense_cash", f"{prefix}expense_bank")


def json_quote(c) -> Column:
    """Python ``json.dumps`` of a string or None: quoted and escaped, or ``null``."""
    s = col(c)
    esc = F.regexp_replace(F.regexp_replace(s, r"\\", r"\\\\"), '"', r'\\"')
    for ch, rep in (("\n", r"\\n"), ("\r", r"\\r"), ("\t", r"\\t")):
        esc = F.regexp_replace(esc, ch, rep)
    return F.when(s.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), esc, F.lit('"')))


def spread(df, partitions: int | None = None):
    """Fan a thin input out before CPU-heavy per-row work (JSON parsing, regex). Only on request: the caller knows
    whether the scan has too few splits; a large table has enough, and would only pay for the shuffle."""
    return df if partitions is None or df.isStreaming else df.repartition(partitions)
