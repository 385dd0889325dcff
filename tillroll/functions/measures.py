"""Shared measure expressions.

Conventions (they keep results identical across engines):

* money is summed as exact decimals and converted to double only at the end;
* every percentage is ``round(100 * num / den, scale)``, half away from zero
  on the exact value, NULL (not an error) for a zero denominator;
* averages are ``round(sum / count, 2)`` in exact decimal arithmetic (money
  averages hit exact half-cent ties often; a double would round them down);
* margin is always a ratio of totals, never a mean of row ratios.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(c: str | Column) -> Column:
    return col(c).cast("double")


def money(c: str | Column) -> Column:
    """Exact decimal sum converted to double for output."""
    return F.sum(col(c)).cast("double")


def ratio_pct(num: str | Column, den: str | Column, scale: int = 2) -> Column:
    """round(100 * num / den, scale), half away from zero on the *exact* value;
    NULL when den is 0 or NULL.  ``num`` and ``den`` are exact (decimal or
    integer).

    The quotient is taken in double; the one case a double can round the
    wrong way - an exact half-way value such as 49.995, stored as
    49.99499... - is detected with exact decimal multiplication (no
    division) and rounded up in magnitude.
    """
    q = F.try_divide(F.lit(100.0) * dbl(num), dbl(den))
    unit = 10 ** scale
    m = F.floor(F.abs(q) * unit)
    exact_num = F.abs(col(num).cast("decimal(38,4)")) * F.lit(200 * unit)
    exact_half = (m * 2 + 1).cast("decimal(38,0)") * F.abs(col(den).cast("decimal(38,4)"))
    tie = exact_num == exact_half
    return F.when(tie, F.signum(q) * (m + 1) / unit).otherwise(F.round(q, scale))


def margin_pct(profit: str | Column = "profit", revenue: str | Column = "revenue",
               scale: int = 2) -> Column:
    """Ratio of totals over already aggregated columns."""
    return ratio_pct(profit, revenue, scale)


def sum_margin_pct(profit: str | Column = "profit", amount: str | Column = "amount",
                   scale: int = 2) -> Column:
    """Aggregate: 100 * sum(profit) / sum(amount)."""
    return ratio_pct(F.sum(col(profit)), F.sum(col(amount)), scale)


def per(num: str | Column, den: str | Column, scale: int = 2) -> Column:
    """round(num / den, scale) for an exact numerator (decimal or integer) over a
    count, computed exactly in decimal (half away from zero); NULL for 0."""
    return F.round(F.try_divide(col(num).cast("decimal(38,10)"), col(den).cast("decimal(20,0)")),
                   scale)


def per_double(num: str | Column, den: str | Column, scale: int = 2) -> Column:
    """round(num / den, scale) in double arithmetic (for double numerators)."""
    return F.round(F.try_divide(dbl(num), dbl(den)), scale)


def avg2(c: str | Column, scale: int = 2) -> Column:
    """Aggregate mean of a decimal or integer column, rounded exactly."""
    return F.round(F.try_divide(F.sum(col(c)).cast("decimal(38,10)"), F.count(col(c))), scale)


def share_pct(part: str | Column, total: str | Column, scale: int = 1) -> Column:
    return ratio_pct(part, total, scale)


def count_true(cond: Column) -> Column:
    """SUM(boolean) of the SQL original; Spark wants count_if."""
    return F.count_if(cond)


def bigint(c: str | Column) -> Column:
    return col(c).cast("bigint")
