"""Rounding and null-safe arithmetic."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_even(c, digits: int) -> Column:
    """Scale, round half to even, unscale: the rule of report tables."""
    scale = F.lit(float(10**digits))
    return F.rint(col(c) * scale) / scale


def exact_round(name: str, digits: int) -> Column:
    """Round on the exact binary value: the rule of logged per-request numbers.

    ``x * scale`` may round onto an apparent tie. The lost part of the product is
    recovered by splitting ``x`` in two 26-bit halves, and decides such a tie. Takes
    a column, not an expression, since it is named many times.
    """
    x, scale = f"`{name}`", f"{10**digits}D"
    product = f"({x} * {scale})"
    high = f"({x} * 134217729D - ({x} * 134217729D - {x}))"
    lost = f"(({high} * {scale} - {product}) + ({x} - {high}) * {scale})"
    return F.expr(
        f"""CASE WHEN {product} - floor({product}) = 0.5D AND {lost} > 0 THEN double(ceil({product}))
        WHEN {product} - floor({product}) = 0.5D AND {lost} < 0 THEN double(floor({product}))
        ELSE rint({product}) END / {scale}"""
    )


def ratio(a, b) -> Column:
    """a / b, NULL when b is zero or either side is missing."""
    return F.try_divide(col(a), col(b))


def not_nan(c) -> Column:
    """A NaN token in a JSON log means a missing value."""
    return F.nanvl(col(c), F.lit(None).cast("double"))


def exact_mean(c, digits: int = 2) -> Column:
    """Mean of values logged with a fixed number of decimals. The sum is a decimal,
    so it is the same in whatever order the rows arrive."""
    total = F.sum(col(c).cast(f"decimal(20,{digits})")).cast("double")
    return ratio(total, F.count(col(c)).cast("double"))


def percent(c, digits: int = 0) -> Column:
    return F.format_string(f"%.{digits}f%%", col(c) * 100)


def times(c) -> Column:
    return F.format_string("%.2f×", col(c))


def usd(c, digits: int = 4) -> Column:
    return F.format_string(f"$%.{digits}f", col(c))
