"""Registry of named queries and the SQL that checks them."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armlens.functions.numeric import half_even
from armlens.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its check if SQL has one."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def tidy(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every DOUBLE column, since engines add in different orders."""
    out = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if field.dataType.typeName() == "double":
            c = half_even(c, special.get(field.name, digits))
        out.append(c.alias(field.name))
    return df.select(*out)


# --- the same rules as SQL text ------------------------------------------------


def r(expr: str, digits: int = 6) -> str:
    """Half-even report rounding."""
    return f"round_even(({expr}) * 1e{digits}, 0) / 1e{digits}"


def exact_r(x: str, digits: int) -> str:
    """Rounding on the exact binary value of the column ``x``."""
    p = f"({x} * 1e{digits})"
    split = f"({x} * 134217729e0)"
    high = f"({split} - ({split} - {x}))"
    lost = f"(({high} * 1e{digits} - {p}) + ({x} - {high}) * 1e{digits})"
    tie = f"({p} - floor({p}) = 0.5)"
    return (
        f"(CASE WHEN {tie} AND {lost} > 0 THEN ceil({p}) WHEN {tie} AND {lost} < 0 THEN floor({p})"
        f" ELSE round_even({p}, 0) END / 1e{digits})"
    )


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"
