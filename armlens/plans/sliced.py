"""Ordered windows over keys of any size.

A plain window sorts all rows of a key in one task. Here the rows are cut along key, order and a
hash of the row in slices of about equal size, so a key with many rows, or with a burst at one time
or many rows at the very same time, lies in several slices; only rows that are equal in all columns stay
together. The window runs inside a slice, and one row per slice carries the state across.

Slices are given by their bounds, taken from a sample of fixed size, and not by where a row
happens to lie, so nothing but the bounds is kept. Slices are runs of the sorted rows, so
only keys that a bound falls into lie in more than one: at most two rows of state per bound.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sampled rows per bound.
SAMPLED = 20
#: Bounds that a row is compared with at a time.
ABREAST = 16


class Slices:
    """Rows with ``_slice``, increasing with the order within a key; NULLs first, as a sort has them.

    ``rows`` must give the same values each time they are read.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str]):
        self.keys, self.order = list(keys), [*order, "_tie"]
        rows = df.withColumn("_tie", F.xxhash64(*df.columns))
        place = F.struct(*self.keys, *self.order)
        places = rows.select(place.alias("_at"))
        bounds, kind = self._bounds(places), places.schema["_at"].dataType
        self.rows = rows.withColumn("_slice", self._slice_of(place, bounds, kind))
        self.cut = df.sparkSession.createDataFrame(
            sorted({tuple(b[: len(self.keys)]) for b in bounds}, key=repr), T.StructType(kind.fields[: len(self.keys)])
        )

    def _bounds(self, places: DataFrame) -> list[Row]:
        """The places at which slices begin but the first; their number is that of shuffle partitions."""
        slices = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        sample = places.orderBy("_at._tie").limit(SAMPLED * slices)
        found = [r["_at"] for r in sample.orderBy("_at").collect()]
        return list(dict.fromkeys(found[SAMPLED::SAMPLED]))

    def _slice_of(self, place: Column, bounds: list[Row], kind: T.StructType) -> Column:
        """How many bounds are not above a row: among every 16th, then among those between."""
        if not bounds:
            return F.lit(0)

        def listed(rows: list[Row]) -> Column:
            return F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, kind.fields)]) for r in rows])

        groups = [bounds[at : at + ABREAST] for at in range(0, len(bounds), ABREAST)]
        below = lambda rows: F.size(F.filter(rows, lambda b: b <= place))
        group = F.greatest(below(listed([g[0] for g in groups])) - 1, F.lit(0))
        return group * ABREAST + below(F.get(F.array(*[listed(g) for g in groups]), group))

    def of_cut_keys(self) -> DataFrame:
        """The rows of the keys that may lie in several slices."""
        return self.joined(self.rows, self.cut, self.keys)

    def joined(self, rows: DataFrame, few: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
        """Join rows per bound or cut key, of which there are no more than twice the slices; NULL keys are equal."""
        other = F.broadcast(few.withColumnsRenamed({k: f"_j_{k}" for k in on}))
        same = [F.col(k).eqNullSafe(F.col(f"_j_{k}")) for k in on]
        return rows.join(other, same, how).drop(*[f"_j_{k}" for k in on])

    def with_carried(self, rows: DataFrame, carried: DataFrame) -> DataFrame:
        return self.joined(rows, carried, [*self.keys, "_slice"], "left")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    minima: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add running sums and minima up to each row."""
    sums, minima, keys = dict(sums or {}), dict(minima or {}), list(keys)
    slices = Slices(df, keys, order)
    inside = Window.partitionBy(*keys, "_slice").orderBy(*slices.order)
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        slices.of_cut_keys()
        .groupBy(*keys, "_slice")
        .agg(
            *[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()],
            *[F.min(e).alias(f"_t_{n}") for n, e in minima.items()],
        )
        .select(
            *keys,
            "_slice",
            *[F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in sums],
            *[F.min(f"_t_{n}").over(before).alias(f"_c_{n}") for n in minima],
        )
    )
    own = {n: F.sum(e).over(inside) for n, e in sums.items()}
    own |= {n: F.min(e).over(inside) for n, e in minima.items()}
    out = slices.with_carried(slices.rows.withColumns(own), carried)

    def added(n: str) -> Column:
        both = F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))
        return F.when(F.coalesce(F.col(n), F.col(f"_c_{n}")).isNotNull(), both)

    total = {n: added(n) for n in sums} | {n: F.least(F.col(n), F.col(f"_c_{n}")) for n in minima}
    return out.withColumns(total).drop("_slice", "_tie", *[f"_c_{n}" for n in own])


def previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Mapping[str, str]
) -> DataFrame:
    """Add the value each column had in the row before: ``{"prev_x": "x"}``."""
    keys = list(keys)
    slices = Slices(df, keys, order)
    inside = Window.partitionBy(*keys, "_slice").orderBy(*slices.order)
    across = Window.partitionBy(*keys).orderBy("_slice")
    last = F.max_by(F.struct(*sorted(set(columns.values()))), F.struct(*slices.order))
    carried = (
        slices.of_cut_keys()
        .groupBy(*keys, "_slice")
        .agg(last.alias("_last"))
        .select(*keys, "_slice", F.lag("_last").over(across).alias("_carry"))
    )
    own = {f"_p_{n}": F.lag(c).over(inside) for n, c in columns.items()}
    first = {"_first": F.row_number().over(inside) == 1}
    out = slices.with_carried(slices.rows.withColumns(own | first), carried)
    found = {
        n: F.when(F.col("_first"), F.col("_carry")[c]).otherwise(F.col(f"_p_{n}")) for n, c in columns.items()
    }
    return out.withColumns(found).drop("_slice", "_tie", "_carry", "_first", *own)


def next_known(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Mapping[str, str]
) -> DataFrame:
    """Add the first non-NULL value at or after each row: ``{"next_x": "x"}``."""
    keys = list(keys)
    slices = Slices(df, keys, order)
    ahead = Window.partitionBy(*keys, "_slice").orderBy(*slices.order)
    ahead = ahead.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    later = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(1, Window.unboundedFollowing)
    carried = (
        slices.of_cut_keys()
        .groupBy(*keys, "_slice")
        .agg(
            *[
                F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*slices.order))).alias(f"_f_{n}")
                for n, c in columns.items()
            ]
        )
        .select(
            *keys,
            "_slice",
            *[F.first(f"_f_{n}", ignorenulls=True).over(later).alias(f"_c_{n}") for n in columns],
        )
    )
    own = {n: F.first(c, ignorenulls=True).over(ahead) for n, c in columns.items()}
    out = slices.with_carried(slices.rows.withColumns(own), carried)
    found = {n: F.coalesce(F.col(n), F.col(f"_c_{n}")) for n in columns}
    return out.withColumns(found).drop("_slice", "_tie", *[f"_c_{n}" for n in columns])
