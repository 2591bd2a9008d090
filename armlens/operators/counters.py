"""Counter scrapes: parse exposition lines, acceptance rate, rate between scrapes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armlens import schema as S
from armlens.functions.numeric import exact_round, ratio
from armlens.plans.sliced import next_known, previous


def parse_counters(log: DataFrame) -> DataFrame:
    """Name, labels and value (the last field) of every line that is no comment."""
    return log.filter(~F.col("line").startswith("#")).select(
        "server",
        "scrape_ts",
        "line_no",
        F.regexp_extract("line", r"^([A-Za-z_:][A-Za-z0-9_:]*)", 1).alias("name"),
        F.regexp_extract("line", r"\{([^}]*)\}", 1).alias("labels"),
        F.element_at(F.split(F.rtrim("line"), r"\s+"), -1).try_cast("double").alias("value"),
    )


def scrape_rates(log: DataFrame) -> DataFrame:
    """Acceptance rate of each scrape: the gauge, else accepted over drafted."""
    parsed = parse_counters(log)

    def at(name: str):
        return F.when(F.contains(F.col("name"), F.lit(name)), F.col("line_no"))

    counted = parsed.groupBy("server", "scrape_ts").agg(
        F.min_by("value", at(S.GAUGE_NAME)).alias("gauge"),
        F.max_by("value", at(S.ACCEPTED_NAME)).alias("accepted"),
        F.max_by("value", at(S.DRAFTED_NAME)).alias("drafted"),
    )
    rate = F.coalesce(F.col("gauge"), ratio("accepted", "drafted"))
    return (
        counted.withColumn("acceptance_rate", rate)
        .withColumn("acceptance_rate", exact_round("acceptance_rate", 4))
        .withColumn("micros", F.unix_micros(F.col("scrape_ts").cast("timestamp")))
    )


def counter_rates(rates: DataFrame) -> DataFrame:
    """Add the rate since the scrape before. A counter that fell was reset to zero."""
    pairs = previous(
        rates,
        ["server"],
        ["micros"],
        {"_accepted0": "accepted", "_drafted0": "drafted"},
    )
    reset = F.col("drafted") < F.col("_drafted0")

    def step(now: str, before: str):
        return F.when(reset, F.col(now)).otherwise(F.col(now) - F.col(before))

    accepted, drafted = step("accepted", "_accepted0"), step("drafted", "_drafted0")
    return (
        pairs.withColumns({"accepted_step": accepted, "drafted_step": drafted})
        .withColumn("step_rate", ratio("accepted_step", "drafted_step"))
        .withColumn("step_rate", exact_round("step_rate", 4))
        .drop("_accepted0", "_drafted0")
    )


def acceptance_after(cells: DataFrame, rates: DataFrame) -> DataFrame:
    """Attach to each cell end (server, end_us, ...) the first scrape at or after it.

    Cells and scrapes become one ordered sequence per server, so nothing is
    joined by range.
    """
    own = [c for c in cells.columns if c not in ("server", "end_us")]
    marks = cells.select(
        "server",
        F.col("end_us").alias("micros"),
        F.lit(0).alias("_kind"),
        F.struct(*own).alias("_cell"),
    )
    points = rates.filter(F.col("acceptance_rate").isNotNull()).select(
        "server",
        "micros",
        F.lit(1).alias("_kind"),
        F.struct("micros", "acceptance_rate").alias("_scrape"),
    )
    merged = marks.unionByName(points, allowMissingColumns=True)
    ahead = next_known(merged, ["server"], ["micros", "_kind"], {"_next": "_scrape"})
    return ahead.filter(F.col("_kind") == 0).select(
        "server",
        F.col("micros").alias("end_us"),
        "_cell.*",
        F.col("_next.micros").alias("scrape_us"),
        F.col("_next.acceptance_rate").alias("acceptance_rate"),
    )


def attach_cell_acceptance(requests: DataFrame, cell_rates: DataFrame) -> DataFrame:
    """Copy a cell's acceptance rate onto its treatment requests."""
    rates = cell_rates.select(*S.CELL, F.col("acceptance_rate").alias("_rate"))
    return (
        requests.join(rates, S.CELL, "left")
        .withColumn("acceptance_rate", F.when(F.col("system") == "eagle3", F.col("_rate")))
        .drop("_rate")
    )
