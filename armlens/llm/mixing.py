"""Mixing sources to target weights by highest quotients, as DataFrame expressions.

Every source's words, in a seeded order of its documents, are cut into blocks of equal size.
The blocks of the mix are apportioned to the sources by the quotients target / (2k + 1)
(Sainte-Lague), and each source's blocks to its shards by the same rule. A shard takes its
first blocks in the seeded order, a second time through where it takes more than it has, so
all but one of its documents are taken whole.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armlens.llm.frames import written

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)  # of all words
CAP = 2
BLOCK_WORDS = 32
SHARD_WORDS = 1 << 20
SEED = "mix-1"

WORD = r"[^\x20\x09-\x0D]+"


def _order(seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _size(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _tag() -> Column:
    """The source as a key without nulls."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def targets(sized: DataFrame) -> DataFrame:
    """``source, source_size, target``: shares by weight, none above ``CAP`` times its source.

    What a capped source leaves goes to the others by weight. With the caps sorted by cap per
    weight, the sources up to some place are capped and the rest share evenly by weight.
    """
    per = sized.groupBy("source").agg(F.sum("_size").alias("source_size"))
    rank = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(rank) - 1) % len(WEIGHTS) + 1).cast("int"))
    per = per.select("source", "source_size", weight.cast("long").alias("weight"))
    by_cap = Window.orderBy(F.col("source_size") * F.lit(30).cast("long") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    cap = F.col("source_size") * CAP
    total = F.sum("source_size").over(every) * SHARE[0] / SHARE[1]
    left = total - F.coalesce(F.sum(cap).over(before), F.lit(0))
    weights_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.select(
        "source", "source_size", "weight", cap.alias("cap"), left.alias("left"), weights_left.alias("weights_left"),
        F.row_number().over(by_cap).alias("place"),
    )
    fits = F.col("left") * F.col("weight") <= F.col("cap") * F.col("weights_left")
    first = F.min(F.when(fits, F.struct("place", "left", "weights_left"))).over(every)
    per = per.withColumn("first", first)
    shared = F.col("first.left") * F.col("weight") / F.col("first.weights_left")
    capped = F.col("first").isNull() | (F.col("place") < F.col("first.place"))
    return per.select("source", "source_size", F.when(capped, F.col("cap")).otherwise(shared).cast("double").alias("target"))


def apportion(claims: DataFrame, keys: list[str], group: list[str], seats: Column) -> DataFrame:
    """Seats for each claim by highest quotients claim / (2k + 1), within each ``group``.

    ``claims`` has ``claim`` (double) and ``most`` (long, the seats it can hold). The divisor that
    hands out all seats lies within half a seat per party of the ideal one, so only quotients
    near the ideal share can be in doubt: the sure ones are counted, the others ranked.
    """
    whole = Window.partitionBy(*group)
    df = claims.withColumn("seats", seats)
    df = df.withColumns({"parties": F.count(F.lit(1)).over(whole), "claims": F.sum("claim").over(whole)})
    ideal = F.when(F.col("claims") > 0, F.col("claim") * F.col("seats") / F.col("claims")).otherwise(F.lit(0.0))
    df = df.withColumn("ideal", ideal)
    doubt = F.col("ideal") * F.col("parties") * 3 / (2 * F.greatest(F.col("seats"), F.lit(1))) + 2
    low = F.least(F.greatest(F.floor(F.col("ideal") - doubt), F.lit(0)), F.col("most"))
    high = F.least(F.ceil(F.col("ideal") + doubt), F.col("most"))
    df = df.withColumns({"low": low.cast("long"), "high": high.cast("long")})
    df = df.withColumn("open", F.col("seats") - F.sum("low").over(whole))
    ks = F.when(F.col("high") > F.col("low"), F.sequence(F.col("low"), F.col("high") - 1))
    parts = df.select(*keys, "low", "open", "claim", F.explode_outer(ks).alias("k"))
    quotient = F.col("claim") / (2 * F.col("k") + 1)
    place = F.row_number().over(
        Window.partitionBy(*group).orderBy(quotient.desc_nulls_last(), *[F.col(k).asc_nulls_last() for k in keys], "k")
    )
    won = (F.col("k").isNotNull() & (place <= F.col("open"))).cast("long")
    return (
        parts.withColumn("won", won).groupBy(*keys).agg((F.first("low") + F.sum("won")).alias("quota"))
    )


@dataclass
class Plan:
    """Targets and numbers of shards by source, and words to take by shard; both written."""

    sources: DataFrame
    shards: DataFrame
    seed: str

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Rows of documents with their source's figures and the shard of their id."""
        spot = F.conv(F.substring(_order(self.seed), 1, 8), 16, 10).cast("long")
        return rows.withColumn("_tag", _tag()).join(self.sources, "_tag").withColumn("_shard", spot % F.col("_shards"))

    def taken(self, rows: DataFrame) -> DataFrame:
        """Rows of documents with ``_taken``, the words that the mix takes of each."""
        in_order = (
            Window.partitionBy("_tag", "_shard").orderBy(_order(self.seed), "doc_id", "_size")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        placed = self.dealt(rows).withColumn("_upto", F.sum("_size").over(in_order)).join(self.shards, ["_tag", "_shard"])
        start = F.col("_upto") - F.col("_size")
        first = F.greatest(F.least(F.col("_words") - start, F.col("_size")), F.lit(0))
        second = F.greatest(F.least(F.col("_words") - F.col("_shard_size") - start, F.col("_size")), F.lit(0))
        return placed.withColumn("_taken", first + second)


def plan(sized: DataFrame, block_words: int, shard_words: int, seed: str) -> Plan:
    """Targets of the sources, blocks of each source, blocks of each of its shards."""
    per = targets(sized).select(
        _tag().alias("_tag"),
        F.col("source_size").alias("_source_size"),
        F.col("target").alias("_target"),
        F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).cast("long").alias("_shards"),
    )
    out = Plan(written(per, "mix-sources"), None, seed)
    claims = out.sources.select(
        "_tag", F.col("_target").alias("claim"), F.ceil(F.col("_source_size") * CAP / block_words).cast("long").alias("most")
    )
    seats = F.round(F.sum("claim").over(Window.partitionBy()) / block_words).cast("long")
    quotas = apportion(claims, ["_tag"], [], seats).select("_tag", F.col("quota").alias("blocks"))
    parts = out.dealt(sized).groupBy("_tag", "_shard").agg(F.sum("_size").alias("_shard_size"))
    claims = parts.join(quotas, "_tag").withColumns(
        {"claim": F.col("_shard_size").cast("double"), "most": F.ceil(F.col("_shard_size") * CAP / block_words).cast("long")}
    )
    by_shard = apportion(claims, ["_tag", "_shard"], ["_tag"], F.col("blocks"))
    shards = parts.join(by_shard, ["_tag", "_shard"])
    shards = shards.select("_tag", "_shard", "_shard_size", (F.col("quota") * block_words).alias("_words"))
    out.shards = written(shards, "mix-shards")
    return out


def _sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, _size``, written: the texts are counted once."""
    return written(docs.select("doc_id", "source", _size().alias("_size")), "mix-sizes")


def mix(
    docs: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: str = SEED
) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, taken``.

    ``taken`` counts the words the mix takes, repeats included: none, a part, all, all and a part,
    or all twice. A null source is a source of its own, after all others; a null text has size 0;
    rows that repeat an id are taken one by one, in the order of their sizes. An empty table gives an
    empty result.
    """
    sized = _sized(docs)
    rows = plan(sized, block_words, shard_words, seed).taken(sized)
    return rows.select(
        "doc_id",
        "source",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        F.col("_taken").alias("taken"),
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix: each as often as it is taken, a part as the text's first words.

    All columns stay; ``n_chars`` follows the text where there is such a column.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc")
    rows = plan(_sized(docs), BLOCK_WORDS, SHARD_WORDS, SEED).taken(
        docs.select("doc_id", "source", _size().alias("_size"), whole)
    )
    has = F.col("_size") > 0
    full = F.when(has, F.floor(F.col("_taken") / F.col("_size"))).otherwise(F.lit(0)).cast("int")
    part = F.when(has, F.col("_taken") % F.col("_size")).otherwise(F.lit(0))
    head = F.expr(
        r"regexp_extract(_doc.text, concat(r'^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){', _part, '}+'), 0)"
    )
    texts = F.concat(
        F.array_repeat("_doc.text", F.col("_full")),
        F.when(F.col("_part") > 0, F.array(head)).otherwise(F.array().cast("array<string>")),
    )
    rows = rows.select("_doc", part.alias("_part"), full.alias("_full")).select("_doc", F.explode(texts).alias("_text"))
    changed = F.col("_doc").withField("text", F.col("_text"))
    if "n_chars" in docs.columns:
        changed = changed.withField("n_chars", F.length("_text").cast(docs.schema["n_chars"].dataType))
    return rows.select(changed.alias("_doc")).select("_doc.*")


def _sql(block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: str = SEED) -> str:
    """The same by ranking every quotient."""
    weights = ", ".join(map(str, WEIGHTS))
    return f"""
WITH d AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS tag, md5('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS spot,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents),
p AS (
  SELECT tag, source, sum(size)::BIGINT AS source_size,
         [{weights}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight
  FROM d GROUP BY tag, source),
c AS (
  SELECT tag, source_size, weight, {CAP} * source_size AS cap, row_number() OVER o AS place,
         (sum(source_size) OVER () * {SHARE[0]} / {SHARE[1]})::DOUBLE
           - coalesce(sum({CAP} * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open
  FROM p WINDOW o AS (ORDER BY source_size * 30 / weight, source NULLS LAST)),
f AS (SELECT min(place) AS place FROM c WHERE rest * weight <= cap * open),
t AS (
  SELECT tag, source_size, greatest(ceil(source_size / {shard_words}), 1)::BIGINT AS shards,
         CASE WHEN f.place IS NULL OR c.place < f.place THEN cap::DOUBLE
              ELSE (SELECT x.rest FROM c AS x, f AS y WHERE x.place = y.place) * weight
                   / (SELECT x.open FROM c AS x, f AS y WHERE x.place = y.place) END AS target
  FROM c, f),
q AS (
  SELECT tag, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, tag, k) AS place
  FROM (SELECT tag, target, unnest(range(ceil(source_size * {CAP} / {block_words})::BIGINT)) AS k FROM t)),
b AS (
  SELECT tag, count(*) AS blocks FROM q WHERE place <= (SELECT round(sum(target) / {block_words}) FROM t) GROUP BY tag),
r AS (SELECT d.*, t.source_size, t.target, ('0x' || spot[:8])::BIGINT % t.shards AS shard FROM d JOIN t USING (tag)),
h AS (SELECT tag, shard, sum(size)::BIGINT AS shard_size FROM r GROUP BY tag, shard),
g AS (
  SELECT tag, shard, row_number() OVER (PARTITION BY tag ORDER BY shard_size::DOUBLE / (2 * k + 1) DESC, shard, k) AS place
  FROM (SELECT *, unnest(range(ceil(shard_size * {CAP} / {block_words})::BIGINT)) AS k FROM h)),
w AS (SELECT tag, shard, count(*) * {block_words} AS words FROM g JOIN b USING (tag) WHERE place <= blocks GROUP BY tag, shard),
u AS (
  SELECT r.*, shard_size, coalesce(words, 0) AS words,
         sum(size) OVER (PARTITION BY tag, shard ORDER BY spot, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS start
  FROM r JOIN h USING (tag, shard) LEFT JOIN w USING (tag, shard))
SELECT doc_id, size, source_size, target,
       (greatest(least(words - start, size), 0) + greatest(least(words - shard_size - start, size), 0))::BIGINT AS taken
FROM u"""


ORACLE = _sql()
