"""Exact dedup by composable polynomial fingerprints.

A fingerprint is a pair of polynomials in the bytes of the normalised text, modulo two primes.
Chunks are hashed by themselves and combined by shifting the left one by the length of the
right one, so a huge text's chunks are hashed by many tasks. Texts of equal fingerprint and
length are then compared chunk by chunk with the one that would stay.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armlens.llm.frames import LOWER, binary, written

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 69_069_069)
#: Bytes of a chunk, and of a text above which its chunks are dealt to many tasks.
CHUNK = 1 << 20
HUGE = 1 << 25

_powers: dict[tuple[int, int], np.ndarray] = {}


def _falling(base: int, prime: int) -> np.ndarray:
    """base**i modulo prime for i up to a chunk, by doubling."""
    if (base, prime) not in _powers:
        row = np.ones(1, np.uint64)
        while len(row) < CHUNK:
            row = np.concatenate((row, row * np.uint64(pow(base, len(row), prime)) % np.uint64(prime)))
        _powers[base, prime] = row
    return _powers[base, prime]


def chunk_hash(data: bytes, primes=PRIMES) -> tuple[int, ...]:
    """Polynomials of at most one chunk; a byte counts one more than its value."""
    raw = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    return tuple(
        int((raw * _falling(b, p)[: len(raw)][::-1]).sum() % np.uint64(p)) for b, p in zip(BASES, primes)
    )


def combine(left: tuple[int, ...], right: tuple[int, ...], length: int, primes=PRIMES) -> tuple[int, ...]:
    """The fingerprint of two texts joined, ``length`` being that of the right one."""
    return tuple((x * pow(b, length, p) + y) % p for x, y, b, p in zip(left, right, BASES, primes))


def fingerprint(data: bytes, primes=PRIMES) -> tuple[int, ...]:
    out = (0,) * len(primes)
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK]
        out = combine(out, chunk_hash(part, primes), len(part), primes)
    return out


def fingerprints(docs: DataFrame, primes=PRIMES, huge: int = HUGE) -> DataFrame:
    """``doc_id, raw`` (hash of the text as it is), ``n`` (bytes), ``h1, h2, text_sha256`` per row."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("raw", F.xxhash64("text"))

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            n, h1, h2, sha = [], [], [], []
            for data in binary(batch.column(2)):
                data = data.translate(LOWER)
                a, b = fingerprint(data, primes)
                n.append(len(data)), h1.append(a), h2.append(b), sha.append(hashlib.sha256(data).hexdigest())
            made = [pa.array(x, pa.int64()) for x in (n, h1, h2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *made, pa.array(sha, pa.string())],
                ["doc_id", "raw", "n", "h1", "h2", "text_sha256"],
            )

    schema = "doc_id long, raw long, n long, h1 long, h2 long, text_sha256 string"
    usual = rows.filter(F.octet_length("text") <= huge).select("doc_id", "raw", "text").mapInArrow(small, schema)
    return usual.unionByName(_huge_fingerprints(rows.filter(F.octet_length("text") > huge), primes))


def _huge_fingerprints(rows: DataFrame, primes) -> DataFrame:
    """The same for huge texts: chunks are dealt out, hashed with their shifts, and folded in order."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("text", lower)
    rows = rows.select("row", "doc_id", "raw", F.sha2("text", 256).alias("text_sha256"), F.col("text").cast("binary").alias("data"))
    last = F.floor((F.octet_length("data") - 1) / CHUNK).cast("int")
    parts = rows.withColumn("part", F.explode(F.sequence(F.lit(0), last)))
    parts = parts.withColumn("data", F.substring("data", F.col("part") * CHUNK + 1, F.lit(CHUNK)))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {x: [] for x in ("n", "h1", "h2", "s1", "s2")}
            for data in batch.column(batch.num_columns - 1).to_pylist():
                shift = [pow(b, len(data), p) for b, p in zip(BASES, primes)]
                for name, value in zip(out, (len(data), *chunk_hash(data, primes), *shift)):
                    out[name].append(value)
            kept = {f: batch.column(k) for k, f in enumerate(("row", "doc_id", "raw", "text_sha256", "part"))}
            yield pa.RecordBatch.from_pydict(kept | {k: pa.array(v, pa.int64()) for k, v in out.items()})

    schema = "row long, doc_id long, raw long, text_sha256 string, part int, n long, h1 long, h2 long, s1 long, s2 long"
    dealt = parts.select("row", "doc_id", "raw", "text_sha256", "part", "data").repartition("row", "part")
    chunks = dealt.mapInArrow(hashed, schema)
    folded = chunks.groupBy("row", "doc_id", "raw", "text_sha256").agg(
        F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("part", "h1", "h2", "s1", "s2"))).alias("parts")
    )

    def fold(k: int) -> Column:
        return F.expr(f"aggregate(parts, 0L, (a, p) -> (a * p.s{k} + p.h{k}) % {primes[k - 1]}L)").alias(f"h{k}")

    return folded.select("doc_id", "raw", "n", fold(1), fold(2), "text_sha256")


def _chunks(rows: DataFrame) -> DataFrame:
    """Chunks of the normalised texts, one row each; an empty text has one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raws = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = [x.translate(LOWER) for x in binary(batch.column(2))]
            where = [(k, at) for k, x in enumerate(texts) for at in range(0, max(len(x), 1), CHUNK)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[k] for k, _ in where], pa.int64()),
                    pa.array([raws[k] for k, _ in where], pa.int64()),
                    pa.array([at // CHUNK for _, at in where], pa.int32()),
                    pa.array([texts[k][at : at + CHUNK] for k, at in where], pa.binary()),
                ],
                ["doc_id", "raw", "part", "data"],
            )

    return rows.mapInArrow(cut, "doc_id long, raw long, part int, data binary")


KEYS = ["h1", "h2", "n", "level"]


def _groups(prints: DataFrame) -> DataFrame:
    return prints.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("size"), F.max(F.struct("doc_id", "raw")).alias("stay")
    )


def _unequal(docs: DataFrame, prints: DataFrame, groups: DataFrame) -> DataFrame:
    """``doc_id, raw`` of rows whose text differs from that of the row their group would keep."""
    several = groups.filter("size > 1")
    members = prints.join(several, KEYS).select("doc_id", "raw", "stay").distinct()
    members = written(members, "exact-members")
    wanted = members.select("doc_id", "raw").withColumnsRenamed({"doc_id": "_id", "raw": "_raw"})
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # Dealt by id at every size: a broadcast of the ids would grow with the copies.
    texts = texts.withColumn("raw", F.xxhash64("text")).join(
        wanted.hint("shuffle_merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("raw") == F.col("_raw")), "left_semi"
    )
    chunks = written(_chunks(texts.select("doc_id", "raw", "text")), "exact-chunks")
    mine = members.filter(
        ~(F.col("stay.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("stay.raw") == F.col("raw")))
    ).withColumnsRenamed({"doc_id": "_id", "raw": "_raw"})
    mine = chunks.join(mine, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("raw") == F.col("_raw")))
    mine = mine.select(
        F.col("_id").alias("doc_id"), F.col("_raw").alias("raw"), "part", "data",
        F.col("stay.doc_id").alias("_id"), F.col("stay.raw").alias("_stay"),
    )
    theirs = chunks.withColumnsRenamed({"doc_id": "t_id", "raw": "t_raw", "part": "t_part", "data": "t_data"})
    both = mine.join(
        theirs,
        F.col("_id").eqNullSafe(F.col("t_id")) & (F.col("_stay") == F.col("t_raw")) & (F.col("part") == F.col("t_part")),
    )
    return both.filter("data <> t_data").select("doc_id", "raw").distinct()


def dedup(docs: DataFrame, primes=PRIMES, huge: int = HUGE) -> DataFrame:
    """One row per document row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal if identical after lower-casing A-Z; a null text is an empty one. Of equal
    texts the row with the largest id stays, a null id being the smallest; of rows that
    repeat both id and text one stays. Texts that only share a fingerprint are told apart: those
    that differ from the row their group would keep form the next group, until none differs.
    """
    prints = written(fingerprints(docs, primes, huge).withColumn("level", F.lit(0)), "exact-prints")
    level = 0
    while True:
        groups = written(_groups(prints), "exact-groups")
        now = _unequal(docs, prints.filter(F.col("level") == level), groups.filter(F.col("level") == level))
        now = written(now.withColumnsRenamed({"doc_id": "_id", "raw": "_raw"}), "exact-unequal")
        if now.isEmpty():
            break
        moved = prints.join(
            now.withColumn("_moved", F.lit(1)),
            F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("raw") == F.col("_raw")) & (F.col("level") == level),
            "left",
        )
        prints = written(
            moved.withColumn("level", F.col("level") + F.coalesce("_moved", F.lit(0))).select(*prints.columns), "exact-prints"
        )
        level += 1
    same = Window.partitionBy("doc_id", "text_sha256").orderBy("raw")
    rows = prints.withColumn("copy", F.row_number().over(same)).join(groups, KEYS)
    stays = F.col("doc_id").eqNullSafe(F.col("stay.doc_id")) & (F.col("copy") == 1)
    return rows.select(
        "doc_id", F.col("stay.doc_id").alias("keep_id"), F.col("size").alias("group_size"), stays.alias("kept"), "text_sha256"
    )


ORACLE = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)"""
