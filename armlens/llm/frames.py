"""Written intermediate tables, byte tables and Arrow helpers shared by the operators."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from armlens.session import shared_dir

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
"""Byte table: A-Z in lower case, all else as it is."""

WORDS = bytes(
    LOWER[b] if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
"""Byte table: lower case, and a space for each ASCII byte that is no letter or digit."""

BLANKS = bytes(32 if b == 32 or 9 <= b <= 13 else b for b in range(256))
"""Byte table: a space for each ASCII white space, all else as it is."""


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """The rows through a table in the shared folder, in subfolders of ``by``: the lineage ends
    here and lost executors cost no recomputation."""
    path = shared_dir(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    rest = F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4
    return F.coalesce(rest == 2, F.lit(False))


def binary(array: pa.Array) -> list[bytes]:
    """The texts of a column as UTF-8, nulls as empty texts."""
    kind = pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()
    return [x or b"" for x in array.cast(kind).to_pylist()]


def rows_of(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
    """Apply ``make`` to each batch; an empty batch gives nothing."""
    for batch in batches:
        if batch.num_rows:
            yield make(batch)


# Hashes of words: prefix sums of byte * POWER**i, shifted back to the start of the word.

POWER = np.uint64(0x9E3779B97F4A7C15 | 1)
STEP = 1 << 20
_powers: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _powers:
        inverse = np.uint64(pow(int(POWER), -1, 1 << 64))
        with np.errstate(over="ignore"):
            for name, base in (("up", POWER), ("down", inverse)):
                row = np.full(STEP + 1, base, np.uint64)
                row[0] = 1
                _powers[name] = np.cumprod(row, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """One 64-bit hash per word of space-separated bytes, in steps of bounded memory."""
    up, down = _tables()
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + STEP)
        if end < len(data):
            cut = data.rfind(b" ", at, end) + 1
            if cut <= at:  # one word longer than a step
                cut = data.find(b" ", end) + 1 or len(data)
                long = data[at:cut].split()
                out.append(np.array([_long_word(w) for w in long], np.uint64))
                at = cut
                continue
            end = cut
        raw = np.frombuffer(data, np.uint8, end - at, at)
        space = np.concatenate(([True], raw == 32, [True]))
        edge = np.flatnonzero(space[1:] != space[:-1])
        start, stop = edge[::2], edge[1::2]
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
        out.append(mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _long_word(word: bytes) -> int:
    import hashlib

    if len(word) <= STEP:
        return int(word_hashes(word)[0])
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words; of all words where there are fewer, none for none."""
    k = min(k, len(words))
    if not k:
        return words
    up, down = _tables()
    n = len(words) - k + 1
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += words[j : j + n] * up[2 * j + 1]
    return mix(total + np.uint64(k))


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))
