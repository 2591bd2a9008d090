"""Quality classifier: regularised quadratic discriminant over statistics of a document.

Each text becomes a short vector of transformed statistics. The classes' means and covariances
come from sums over all labelled rows; covariances are shrunk towards their diagonal; a score is
the logistic of the difference of two log densities, each a Mahalanobis distance by a cached
Cholesky factor.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armlens.llm.frames import BLANKS, binary, held_out, rows_of, written

SHRINK = 0.1
FLOOR = 1e-3
THRESHOLD = 0.7
STATISTICS = (
    "bytes", "words", "lines", "upper", "digit", "symbol", "pipe", "high", "stop", "word_length",
    "long_word", "distinct", "lines_distinct", "symbol_words", "upper_words", "ended_lines",
)

_CLASS = np.zeros((6, 256))
for _row, _bytes in enumerate(
    (range(65, 91), range(48, 58), b"#$%&*!~^=_@<>{}[]\\`+", b"|", range(128, 256), b".,;:?")
):
    _CLASS[_row, list(_bytes)] = 1


def _share(part: float, whole: float) -> float:
    """Log odds of a share, finite for none and all."""
    return float(np.log((part + 0.5) / (max(whole - part, 0) + 0.5)))


def statistics(data: bytes) -> list[float]:
    """The transformed statistics of one whole text; all are finite, also of an empty one."""
    size = len(data)
    counts = _CLASS @ np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.translate(BLANKS).split()
    n, seen = len(words), set(words)
    lines = [x for x in data.split(b"\n") if x]
    letters = sum(len(w) for w in words)
    odd = sum(map(bytes.isalnum, (w.strip(b".,;:?!") for w in seen)))
    shout = sum(map(bytes.isupper, seen))
    ended = sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines)
    upper, digit, symbol, pipe, high, stop = counts
    return [
        np.log1p(size), np.log1p(n), np.log1p(len(lines)),
        _share(upper, size), _share(digit, size), _share(symbol, size), _share(pipe, size), _share(high, size),
        _share(stop, size), np.log1p(letters / max(n, 1)), np.log1p(max(map(len, seen), default=0)),
        _share(len(seen), n), _share(len(set(lines)), len(lines)),
        _share(odd, len(seen)), _share(shout, len(seen)), _share(ended, len(lines)),
    ]


def described(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``x``, the statistics of the text; a null text is an empty one."""
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = pa.array([statistics(t) for t in binary(batch.column(1))], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([batch.column(0), x], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda batches: rows_of(batches, make), "doc_id long, x array<double>")


@dataclass
class Gaussian:
    """A class: its log prior, mean and inverse Cholesky factor with the log determinant."""

    log_prior: float
    mean: np.ndarray
    whiten: np.ndarray
    log_det: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        far = (x - self.mean) @ self.whiten.T
        return self.log_prior - 0.5 * (far * far).sum(axis=1) - 0.5 * self.log_det


def gaussian(n: float, total: np.ndarray, square: np.ndarray, prior: float, shrink: float) -> Gaussian:
    mean = total / n
    spread = square / n - np.outer(mean, mean)
    diagonal = np.diag(np.maximum(np.diag(spread), FLOOR))
    factor = np.linalg.cholesky((1 - shrink) * spread + shrink * diagonal + FLOOR * np.eye(len(mean)))
    return Gaussian(float(np.log(prior)), mean, np.linalg.inv(factor), 2 * float(np.log(np.diag(factor)).sum()))


def sums(rows: DataFrame, d: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products of ``x`` per label, added up by partial aggregation."""
    cells = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d)]
    cells += [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"q{i}_{j}") for i in range(d) for j in range(i + 1)]
    out = {}
    for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *cells).collect():
        square = np.zeros((d, d))
        for i in range(d):
            for j in range(i + 1):
                square[i, j] = square[j, i] = r[f"q{i}_{j}"]
        out[r["label"]] = (float(r["n"]), np.array([r[f"s{i}"] for i in range(d)]), square)
    return out


def train(described_docs: DataFrame, labels: DataFrame, shrink: float = SHRINK) -> list[Gaussian] | None:
    """The two classes, from all labelled rows that are not held out; None if a class has no row.

    An id that is labelled more than once counts as often; a null label or id is no label.
    """
    known = labels.filter("quality in (0, 1) and doc_id is not null").filter(~held_out(F.col("doc_id")))
    rows = described_docs.join(known.select("doc_id", F.col("quality").alias("label")), "doc_id")
    found = sums(rows, len(STATISTICS))
    if set(found) != {0, 1}:
        return None
    n = sum(v[0] for v in found.values())
    return [gaussian(*found[c], found[c][0] / n, shrink) for c in (0, 1)]


def score(docs: DataFrame, labels: DataFrame, shrink: float = SHRINK) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each document.

    Scores use the text alone. Empty and null texts are scored like any other; rows that repeat
    come back one by one; a null id is never held out. Without labels of both classes every
    score is 0.5. Columns of other names are not read.
    """
    known = written(described(docs), "statistics")
    classes = train(known, labels, shrink)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = np.full(batch.num_rows, 0.5)
        if classes:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            bad, good = (c.log_density(x) for c in classes)
            p = 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], schema=schema)

    rows = known.mapInArrow(lambda batches: rows_of(batches, make), "doc_id long, score double")
    return rows.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
