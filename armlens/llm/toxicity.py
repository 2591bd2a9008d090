"""Toxicity: a logistic classifier over words and word starts, regularised by counterfactuals.

Sentences of labelled documents that mention a group are copied with the mention swapped for
another, and the training loss adds the squared change of the score. Words that only name a group
so get no weight of their own, and neutral mentions are not taken for toxic ones.
"""

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armlens.llm.frames import WORDS, binary, held_out, rows_of, written

THRESHOLD = 0.3
#: Documents that the classifier is fitted on, at most; the sample is by a hash of the id.
SAMPLE = 8_000
#: Features with a weight, by how far their document counts differ between the classes.
VOCABULARY = 4_096
LEAST_DOCS = 4
RIDGE = 1.0
FAIRNESS = 1.0
ROUNDS = 300

# Names of groups; each is swapped for the next of its row.
IDENTITY = (
    "women men girls boys",
    "muslims christians jews hindus buddhists atheists",
    "muslim christian jewish hindu buddhist atheist",
    "gay straight lesbian bisexual transgender",
    "black white asian latino african european",
    "immigrants refugees foreigners natives",
    "femmes hommes",
    "musulmans juifs",
    "frauen männer",
    "mujeres hombres",
)
SWAPS = {
    w.encode(): g.split()[(i + 1) % len(g.split())].encode() for g in IDENTITY for i, w in enumerate(g.split())
}
SENTENCE = re.compile(rb"[.!?\n]+")
#: Bytes of the word starts that are features besides the words, so that inflections share weight.
STARTS = (3, 4, 5, 6)
#: Words whose weighted features a worker remembers.
REMEMBERED = 500_000


def features(words: set[bytes]) -> set[bytes]:
    return words | {b"^" + w[:k] for k in STARTS for w in words if len(w) >= k}


@dataclass
class Model:
    weights: dict[bytes, float]
    bias: float

    def __post_init__(self):
        self.known: dict[bytes, tuple[bytes, ...]] = {}

    def of_word(self, word: bytes) -> tuple[bytes, ...]:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        found = self.known[word] = tuple(f for f in features({word}) if f in self.weights)
        return found

    def score(self, data: bytes) -> float:
        present, known = set(), self.known
        for word in set(data.translate(WORDS).split()):
            found = known.get(word)
            if found is None:
                found = self.of_word(word)
            if found:
                present.update(found)
        z = self.bias + sum(sorted(self.weights[f] for f in present))
        return 1 / (1 + float(np.exp(-np.clip(z, -700, 700))))


def swapped(data: bytes) -> tuple[set[bytes], set[bytes]]:
    """Features that vanish and appear when every sentence with a group's name has it swapped."""
    before, after = set(), set()
    for sentence in SENTENCE.split(data):
        words = sentence.translate(WORDS).split()
        before.update(words)
        after.update(SWAPS.get(w, w) for w in words)
    before, after = features(before), features(after)
    return before - after, after - before


def sample(labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """At most ``size`` labelled ids that are not held out; an id with several labels is toxic if one is."""
    known = labels.filter("toxic in (0, 1) and doc_id is not null").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)


def vocabulary(rows: DataFrame, size: int = VOCABULARY) -> list[bytes]:
    """Words and word starts of the labelled rows with the largest difference of document rates, in deviations."""

    def words(batches):
        for batch in batches:
            out = ([], [])
            for label, data in zip(batch.column(0).to_pylist(), binary(batch.column(1))):
                seen = features(set(data.translate(WORDS).split()))
                out[0].extend(seen)
                out[1].extend([label] * len(seen))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int32())], ["word", "label"])

    n = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).first()
    if not n["n"] or not 0 < n["p"] < n["n"]:
        return []
    pos, neg = float(n["p"]), float(n["n"] - n["p"])
    counts = rows.select("label", "text").mapInArrow(words, "word binary, label int").groupBy("word").agg(
        F.count(F.lit(1)).alias("df"), F.sum("label").alias("tox")
    )
    rate = F.col("df") / F.lit(pos + neg)
    gap = F.abs(F.col("tox") / pos - (F.col("df") - F.col("tox")) / neg)
    z = gap / F.sqrt(rate * (1 - rate) * F.lit(1 / pos + 1 / neg) + F.lit(1e-9))
    best = counts.filter(F.col("df") >= LEAST_DOCS).orderBy(z.desc(), "word").limit(size).select("word").collect()
    return sorted({bytes(r["word"]) for r in best} | features(set(SWAPS)))


def vectors(rows: DataFrame, index: dict[bytes, int]) -> list:
    """Label, words present, words lost and words gained by the swap, of each sampled document."""
    schema = pa.schema([("label", pa.int32()), *((c, pa.list_(pa.int32())) for c in ("x", "lost", "gained"))])

    def make(batch):
        out: tuple[list, list, list] = ([], [], [])
        for data in binary(batch.column(1)):
            for column, found in zip(out, (features(set(data.translate(WORDS).split())), *swapped(data))):
                column.append(sorted(index[w] for w in found if w in index))
        arrays = [batch.column(0), *(pa.array(c, pa.list_(pa.int32())) for c in out)]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    ddl = "label int, x array<int>, lost array<int>, gained array<int>"
    return rows.select("label", "text").mapInArrow(lambda b: rows_of(b, make), ddl).orderBy("label", "x").collect()


def _flat(lists) -> tuple[np.ndarray, np.ndarray]:
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return row, np.fromiter((i for x in lists for i in x), np.int64, len(row))


def fit(found: list, size: int, fairness: float = FAIRNESS, ridge: float = RIDGE, rounds: int = ROUNDS):
    """Weights and bias that minimise log loss + ridge / 2 |w|^2 + fairness / 2 sum (change of z by the swap)^2.

    Adaptive gradient steps over the whole bounded sample.
    """
    y = np.array([r["label"] for r in found], float)
    row, col = _flat([r["x"] for r in found])
    moved = [(r["lost"], r["gained"]) for r in found if r["lost"] or r["gained"]]
    lost, gained = _flat([m[0] for m in moved]), _flat([m[1] for m in moved])
    w, b = np.zeros(size), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-(b + np.bincount(row, w[col], len(y)))))
        g = np.bincount(col, (p - y)[row], size) + ridge * w
        if moved:
            change = np.bincount(gained[0], w[gained[1]], len(moved)) - np.bincount(lost[0], w[lost[1]], len(moved))
            g += fairness * (np.bincount(gained[1], change[gained[0]], size) - np.bincount(lost[1], change[lost[0]], size))
        g = np.append(g, (p - y).sum())
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        rate = 0.2 * (1 - (t - 1) / rounds)
        step = rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, fairness: float = FAIRNESS) -> Model | None:
    """The model; None if the labelled rows have one class only."""
    ids = F.broadcast(sample(labels))  # at most SAMPLE rows
    rows = written(docs.select("doc_id", "text").join(ids, "doc_id").select("label", "text"), "toxic-sample")
    words = vocabulary(rows)
    if not words:
        return None
    found = vectors(rows, {w: i for i, w in enumerate(words)})
    w, b = fit(found, len(words), fairness)
    return Model(dict(zip(words, w.tolist())), b)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each document.

    Scores use the whole text alone. Empty and null texts have no words and get the score of the
    bias; rows that repeat come back one by one; a null id is never held out. Without labels of
    both classes every score is 0. Columns of other names are not read.
    """
    model = train(docs, labels)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = [model.score(t) if model else 0.0 for t in binary(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.mapInArrow(lambda batches: rows_of(batches, make), "doc_id long, score double")
    return rows.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    model, at = train(docs, labels), docs.columns.index("text")

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = [not model or model.score(t) < THRESHOLD for t in binary(batch.column(at))]
        return batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(lambda batches: rows_of(batches, clean), docs.schema)
