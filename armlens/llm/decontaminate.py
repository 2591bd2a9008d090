"""Benchmark decontamination: one Aho-Corasick automaton over the words of all test items.

Words are coded as single characters, so that the automaton has one node per word of a
window, a text is scanned once and a match's place is a word number. Offsets in the original
text are taken from the words' places there.
"""

import re
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armlens.llm.frames import WORDS, binary, rows_of, written

WINDOW = 10
#: Windows of one automaton. A larger benchmark is cut into several, each sent to the tasks by
#: itself, so what is broadcast at once has a fixed bound.
WINDOWS_PER_AUTOMATON = 50_000
#: Automata that a worker keeps.
KEPT = 2
OTHER = "\x00"
PLACES = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

FOUND = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
    ]
)
FOUND_DDL = (
    "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,stop:int>>"
)


def normal_words(data: bytes) -> list[bytes]:
    return data.translate(WORDS).split()


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``window`` (binary, words joined by a space) and ``items``, the sorted ids that have it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), ([], [])
            for item, data in zip(ids, binary(batch.column(1))):
                words = normal_words(data)
                for at in range(max(1, len(words) - window + 1) if words else 0):
                    out[0].append(b" ".join(words[at : at + window]))
                    out[1].append(item)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.binary()), pa.array(out[1], pa.string())], ["window", "item"]
            )

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    rows = items.mapInArrow(cut, "window binary, item string")
    return rows.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


class Matcher:
    """The automaton of some windows; ``scan`` gives (first word, last word, items) in a text."""

    def __init__(self, windows: list[tuple[bytes, list[str]]]):
        self.codes: dict[bytes, str] = {}
        self.automaton = ahocorasick.Automaton()
        for window, items in windows:
            words = window.split()
            key = "".join([self._code(w) for w in words])
            self.automaton.add_word(key, (len(words), items))
        self.automaton.make_automaton()

    def _code(self, word: bytes) -> str:
        number = 0x100 + len(self.codes)
        return self.codes.setdefault(word, chr(number if number < 0xD800 else number + 0x800))

    def scan(self, words: list[bytes]) -> list[tuple[int, int, list[str]]]:
        get = self.codes.get
        coded = "".join([get(w, OTHER) for w in words])
        return [(end + 1 - size, end, items) for end, (size, items) in self.automaton.iter(coded)]


_matchers: OrderedDict[str, Matcher] = OrderedDict()


def _matcher(key: str, part) -> Matcher:
    """The automaton of a broadcast part, compiled once per worker."""
    if key not in _matchers:
        while len(_matchers) >= KEPT:
            _matchers.popitem(last=False)
        _matchers[key] = Matcher(part.value)
    _matchers.move_to_end(key)
    return _matchers[key]


def _spans(data: bytes, marks: bytearray) -> list[dict[str, int]]:
    """Runs of marked words as code points of the original text."""
    out, last, chars, upto = [], -2, 0, 0
    for k, m in enumerate(PLACES.finditer(data)):
        if not marks[k]:
            continue
        chars += len(data[upto : m.start()].decode("utf-8", "replace"))
        start, upto = chars, m.end()
        chars += len(data[m.start() : upto].decode("utf-8", "replace"))
        if k == last + 1:
            out[-1]["stop"] = chars
        else:
            out.append({"start": start, "stop": chars})
        last = k
    return out


def automata(benchmark: DataFrame, window: int = WINDOW, per_automaton: int = WINDOWS_PER_AUTOMATON) -> list:
    """The windows as broadcast parts of bounded size, each for one automaton; usually there is one."""
    spark = benchmark.sparkSession
    windows = written(benchmark_windows(benchmark, window), "windows")
    shards = -(-windows.count() // per_automaton)
    parts = []
    for k in range(shards):
        mine = windows.filter(F.pmod(F.xxhash64("window"), F.lit(shards)) == k)
        rows = sorted((bytes(r["window"]), r["items"]) for r in mine.toLocalIterator())
        parts.append((uuid.uuid4().hex, spark.sparkContext.broadcast(rows)))
    return parts


def find_items(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, per_automaton: int = WINDOWS_PER_AUTOMATON) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, items, spans``.

    ``n_hit`` counts the words inside any occurrence of a window of ``window`` consecutive words of
    an item (all its words, if it has fewer); ``items`` are the ids with such windows, sorted as
    strings; ``spans`` are the runs of hit words in the original text, in code points. A null or
    empty text has no words, an item without words no window; an item without an id marks words but
    is no item; repeated rows are each answered. Without items or documents nothing is hit.
    """
    parts = automata(benchmark, window, per_automaton)

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = binary(batch.column(1))
        found: list[list] = [[] for _ in texts]
        counts = []
        split = [normal_words(t) for t in texts]
        for part in parts:
            matcher = _matcher(*part)
            for hits, words in zip(found, split):
                hits += matcher.scan(words)
        out: dict[str, list] = {name: [] for name in FOUND.names[2:]}
        for data, words, hits in zip(texts, split, found):
            counts.append(len(words))
            marks = bytearray(len(words)) if hits else bytearray()
            for start, end, _ in hits:
                marks[start : end + 1] = b"\x01" * (end + 1 - start)
            out["n_hit"].append(marks.count(1))
            out["items"].append(sorted({i for _, _, items in hits for i in items}))
            out["spans"].append(_spans(data, marks) if hits else [])
        arrays = [batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64())]
        arrays += [pa.array(out[f.name], f.type) for f in list(FOUND)[2:]]
        return pa.RecordBatch.from_arrays(arrays, schema=FOUND)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lambda batches: rows_of(batches, scan), FOUND_DDL
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no window of an item occurs in, with all their columns."""
    parts, at = automata(benchmark), docs.columns.index("text")

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        split = [normal_words(t) for t in binary(batch.column(at))]
        good = [not any(_matcher(*part).scan(words) for part in parts) for words in split]
        return batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(lambda batches: rows_of(batches, clean), docs.schema)


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = f"""
WITH dw AS (
  SELECT row_number() OVER () AS row_no, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT item_id::VARCHAR AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
wins AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS n,
         array_to_string(w[i:i + {WINDOW - 1}], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
cut AS (
  SELECT row_no, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT row_no, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hits AS (SELECT row_no, i, n, item FROM cut JOIN wins USING (n, win)),
marked AS (
  SELECT row_no, count(DISTINCT word)::BIGINT AS n_hit
  FROM (SELECT DISTINCT row_no, unnest(range(i, i + n)) AS word FROM hits) GROUP BY row_no),
found AS (SELECT row_no, list_sort(list(DISTINCT item)) AS items FROM hits WHERE item IS NOT NULL GROUP BY row_no)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN marked USING (row_no) LEFT JOIN found USING (row_no)"""
