"""Substring dedup: passages of 50 words that an earlier document has are removed.

Every window of 50 words has an anchor, the smallest hash among its runs of ten words, so
equal windows share their anchor and one run in about twenty is an anchor. Anchors that occur in several
documents are found by a count. Pieces of text around them, the windows that have the
anchor, are brought together by anchor. There the windows that recur are confirmed word by word and compiled into
Aho-Corasick automata, one per shard of bounded size, and all pieces stream through the automaton
of their shard to locate every occurrence.

An anchor of many documents is split by a hash of the document: each part finds what recurs in it,
and the first documents of its windows are compared over the parts.
"""

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from armlens.llm.frames import BLANKS, binary, gram_hashes, rows_of, word_hashes, written

WINDOW = 50
RUN = 10
#: Documents of an anchor from which on it is split, and words of the pieces in one automaton.
DOCS_PER_PART = 500
WORDS_PER_SHARD = 40_000


def split(data: bytes) -> list[bytes]:
    return data.translate(BLANKS).split()


def anchors(data: bytes, window: int = WINDOW, run: int = RUN) -> np.ndarray:
    """The anchor of each window, in text order; none for a text of fewer words than a window."""
    words = word_hashes(data.translate(BLANKS))
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    run = min(run, window)
    low, width, want = gram_hashes(words, run), 1, window - run + 1
    while width * 2 <= want:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    return np.minimum(low[:n], low[want - width : want - width + n])


def described(docs: DataFrame, window: int) -> DataFrame:
    """``doc_id, raw, n_words, words`` (sha256 of the words joined by a space) and ``anchors``, each once."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("raw", pa.int64()), ("n_words", pa.int64()), ("words", pa.string()), ("anchors", pa.list_(pa.int64()))]
    )

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, sha, found = [], [], []
        for data in binary(batch.column(2)):
            words = split(data)
            n.append(len(words))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            found.append(np.unique(anchors(data, window)).view(np.int64))
        made = [pa.array(n, pa.int64()), pa.array(sha), pa.array(found, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], schema=schema)

    ddl = "doc_id long, raw long, n_words long, words string, anchors array<long>"
    return _texts(docs).mapInArrow(lambda b: rows_of(b, make), ddl)


def _texts(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("raw"), "text")


def pieces(texts: DataFrame, window: int) -> DataFrame:
    """Pieces around recurring anchors: ``anchor, part, parts, doc_id, raw, at`` (first word), ``words``."""

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, raws = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out: dict[str, list] = {x: [] for x in ("anchor", "part", "parts", "doc_id", "raw", "at", "words")}
        size = 0
        for doc, raw, data, recurring in zip(ids, raws, binary(batch.column(2)), batch.column(3).to_pylist()):
            parts = {r["anchor"]: r["parts"] for r in recurring}
            of = anchors(data, window).view(np.int64)
            words = split(data)
            cuts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True])))
            for start, stop, anchor in zip(cuts[:-1].tolist(), cuts[1:].tolist(), of[cuts[:-1]].tolist()):
                if anchor not in parts:
                    continue
                n = parts[anchor]
                piece = b" ".join(words[start : stop + window - 1])
                for name, value in zip(out, (anchor, (raw & 0x7FFFFFFF) % n, n, doc, raw, start, piece)):
                    out[name].append(value)
                size += len(piece)
            if size > 1 << 22:
                yield pa.RecordBatch.from_pydict(out, schema=schema)
                out, size = {x: [] for x in out}, 0
        yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema(
        [("anchor", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("doc_id", pa.int64()), ("raw", pa.int64()), ("at", pa.int32()), ("words", pa.binary())]
    )
    ddl = "anchor long, part int, parts int, doc_id long, raw long, at int, words binary"
    return texts.select("doc_id", "raw", "text", "recurring").mapInArrow(
        lambda batches: (out for b in batches if b.num_rows for out in make(b)), ddl
    )


class Shard:
    """Pieces of some anchors: which windows recur, and where."""

    def __init__(self, window: int):
        self.window = window
        self.codes: dict[bytes, str] = {}
        self.pieces: list[tuple[tuple[int, int, int], str]] = []
        self.size = 0

    def add(self, place: tuple[int, int, int], data: bytes) -> None:
        words = data.split()
        self.pieces.append((place, "".join([self._code(w) for w in words])))
        self.size += len(words)

    def _code(self, word: bytes) -> str:
        number = 0x100 + len(self.codes)
        return self.codes.setdefault(word, chr(number if number < 0xD800 else number + 0x800))

    def first(self) -> tuple[dict[str, int], set[str]]:
        """The first document of each window, and the windows of several documents."""
        w, first, several = self.window, {}, set()
        for (doc, _, _), text in self.pieces:  # in order of documents
            for k in range(len(text) - w + 1):
                phrase = text[k : k + w]
                if first.setdefault(phrase, doc) != doc:
                    several.add(phrase)
        return first, several

    def occurrences(self) -> Iterator[tuple[int, int, int, int]]:
        """``doc_id, raw, start, stop`` of words covered by windows that an earlier document has."""
        first, several = self.first()
        if several:
            automaton = ahocorasick.Automaton()
            for phrase in several:
                automaton.add_word(phrase, first[phrase])
            automaton.make_automaton()
            for (doc, raw, at), text in self.pieces:
                begin = end = -1
                for last, earliest in automaton.iter(text):
                    if earliest >= doc:
                        continue
                    if begin >= 0 and last + 1 - self.window <= end:
                        end = last + 1
                        continue
                    if begin >= 0:
                        yield doc, raw, at + begin, at + end
                    begin, end = last + 1 - self.window, last + 1
                if begin >= 0:
                    yield doc, raw, at + begin, at + end

    def phrases(self) -> Iterator[tuple[bytes, int, int, int]]:
        """Digest of each window with all its places in its first document, for anchors that were split."""
        words, first, w = {c: x for x, c in self.codes.items()}, self.first()[0], self.window
        digests = {
            phrase: hashlib.blake2b(b" ".join([words[c] for c in phrase]), digest_size=16).digest() for phrase in first
        }
        for (doc, raw, at), text in self.pieces:
            for k in range(len(text) - w + 1):
                phrase = text[k : k + w]
                if first[phrase] == doc:
                    yield digests[phrase], doc, raw, at + k


FOUND = pa.schema([("phrase", pa.binary()), ("doc_id", pa.int64()), ("raw", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


def locate(found: DataFrame, window: int, words_per_shard: int = WORDS_PER_SHARD) -> DataFrame:
    """Covered words per piece (``phrase`` null), and the windows of split anchors in the first document of the part."""

    def answer(shard: Shard, alone: bool) -> pa.RecordBatch:
        rows = [(None, *x) for x in shard.occurrences()]
        if not alone:
            rows += [(p, doc, raw, at, at + window) for p, doc, raw, at in shard.phrases()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, FOUND)], schema=FOUND
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, group, alone = Shard(window), None, True
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(7)]
            for anchor, part, parts, doc, raw, at, words in zip(*columns):
                if group != (anchor, part) and group is not None:
                    # A split anchor has a shard of its own; others share one up to its size.
                    if shard.size >= words_per_shard or not alone or parts > 1:
                        yield answer(shard, alone)
                        shard = Shard(window)
                group, alone = (anchor, part), parts == 1
                shard.add((doc, raw, at), words)
        if shard.pieces:
            yield answer(shard, alone)

    order = ("anchor", "part", "doc_id", "raw", "at")
    dealt = found.repartition("anchor", "part").sortWithinPartitions(*order)
    dealt = dealt.select("anchor", "part", "parts", "doc_id", "raw", "at", "words")
    return dealt.mapInArrow(run, "phrase binary, doc_id long, raw long, start long, stop long")


def _kept(texts: DataFrame) -> DataFrame:
    """``f_id, f_raw, n_removed, kept_sha256, removed`` from texts with their covered runs of words."""
    ddl = "f_id long, f_raw long, n_removed long, kept_sha256 string, removed array<struct<start:int,stop:int>>"
    run = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, sha, merged = [], [], []
        for data, covered in zip(binary(batch.column(2)), batch.column(3).to_pylist()):
            words, out = split(data), []
            for r in sorted(covered, key=lambda r: r["start"]):
                if out and r["start"] <= out[-1]["stop"]:
                    out[-1]["stop"] = max(out[-1]["stop"], r["stop"])
                else:
                    out.append(dict(r))
            kept, at = [], 0
            for r in out:
                kept += words[at : r["start"]]
                at = r["stop"]
            kept += words[at:]
            n.append(len(words) - len(kept))
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            merged.append(out)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sha), pa.array(merged, run)],
            ["f_id", "f_raw", "n_removed", "kept_sha256", "removed"],
        )

    return texts.mapInArrow(lambda b: rows_of(b, make), ddl)


def dedup(docs: DataFrame, window: int = WINDOW, docs_per_part: int = DOCS_PER_PART, words_per_shard: int = WORDS_PER_SHARD) -> DataFrame:
    """One row per document row: ``doc_id, n_words, n_removed, kept_sha256, removed`` (runs of word numbers).

    A word is removed if a window of ``window`` words over it also starts in a document of a smaller id. Texts
    of the same words are looked at once: all but those of the smallest id lose every word, if
    they have a window at all. A null text has no words; a row without an id is later than none
    and earlier than none, so it loses nothing and takes nothing; rows that share an id take nothing from each other.
    """
    known = written(described(docs, window), "repeat-known")
    named = known.filter("doc_id is not null")
    firsts = named.groupBy("words").agg(F.min(F.struct("doc_id", "raw")).alias("f"))
    firsts = written(firsts.select("words", F.col("f.doc_id").alias("f_id"), F.col("f.raw").alias("f_raw")), "repeat-firsts")

    alone = firsts.select(F.col("f_id").alias("doc_id"), F.col("f_raw").alias("raw"))
    each = named.select("doc_id", "raw", F.explode("anchors").alias("anchor")).join(alone, ["doc_id", "raw"])
    each = written(each.distinct(), "repeat-anchors")
    several = each.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n"))
    parts = (1 + F.floor(F.col("n") / docs_per_part)).cast("int").alias("parts")
    several = written(several.filter("low < high").select("anchor", parts), "repeat-recurring")
    recurring = each.join(several, "anchor").groupBy("doc_id", "raw")
    recurring = recurring.agg(F.collect_list(F.struct("anchor", "parts")).alias("recurring"))
    texts = written(_texts(docs).dropDuplicates(["doc_id", "raw"]).join(recurring, ["doc_id", "raw"]), "repeat-texts")

    found = written(locate(pieces(texts, window), window, words_per_shard), "repeat-found")
    least = F.min("doc_id").over(Window.partitionBy("phrase"))  # the first document of each part
    across = found.filter("phrase is not null").withColumn("least", least).filter("doc_id > least")
    covered = found.filter("phrase is null").unionByName(across.drop("least"))
    covered = covered.groupBy("doc_id", "raw").agg(
        F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"))).alias("covered")
    )
    changed = written(_kept(texts.join(covered, ["doc_id", "raw"]).select("doc_id", "raw", "text", "covered")), "repeat-kept")

    rows = known.drop("anchors", "raw").join(firsts, "words", "left").join(changed, ["f_id", "f_raw"], "left")
    copy = (F.col("doc_id") > F.col("f_id")) & (F.col("n_words") >= window)
    mine = F.col("doc_id").eqNullSafe(F.col("f_id"))
    all_words = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("stop")))
    none = F.array().cast("array<struct<start:int,stop:int>>")
    return rows.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).when(mine, F.coalesce("n_removed", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).when(mine, F.coalesce("kept_sha256", "words")).otherwise(F.col("words")).alias("kept_sha256"),
        F.when(copy, all_words).when(mine, F.coalesce("removed", none)).otherwise(none).alias("removed"),
    )


ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') AS w FROM documents),
wins AS (
  SELECT row_no, doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h
  FROM (SELECT row_no, doc_id, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS i FROM d WHERE len(w) >= {WINDOW})),
hit AS (
  SELECT row_no, i FROM (SELECT row_no, doc_id, i, min(doc_id) OVER (PARTITION BY h) AS f FROM wins) WHERE f < doc_id),
gone AS (SELECT DISTINCT row_no, unnest(range(i, i + {WINDOW})) AS k FROM hit),
words AS (
  SELECT row_no, k, word FROM (SELECT row_no, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM d)),
kept AS (
  SELECT row_no, string_agg(word, ' ' ORDER BY k) AS t, count(*) AS n FROM words ANTI JOIN gone USING (row_no, k) GROUP BY row_no)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (row_no)"""
