"""Cross-tokenizer alignment by lockstep merging.

Two tokenizers cut the same bytes in two ways. A batch of documents is merged at once: one state
vector holds every document's place in both token lists, a step emits the link of the two tokens at
each place, moves on the side whose token ends first (both, where they end together, which is a cut),
and documents that are through are taken out of the vector.

How often a pair of ids is linked in the whole corpus takes a second look at each document's links.
Documents are kept in blocks with the pairs they hold, a block's distinct pairs fetch their counts, and
only those meet the block again, so no row per link and no table of all pairs is ever sent around.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armlens.llm.frames import written
from armlens.llm.tokens import encoder, vocabulary_path

VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
#: Bytes of text in one block; a longer document is a block of its own.
BLOCK_BYTES = 2 << 20

DOC = pa.struct(
    [("doc_id", pa.int64())]
    + [(name, pa.int64()) for name in ("n_a", "n_b", "n_groups", "n_links")]
    + [("groups_sha256", pa.string())]
)
DOC_DDL = "struct<doc_id:long,n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string>"
BLOCKS = pa.schema(
    [
        ("block", pa.int64()),
        ("docs", pa.list_(DOC)),
        ("pairs", pa.list_(pa.int64())),
        ("linked", pa.list_(pa.int64())),
        ("entry_doc", pa.binary()),
        ("entry_pair", pa.binary()),
        ("entry_count", pa.binary()),
    ]
)
BLOCKS_DDL = f"block long, docs array<{DOC_DDL}>, pairs array<long>, linked array<long>, entry_doc binary, entry_pair binary, entry_count binary"
RESULT = pa.schema(
    [("doc_id", pa.int64())]
    + [(name, pa.int64()) for name in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    + [("groups_sha256", pa.string())]
)
RESULT_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
ALIGNED_DDL = "doc_id long, a_ids array<int>, b_ids array<int>, a_ends array<long>, b_ends array<long>, links array<struct<a:int,b:int>>, cuts array<long>"


def byte_of_character() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes
    in order for the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers with the bytes of each of their ids."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor

        self.a = encoder(path_a)
        self.b = SentencePieceProcessor(model_file=path_b)
        byte = byte_of_character()
        vocab = self.a.tokenizer.get_vocab()
        self.size_a, self.size_b = max(vocab.values()) + 1, self.b.get_piece_size()
        a_bytes = [b""] * self.size_a
        for token, i in vocab.items():
            a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        b_bytes = [self._piece(i) for i in range(self.size_b)]
        self.bytes = [pa.array(x, pa.large_binary()) for x in (a_bytes, b_bytes)]
        self.lengths = [np.array([len(x) for x in xs], np.int64) for xs in (a_bytes, b_bytes)]
        signs = [f"{i}{end}".encode() for end in ",|" for i in range(self.size_a)]
        signs += [f"{i}{end}".encode() for end in (",", ";", "") for i in range(self.size_b)]
        self.signs = pa.array(signs, pa.large_binary())

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[np.ndarray]]:
        """Ids by both; no tokens where a text is empty or its tokens do not spell a space and the text."""
        a = [np.frombuffer(x, self.a.width).astype(np.int64) for x in self.a.encode([" " + t if t else "" for t in texts])]
        b = [np.array(x, np.int64) for x in self.b.encode(texts, num_threads=1)]
        sides = [a, b]
        spelled = [_runs(table, ids) for table, ids in zip(self.bytes, sides)]
        for k, text in enumerate(texts):
            runs = [next(x) for x in spelled]
            if not text or set(runs) != {b" " + text.encode()}:
                a[k] = b[k] = np.zeros(0, np.int64)
        return sides


def _runs(table: pa.Array, lists: list[np.ndarray]) -> Iterator[bytes]:
    """For each list of numbers, the bytes of the table's entries put together."""
    taken = table.take(pa.array(np.concatenate([*lists, np.zeros(0, np.int64)])))
    offsets, data = np.frombuffer(taken.buffers()[1], np.int64), memoryview(taken.buffers()[2] or b"")
    at = 0
    for ids in lists:
        yield bytes(data[offsets[at] : offsets[at + len(ids)]])
        at += len(ids)


_pairs: dict[tuple[str, str], Pair] = {}


def pair(path_a: str, path_b: str) -> Pair:
    """One pair of tokenizers per worker and files."""
    key = (path_a, path_b)
    if key not in _pairs:
        _pairs[key] = Pair(*key)
    return _pairs[key]


@dataclass
class Merged:
    """A batch's tokens one after the other, with its links and cuts as numbers of tokens in it."""

    ids: list[np.ndarray]
    ends: list[np.ndarray]
    bounds: list[np.ndarray]
    link_doc: np.ndarray
    links: list[np.ndarray]
    cuts: list[np.ndarray]


def lockstep(ids: list[list[np.ndarray]], lengths: list[np.ndarray]) -> Merged:
    """Links and cuts of all documents of a batch, step by step."""
    flat = [np.concatenate([*side, np.zeros(0, np.int64)]) for side in ids]
    bounds = [np.cumsum([0, *map(len, side)]) for side in ids]
    ends = []
    for side, starts, size in zip(flat, bounds, lengths):
        total = np.concatenate(([0], np.cumsum(size[side])))
        ends.append(total[1:] - np.repeat(total[starts[:-1]], np.diff(starts)))
    doc = np.flatnonzero(np.diff(bounds[0])).astype(np.int32)
    state = np.stack([bounds[0][doc], bounds[1][doc]]).astype(np.int32)
    stop = bounds[0][doc + 1].astype(np.int32)
    docs, links, cuts = [], [], []
    while len(doc):
        docs.append(doc)
        links.append(state)
        a, b = ends[0][state[0]], ends[1][state[1]]
        moves = np.stack([a <= b, b <= a])
        both = moves[0] & moves[1]
        if both.any():
            cuts.append(state[:, both])
        state = state + moves
        going = state[0] < stop
        if not going.all():
            doc, state, stop = doc[going], state[:, going], stop[going]
    nothing = np.zeros((2, 0), np.int32)
    cut = np.concatenate([*cuts, nothing], axis=1)
    cut = cut[:, np.argsort(cut[0])]
    return Merged(flat, ends, bounds, np.concatenate([*docs, nothing[0]]), list(np.concatenate([*links, nothing], axis=1)), list(cut))


def group_digests(merged: Merged, both: Pair) -> list[str]:
    """SHA-256 of each document's groups as text; '' without tokens."""
    (a, b), (cut_a, cut_b) = merged.ids, merged.cuts
    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last_a[cut_a] = last_b[cut_b] = 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    signs = np.empty(len(a) + len(b), np.int64)
    before_b = np.concatenate(([0], cut_b + 1))
    signs[np.arange(len(a)) + before_b[group_a]] = a + both.size_a * last_a
    final = merged.bounds[1][1:][np.diff(merged.bounds[1]) > 0] - 1
    last_b[final] = 2
    signs[np.arange(len(b)) + cut_a[group_b] + 1] = 2 * both.size_a + b + both.size_b * last_b
    sizes = np.diff(merged.bounds[0]) + np.diff(merged.bounds[1])
    parts = np.split(signs, np.cumsum(sizes)[:-1])
    return [hashlib.sha256(run).hexdigest() if run else "" for run in _runs(both.signs, parts)]


def _block(number: int, ids: list, texts: list[str], both: Pair) -> pa.RecordBatch:
    merged = lockstep(both.encode(texts), both.lengths)
    n = len(texts)
    pair_ids = merged.ids[0][merged.links[0]] * both.size_b + merged.ids[1][merged.links[1]]
    keys, counts = np.unique(merged.link_doc.astype(np.int64) * (both.size_a * both.size_b) + pair_ids, return_counts=True)
    entry_doc, entry_pair = np.divmod(keys, both.size_a * both.size_b)
    pairs, place = np.unique(entry_pair, return_inverse=True)
    cut_doc = np.searchsorted(merged.bounds[0], merged.cuts[0], side="right") - 1
    columns = [
        pa.array(ids, pa.int64()),
        *(pa.array(np.diff(x)) for x in merged.bounds),
        *(pa.array(np.bincount(x, minlength=n)) for x in (cut_doc, merged.link_doc)),
        pa.array(group_digests(merged, both), pa.string()),
    ]
    docs = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(columns, DOC)], fields=list(DOC))
    linked = np.bincount(place, counts, minlength=len(pairs)).astype(np.int64)
    lists = [pa.array([x], t) for x, t in zip((docs.to_pylist(), pairs, linked), [f.type for f in BLOCKS][1:4])]
    entries = [pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (entry_doc, place, counts)]
    return pa.RecordBatch.from_arrays([pa.array([number]), *lists, *entries], schema=BLOCKS)


def _in_blocks(texts: list[str]) -> Iterator[list[int]]:
    """Places of texts of similar length, together at most about ``BLOCK_BYTES``."""
    some, size = [], 0
    for k in sorted(range(len(texts)), key=lambda k: len(texts[k])):
        if some and size + len(texts[k]) > BLOCK_BYTES:
            yield some
            some, size = [], 0
        some.append(k)
        size += len(texts[k])
    if some:
        yield some


def blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Documents in blocks: their figures, the pairs of ids linked in the block, and how often in each document."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        both = pair(path_a, path_b)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for some in _in_blocks(texts):
                yield _block(number, [ids[k] for k in some], [texts[k] for k in some], both)
                number += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(build, BLOCKS_DDL)


def pair_counts(kept: DataFrame, size_b: int) -> DataFrame:
    """``pair, count, best``: how many links hold a pair, and whether no pair of its B id has more."""
    each = kept.select(F.explode(F.arrays_zip("pairs", "linked")).alias("x")).select("x.pairs", "x.linked")
    counts = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("linked").alias("count"))
    counts = written(counts.withColumn("b", F.col("pair") % size_b), "pairs")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _sum_up(block: pa.Table, counts: pa.Table) -> pa.Table:
    """Each document's sums over its links, from the counts of its block's pairs."""
    if not block.num_rows:
        return RESULT.empty_table()
    row = block.to_pylist()[0]
    order = np.argsort(counts.column("pair").to_numpy())
    count = counts.column("count").to_numpy()[order]
    best = counts.column("best").combine_chunks().to_numpy(zero_copy_only=False)[order]
    doc, place, times = (np.frombuffer(row[c], np.int32) for c in ("entry_doc", "entry_pair", "entry_count"))
    n = len(row["docs"])
    n_best, count_sum = np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.add.at(n_best, doc, times * best[place].astype(np.int64))
    np.add.at(count_sum, doc, times * count[place])
    figures = {f.name: [d.get(f.name) for d in row["docs"]] for f in RESULT}
    figures |= {"n_best": n_best, "count_sum": count_sum}
    return pa.table([pa.array(figures[f.name], f.type) for f in RESULT], schema=RESULT)


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A links to B where their bytes overlap; groups end where tokens of both end together. ``count_sum``
    adds up, over a document's links, how many links of the corpus hold the same ids, and ``n_best``
    counts the links whose ids are among the most frequent for their B id. Null and empty texts,
    and texts that the tokens of either side do not spell with a space before them, have no tokens:
    zeros and ''. Repeated rows count and are answered each; ids may be null; other columns are not
    read; without documents there are no rows.
    """
    path_a, path_b = path_a or vocabulary_path(VOCABULARY_A), path_b or vocabulary_path(VOCABULARY_B)
    kept = written(blocks(docs, path_a, path_b), "aligned")
    counts = pair_counts(kept, pair(path_a, path_b).size_b)
    wanted = kept.select(F.col("block").alias("wanted_by"), F.explode("pairs").alias("pair")).join(counts, "pair")
    own = kept.select("block", "docs", "entry_doc", "entry_pair", "entry_count")
    return own.groupBy("block").cogroup(wanted.groupBy("wanted_by")).applyInArrow(_sum_up, RESULT_DDL)


def alignments(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """The alignment itself: ids and byte ends of both sides, links as places in them, and cuts as byte
    offsets in a space and the text."""
    path_a, path_b = path_a or vocabulary_path(VOCABULARY_A), path_b or vocabulary_path(VOCABULARY_B)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(path_a, path_b)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for some in _in_blocks(texts):
                merged = lockstep(both.encode([texts[k] for k in some]), both.lengths)
                yield _aligned([ids[k] for k in some], merged)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, ALIGNED_DDL)


def _aligned(ids: list, merged: Merged) -> pa.RecordBatch:
    sides = [pa.ListArray.from_arrays(pa.array(b.astype(np.int32)), pa.array(x.astype(np.int32))) for b, x in zip(merged.bounds, merged.ids)]
    ends = [pa.ListArray.from_arrays(pa.array(b.astype(np.int32)), pa.array(x)) for b, x in zip(merged.bounds, merged.ends)]
    order = np.argsort(merged.link_doc, kind="stable")
    doc = merged.link_doc[order]
    places = [pa.array((x[order] - b[doc]).astype(np.int32)) for x, b in zip(merged.links, merged.bounds)]
    at = pa.array(np.searchsorted(doc, np.arange(len(ids) + 1)).astype(np.int32))
    links = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(places, ["a", "b"]))
    cut_at = pa.array(np.searchsorted(merged.cuts[0], merged.bounds[0]).astype(np.int32))
    cuts = pa.ListArray.from_arrays(cut_at, pa.array(merged.ends[0][merged.cuts[0]]))
    columns = [pa.array(ids, pa.int64()), *sides, *ends, links, cuts]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in ALIGNED_DDL.split(", ")])
