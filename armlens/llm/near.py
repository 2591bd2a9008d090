"""Near-duplicates by Order MinHash, verified by banded alignment.

A document is the sequence of its runs of five normalised words, each labelled with its
occurrence number. A component of the sketch takes the few labelled runs with the smallest
hashes and keeps them in text order, so two texts agree in it if they share those runs in that
order. Texts that agree in a component are candidates; a candidate pair is a link if the runs that
align in order are at least 0.8 of all runs of both. Classes are connected components of links.

Copies of one word sequence are one node. Inside a bucket of equal components nodes are first
compared with one centre, the member whose buckets are the fullest, since copies of one original
resemble it more than each other. What is already one class needs no further pair. Documents
that still share a bucket with another class are then joined exactly: two texts that reach the share have
one of their rarest runs in common, so documents meet by those, in blocks of bounded size, and only
pairs whose bitmaps allow the share leave a block. A large group of texts that resemble one
original but not each other so gives hardly any pairs.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from armlens.llm.frames import WORDS, binary, gram_hashes, mix, rows_of, word_hashes, written

WORDS_PER_RUN = 5
#: A pair with a similarity of 0.8 shares a component with probability of about 0.8**RUNS, and so
#: at least one of them with 0.9998.
COMPONENTS = 16
RUNS = 4
#: Similarity from which on two texts are linked: SHARE[0] / SHARE[1].
SHARE = (4, 5)
AT_ONCE = 1 << 14
#: Documents that meet in one block.
BLOCK = 256
#: Places of a bitmap per run, and the smallest and largest bitmap as powers of 2.
PLACES_PER_RUN = 4
BITMAP = (6, 14)
#: Texts of so many runs or fewer share a component less surely (0.97 for 4 of 5 runs in common), so all of
#: them go on to the exact join.
SHORT = 24

_seeds = mix(np.arange(1, 2 * COMPONENTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
XORS, FACTORS = _seeds[:COMPONENTS], _seeds[COMPONENTS:] | np.uint64(1)
PLACES = mix(np.arange(1, RUNS + 1, dtype=np.uint64)) | np.uint64(1)


def runs(data: bytes) -> np.ndarray:
    """Hashes of the runs of words, in text order; one of all words where there are fewer than five."""
    return gram_hashes(word_hashes(data.translate(WORDS)), WORDS_PER_RUN)


def labelled(hashes: np.ndarray) -> np.ndarray:
    """The hashes mixed with their occurrence numbers, so that all differ."""
    if not len(hashes):
        return hashes
    order = np.argsort(hashes, kind="stable")
    same = np.concatenate(([False], hashes[order][1:] == hashes[order][:-1]))
    if not same.any():
        return mix(hashes)
    at = np.arange(len(hashes))
    number = np.empty(len(hashes), np.uint64)
    number[order] = at - np.maximum.accumulate(np.where(same, 0, at))
    return mix(hashes + mix(number + np.uint64(1)))


def sketch(labels: np.ndarray) -> np.ndarray:
    """One key per component: its smallest runs in text order."""
    take = min(RUNS, len(labels))
    rows = max(1, AT_ONCE * COMPONENTS // len(labels))
    keys = np.empty(COMPONENTS, np.uint64)
    for at in range(0, COMPONENTS, rows):
        here = slice(at, at + rows)
        drawn = (labels[None, :] ^ XORS[here, None]) * FACTORS[here, None]
        best = np.sort(np.argpartition(drawn, take - 1, axis=1)[:, :take], axis=1)
        keys[here] = mix((labels[best] * PLACES[:take]).sum(axis=1, dtype=np.uint64) ^ XORS[here])
    return keys


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, raw`` (hash of the text), ``n`` (runs), ``words`` (digest of the normalised words) and ``keys`` of each row with an id."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("raw", pa.int64()), ("n", pa.int64()), ("words", pa.binary()), ("keys", pa.list_(pa.int64()))]
    )

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, words, keys = [], [], []
        for data in binary(batch.column(2)):
            data = data.translate(WORDS)
            found = runs(data)
            n.append(len(found))
            words.append(hashlib.blake2b(b" ".join(data.split()), digest_size=16).digest())
            keys.append(sketch(labelled(found)).view(np.int64) if len(found) else [])
        made = [pa.array(n, pa.int64()), pa.array(words, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("raw"), "text")
    rows = rows.filter("doc_id is not null")
    return rows.mapInArrow(lambda b: rows_of(b, make), "doc_id long, raw long, n long, words binary, keys array<long>")


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """The most runs that align in order, none moved by more than ``band`` places.

    A row of the table of alignments is one number whose bits are the places of ``b``; matches
    outside the band around the diagonal are masked out.
    """
    places: dict[int, int] = {}
    for j, x in enumerate(b.tolist()):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    window, row = (1 << (2 * band + 1)) - 1, full
    for i, x in enumerate(a.tolist()):
        match = places.get(x, 0)
        if match:
            match &= window << (i - band) if i >= band else window >> (band - i)
            hit = row & match
            row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def needed(n: int, m: int) -> int:
    """Runs that two texts of ``n`` and ``m`` runs must share to reach ``SHARE``."""
    p, q = SHARE
    return -(-p * (n + m) // (p + q))


def similar(a: np.ndarray, b: np.ndarray, one: np.ndarray, two: np.ndarray) -> bool:
    """Whether runs that align in order are at least ``SHARE`` of all runs of both texts.

    ``one`` and ``two`` are the labelled runs. Any alignment that reaches the share moves no run by
    more than the places left over, so the band loses nothing. The labelled runs in common and the
    common ends decide most pairs.
    """
    total, need = len(a) + len(b), needed(len(a), len(b))
    if min(len(a), len(b)) < need or len(np.intersect1d(one, two, assume_unique=True)) < need:
        return False
    band = total - 2 * need
    size = min(len(a), len(b))
    differ = np.flatnonzero(a[:size] != b[:size])
    head = int(differ[0]) if len(differ) else size
    rest = size - head
    differ = np.flatnonzero(a[len(a) - rest :][::-1] != b[len(b) - rest :][::-1])
    tail = int(differ[0]) if len(differ) else rest
    need -= head + tail
    if need <= 0:
        return True
    a, one = a[head : len(a) - tail], one[head : len(one) - tail]
    b, two = b[head : len(b) - tail], two[head : len(two) - tail]
    ours, theirs = one[np.isin(one, two)], two[np.isin(two, one)]
    if np.array_equal(ours, theirs):
        return len(ours) >= need
    return aligned(a, b, band) >= need


def bitmap(labels: np.ndarray) -> bytes:
    """One bit for each labelled run, at its hash modulo the number of places.

    A bit that differs between two texts stands for a run that only one of them has, so they
    differ in no fewer runs than in bits.
    """
    size = 1 << min(max(BITMAP[0], (PLACES_PER_RUN * len(labels) - 1).bit_length()), BITMAP[1])
    bits = np.zeros(size, bool)
    bits[(labels & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: np.ndarray) -> np.ndarray:
    """The bitmap of the same runs with half as many places."""
    half = len(bits) // 2
    return bits[:half] | bits[half:]


def links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose texts are similar."""

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        good, last, kept = [], None, None
        for x, y in zip(binary(batch.column(2)), binary(batch.column(3))):
            if last is None or last != y:  # rows come by centre
                last, found = y, runs(y)
                kept = found, labelled(found)
            found = runs(x)
            good.append(similar(found, kept[0], labelled(found), kept[1]))
        return batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    first = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x"))
    second = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y"))
    both = pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y")
    return both.mapInArrow(lambda b: rows_of(b, check), "a long, b long").distinct()


def rare_pairs(open_docs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of different classes that may reach the share, by their rarest runs.

    With p of q to be shared, a text of n runs has at most (q - p) n / q runs that the other, no
    larger one, lacks, and the smaller one at most (q - p) n / (q + p); so if they reach the share, one run is among
    the rarest of both, one more than these numbers, in any order that both keep: by how many
    texts have the run, then by hash.
    """
    p, q = SHARE

    def spelled(batch: pa.RecordBatch) -> pa.RecordBatch:
        labels = [labelled(runs(data)).view(np.int64) for data in binary(batch.column(2))]
        made = pa.array(labels, pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made], ["rep", "class", "labels"])

    def signed(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [bitmap(labelled(runs(data))) for data in binary(batch.column(2))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["rep", "bitmap"])

    mine = texts.withColumnRenamed("doc_id", "rep").join(open_docs, "rep").select("rep", "class", "text")
    bitmaps = written(mine.mapInArrow(lambda b: rows_of(b, signed), "rep long, bitmap binary"), "near-bitmaps")
    labels = mine.mapInArrow(lambda b: rows_of(b, spelled), "rep long, class long, labels array<long>")
    labels = written(labels.select("rep", "class", F.size("labels").alias("n"), F.explode("labels").alias("label")), "near-runs")
    common = labels.groupBy("label").agg(F.count(F.lit(1)).alias("texts"))
    ranked = labels.join(common, "label").groupBy("rep", "class", "n")
    ranked = ranked.agg(F.sort_array(F.collect_list(F.struct("texts", "label"))).alias("rarest"))
    # Runs that no other text has keep their places in the order but match nothing.
    near_enough = F.floor(F.col("n") * (q - p) / q) + 1
    closer = F.floor(F.col("n") * (q - p) / (q + p)) + 1
    first = ranked.select("rep", "class", "n", closer.alias("closer"), F.posexplode(F.slice("rarest", F.lit(1), near_enough.cast("int"))))
    first = first.filter("col.texts > 1").select("rep", "class", "n", (F.col("pos") < F.col("closer")).alias("small"), "col.label")
    first = written(first, "near-rarest")

    # Documents of one run in blocks; every two blocks meet once.
    blocks = first.groupBy("label").agg(
        F.count(F.lit(1)).alias("texts"), F.min("class").alias("low"), F.max("class").alias("high")
    )
    blocks = blocks.filter("low < high").select("label", (1 + F.floor(F.col("texts") / BLOCK)).cast("int").alias("blocks"))
    dealt = first.join(blocks, "label").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"one": F.least("block", "with"), "two": F.greatest("block", "with")})
    keys = ["label", "one", "two"]
    met = dealt.join(bitmaps, "rep").repartition(*keys).sortWithinPartitions(*keys, "rep")
    met = met.select(*keys, "block", "rep", "class", "n", "small", "bitmap")
    return met.mapInArrow(_met, "a long, b long").distinct()


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose bitmaps allow the share, from documents sorted by run and blocks."""
    group, members, pairs = None, [], []
    for batch in batches:
        for *key, block, rep, cls, n, small, bits in zip(*(c.to_pylist() for c in batch.columns)):
            if key != group:
                pairs += _enough(group, members)
                group, members = key, []
            members.append((n, rep, block, cls, small, np.frombuffer(bits, np.uint8)))
        yield _pairs(pairs)
        pairs = []
    yield _pairs(_enough(group, members))


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    columns = list(zip(*pairs)) or [[], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])


def _enough(key, members: list[tuple]) -> list[tuple[int, int]]:
    """Pairs of a group that may reach the share: the smaller text has the run among its closer
    ones, the classes differ, and the bitmaps do not differ in more places than the texts may in runs."""
    if len(members) < 2:
        return []
    out = []
    members.sort(key=lambda m: m[:2])
    n, rep, block, cls = (np.array([m[i] for m in members], np.int64) for i in range(4))
    p, q = SHARE
    ends = np.searchsorted(n * p, n * q, side="right")
    width = np.array([len(m[5]) for m in members])
    stacked: dict[int, np.ndarray] = {}
    for size in set(width.tolist()):  # all that have this many places, or twice as many
        rows = [m[5] if len(m[5]) == size else folded(m[5]) if len(m[5]) == 2 * size else np.zeros(size, np.uint8) for m in members]
        stacked[size] = np.stack(rows)
    for i, (_, _, _, _, small, mine) in enumerate(members):
        if not small:
            continue
        others = slice(i + 1, ends[i])
        may = cls[others] != cls[i]
        if key[1] != key[2]:
            may &= block[others] != block[i]
        at = np.flatnonzero(may) + i + 1
        if not len(at):
            continue
        total = n[at] + n[i]
        differ = np.bitwise_count(stacked[len(mine)][at] ^ mine).sum(axis=1, dtype=np.int64)
        at = at[differ <= total - 2 * -(-p * total // (p + q))]
        out += [(min(a, rep[i].item()), max(a, rep[i].item())) for a in rep[at].tolist()]
    return out


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node that each node is connected with, for nodes above it.

    Large-star and small-star steps by turns: each joins nodes to the smallest neighbour known. Every
    turn is written; the last one leaves stars: each node has one neighbour, and that has none.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _stars(edges: DataFrame) -> bool:
    """Whether no node has two smaller neighbours, or one that has a smaller one itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def _fits(n: str, m: str):
    """Numbers of runs that allow the share."""
    return (F.least(n, m) * SHARE[1]) >= (F.greatest(n, m) * SHARE[0])


def near_classes(docs: DataFrame) -> DataFrame:
    """One row per document row: ``doc_id, raw`` (hash of the text), ``class_id, kept``.

    ``class_id`` is the smallest id that a document is connected with by links, ``kept`` marks the
    document of that id, one row of it. Words are runs of letters, digits and non-ASCII characters in lower case. A text
    without words is like no other and a class of its own; a null id names nothing: such rows have a
    null class and stay. Rows that share an id are compared each by their text.
    """
    known = written(sketches(docs), "near-sketches")
    first = written(known.filter("n > 0").groupBy("words").agg(F.min("doc_id").alias("rep")), "near-first")
    members = known.join(first, "words", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    nodes = members.filter("n > 0 and doc_id = rep")
    short = nodes.filter(F.col("n") <= SHORT).select("rep")
    nodes = nodes.select("rep", "n", F.explode("keys").alias("key"))
    nodes = written(nodes, "near-nodes")
    shared = written(nodes.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "near-shared")
    buckets = written(nodes.join(shared, "key"), "near-buckets")

    wanted = buckets.select(F.col("rep").alias("doc_id")).union(short).distinct()
    # Dealt by id at every size: a broadcast of the ids would grow with the copies.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted.hint("shuffle_merge"), "doc_id")
    texts = written(texts, "near-texts")

    fame = buckets.groupBy("rep").agg(F.sum("size").alias("fame"))
    best = F.max(F.struct("fame", (-F.col("rep")).alias("back"), "n")).alias("best")
    centres = buckets.join(fame, "rep").groupBy("key").agg(best)
    centres = centres.select("key", (-F.col("best.back")).alias("b"), F.col("best.n").alias("m"))
    tested = buckets.join(centres, "key").filter((F.col("rep") != F.col("b")) & _fits("n", "m"))
    tested = written(tested.select(F.col("rep").alias("a"), "b").distinct(), "near-pairs")
    found = written(links(tested, texts), "near-links")

    roots = components(found)
    classed = buckets.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    classed = classed.select("key", "rep", "n", F.coalesce("root", "rep").alias("class"))
    mixed = classed.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    mixed = mixed.filter("low < high").select("key")
    open_rows = written(classed.join(mixed, "key"), "near-open")
    lone = short.distinct().join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("root", "rep").alias("class"))
    more = rare_pairs(open_rows.select("rep", "class").union(lone).distinct(), texts)
    seen = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = written(more.join(seen, ["a", "b"], "left_anti"), "near-more")
    late = written(links(more, texts), "near-late")
    if not late.isEmpty():
        roots = components(found.unionByName(late))

    out = members.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    out = out.select("doc_id", "raw", F.coalesce("root", "rep").alias("class_id"))
    nameless = docs.filter("doc_id is null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("raw"), F.lit(None).cast("long").alias("class_id")
    )
    stays = Window.partitionBy("doc_id").orderBy(F.col("doc_id") != F.col("class_id"), "raw")
    first = (F.col("doc_id") == F.col("class_id")) & (F.row_number().over(stays) == 1)
    return out.withColumn("kept", first).unionByName(nameless.withColumn("kept", F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, with all its columns; rows without an id stay."""
    found = near_classes(docs).filter("doc_id is not null")
    kept = found.groupBy(F.col("doc_id").alias("_id"), F.col("raw").alias("_raw")).agg(
        F.max("kept").alias("_kept"), F.count(F.lit(1)).alias("_copies")
    )
    kept = written(kept.filter("_kept").drop("_kept"), "near-kept")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc")
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_raw"), whole)
    named = rows.join(kept, ["_id", "_raw"])
    # Only rows that repeat id and text are numbered; the texts are dealt out once for both parts.
    same = Window.partitionBy("_id", "_raw").orderBy("_raw")
    once = named.filter("_copies = 1").select("_doc.*")
    several = named.filter("_copies > 1").withColumn("_row", F.row_number().over(same)).filter("_row = 1")
    return once.unionByName(several.select("_doc.*")).unionByName(docs.filter("doc_id is null"))
