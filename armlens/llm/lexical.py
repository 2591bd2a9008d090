"""Ranked lexical search by pipelined term partitioning.

Documents become slices of bounded size, and every slice a small inverted file: one row per term
with the places of its documents and the term's counts there. The terms that items ask for are dealt
to term owners by how common they are, the rarest first. A bundle, which is a slice with all items
of a block, then passes the owners one after the other: at each stage it meets that owner's
postings in a cogroup, adds their integer contributions to its sparse accumulators and goes on.

The accumulators that travel on are those that can still be among an item's best: a score plus all
that the later owners' terms can add, against the k-th best score that the item already has in the
slice. Scores only grow, so nothing that belongs to the result is left out. After the last stage each
slice gives its k best documents an item, and the best of those are the result.
"""

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from armlens.llm.frames import WORDS, binary, written

#: Documents of one slice, and bytes of text after which it ends earlier.
SLICE_DOCS = 2048
SLICE_BYTES = 16 << 20
#: Items that one bundle carries; more are searched block by block.
ITEMS_AT_ONCE = 512
#: A term goes to the first owner whose share of the documents it does not exceed: 1 in 64, 16, 4; the
#: last owner has the rest.
OWNER_SHARES = (64, 16, 4)
K = 10
#: A contribution is below its weight times this.
UNIT = 1_000_000
ROWS_AT_ONCE = 10_000

INDEX = pa.schema(
    [
        ("slice", pa.int64()),
        ("term", pa.binary()),
        ("docs", pa.binary()),
        ("counts", pa.binary()),
        ("df", pa.int64()),
        ("ids", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int64())),
    ]
)
INDEX_DDL = "slice long, term binary, docs binary, counts binary, df long, ids array<long>, sizes array<long>"
BUNDLE = pa.schema(
    [
        ("slice", pa.int64()),
        ("item", pa.int64()),
        ("docs", pa.binary()),
        ("scores", pa.binary()),
        ("ids", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int64())),
    ]
)
BUNDLE_DDL = "slice long, item long, docs binary, scores binary, ids array<long>, sizes array<long>"
FOUND = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
FOUND_DDL = "item long, doc_id long, score long"


def terms_of(data: bytes) -> list[bytes]:
    """Lower-case runs of ASCII letters, digits and all beyond ASCII."""
    return data.translate(WORDS).split()


def _slice_rows(number: int, ids: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
    """A slice's head (ids and sizes of its documents), then one row per term."""
    code: dict[bytes, int] = {}
    words = [[code.setdefault(w, len(code)) for w in terms_of(data)] for data in texts]
    sizes = [len(x) for x in words]
    head = {"slice": [number], "ids": [ids], "sizes": [sizes]}
    yield pa.RecordBatch.from_arrays([pa.array(head.get(f.name, [None]), f.type) for f in INDEX], schema=INDEX)
    flat = np.concatenate([np.array(x, np.int64) for x in words])
    keys, counts = np.unique(flat * len(texts) + np.repeat(np.arange(len(texts)), sizes), return_counts=True)
    term, place = np.divmod(keys, len(texts))
    starts = np.searchsorted(term, np.arange(len(code) + 1))
    columns = {
        "slice": pa.array(np.full(len(code), number)),
        "term": pa.array(list(code), pa.binary()),
        "docs": _runs(place.astype(np.uint16), starts),
        "counts": _runs(counts.astype(np.int32), starts),
        "df": pa.array(np.diff(starts)),
    }
    rows = pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(len(code), f.type)) for f in INDEX], schema=INDEX)
    for at in range(0, rows.num_rows, ROWS_AT_ONCE):
        yield rows.slice(at, ROWS_AT_ONCE)


def _runs(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The bytes of the values from each start to the next, as a column."""
    offsets = pa.py_buffer((starts * values.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, offsets, pa.py_buffer(values)])


def index(docs: DataFrame) -> DataFrame:
    """The inverted file of ``docs`` in slices, written to the shared folder.

    A slice is a run of one input partition's rows, at most 2 048 of them. Its head row has ``ids`` and
    ``sizes`` (terms with repeats); every other row is a ``term`` with the places of its documents in
    the slice, its counts there and ``df``, how many they are. Null and empty texts have no terms;
    repeated rows are documents of their own.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId() << 32, 0
        ids, texts, size = [], [], 0
        for batch in batches:
            for one, data in zip(batch.column(0).to_pylist(), binary(batch.column(1))):
                ids.append(one)
                texts.append(data)
                size += len(data)
                if len(ids) == SLICE_DOCS or size >= SLICE_BYTES:
                    yield from _slice_rows(part + number, ids, texts)
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield from _slice_rows(part + number, ids, texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(build, INDEX_DDL)
    return written(rows, "postings")


def item_terms(items: DataFrame) -> DataFrame:
    """``item, term``: each item's terms once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, t) for i, d in zip(batch.column(0).to_pylist(), binary(batch.column(1))) for t in set(terms_of(d))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in found], pa.int64()), pa.array([t for _, t in found], pa.binary())], ["item", "term"]
            )

    return items.select("item", "text").mapInArrow(cut, "item long, term binary")


def _table(columns: dict[str, list], schema: pa.Schema) -> pa.Table:
    size = max(map(len, columns.values()), default=0)
    return pa.table([pa.array(columns.get(f.name, [None] * size), f.type) for f in schema], schema=schema)


def _stage(later: dict[int, int], n_docs: int, n_terms: int, k: int, last: bool):
    """One owner's step: a bundle and that owner's postings of the slice give the bundle of the next.

    ``later`` has what the owners after this one can add to an item's score at most.
    """

    def step(bundle: pa.Table, postings: pa.Table) -> pa.Table:
        left = bundle.to_pydict()
        head = next((i for i, item in enumerate(left["item"]) if item is None), None)
        if head is None:  # postings always belong to a slice with a head
            return _table({}, FOUND if last else BUNDLE)
        ids, sizes = left["ids"][head], left["sizes"][head]
        length = np.array([10 + 90 * n * n_docs // n_terms for n in sizes], np.int64)
        scores: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(len(ids), np.int64))
        for item, docs, carried in zip(left["item"], left["docs"], left["scores"]):
            if item is not None:
                scores[item][np.frombuffer(docs, np.uint16)] = np.frombuffer(carried, np.int64)
        right = postings.select(["docs", "counts", "weight", "items"]).to_pydict()
        for docs, counts, weight, items in zip(*right.values()):
            places, tf = np.frombuffer(docs, np.uint16), np.frombuffer(counts, np.int32).astype(np.int64)
            added = weight * (1_000_000_000 * tf // (1000 * tf + 8 * length[places]))
            for item in items:
                scores[item][places] += added
        out: dict[str, list] = defaultdict(list)
        if not last:
            out |= {"slice": [left["slice"][head]], "item": [None], "docs": [None], "scores": [None], "ids": [ids], "sizes": [sizes]}
        for item, row in scores.items():
            least = 1
            if len(row) > k:
                least = max(least, int(np.partition(row, len(row) - k)[len(row) - k]) - later.get(item, 0))
            kept = np.flatnonzero(row >= least)
            if not len(kept):
                continue
            if not last:
                parts = (left["slice"][head], item, kept.astype(np.uint16).tobytes(), row[kept].tobytes(), None, None)
                for name, value in zip(BUNDLE.names, parts):
                    out[name].append(value)
                continue
            best = sorted(kept.tolist(), key=lambda d: (-row[d], ids[d] is None, ids[d]))[:k]
            out["item"] += [item] * len(best)
            out["doc_id"] += [ids[d] for d in best]
            out["score"] += row[best].tolist()
        return _table(out, FOUND if last else BUNDLE)

    return step


def search(docs: DataFrame, items: DataFrame, k: int = K, items_at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """The ``k`` best documents of each item: ``item_id, rank, doc_id, score``.

    ``docs`` has ``doc_id, text`` and ``items`` has ``item_id, text``; other columns are not read. The
    score is the integer form of a saturated term frequency with a length norm (see ``_stage``). Each
    row is an item or a document of its own, also where ids repeat or are null; null and empty texts
    have no terms and no rows; equal scores go by ascending document id, without an id last. Without
    documents or items there is no row.
    """
    return search_index(index(docs), items, k, items_at_once)


def search_index(postings: DataFrame, items: DataFrame, k: int = K, items_at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """``search`` over what ``index`` gave."""
    spark = postings.sparkSession
    heads = postings.filter("term IS NULL")
    total = heads.select(F.explode("sizes").alias("n")).agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    numbered = written(items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()), "items")
    blocks = -(-numbered.count() // items_at_once) if total["terms"] else 0
    found = spark.createDataFrame([], FOUND_DDL)
    for block in range(blocks):
        mine = numbered.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        found = found.union(_search_block(postings, heads, mine, total["docs"], total["terms"], k))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _search_block(postings: DataFrame, heads: DataFrame, items: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    asked = item_terms(items).groupBy("term").agg(F.collect_list("item").alias("items"))
    rows = postings.filter("term IS NOT NULL").select("slice", "term", "docs", "counts", "df")
    owner = F.lit(len(OWNER_SHARES))
    for at, share in reversed(list(enumerate(OWNER_SHARES))):
        owner = F.when(F.col("df") * share <= n_docs, at).otherwise(owner)
    ratio = F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double")
    terms = (
        rows.groupBy("term")
        .agg(F.sum("df").alias("df"))
        .join(asked, "term")
        .select("term", "items", F.floor(1000 * F.log(ratio)).cast("long").alias("weight"), owner.alias("owner"))
    )
    terms = written(terms, "item-terms")
    # At most one row per item of the block and owner.
    sums = terms.select(F.explode("items").alias("item"), "owner", "weight").groupBy("item", "owner").agg(F.sum("weight").alias("w"))
    weights = {(r["item"], r["owner"]): r["w"] for r in sums.collect()}
    matched = rows.drop("df").join(terms, "term")
    path = written(matched.select("slice", "docs", "counts", "weight", "items", "owner"), "owners", "owner")
    bundle = heads.select(
        "slice", F.lit(None).cast("long").alias("item"), F.lit(None).cast("binary").alias("docs"),
        F.lit(None).cast("binary").alias("scores"), "ids", "sizes",
    )
    owners = len(OWNER_SHARES) + 1
    for at in range(owners):
        later: dict[int, int] = defaultdict(int)
        for (item, by), w in weights.items():
            later[item] += w * UNIT if by > at else 0
        last = at == owners - 1
        step = _stage(dict(later), n_docs, n_terms, k, last)
        own = path.filter(F.col("owner") == at).drop("owner")
        bundle = bundle.groupBy("slice").cogroup(own.groupBy("slice")).applyInArrow(step, FOUND_DDL if last else BUNDLE_DDL)
    return bundle


ORACLE = f"""
WITH dt AS (
  SELECT row_number() OVER () AS d, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
it AS (
  SELECT i, item_id, unnest(list_distinct(w)) AS term
  FROM (SELECT row_number() OVER () AS i, item_id,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
        FROM benchmark)),
total AS (SELECT count(*) FILTER (len(w) > 0)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM dt),
tf AS (SELECT d, term, count(*)::BIGINT AS tf FROM (SELECT d, unnest(w) AS term FROM dt) GROUP BY d, term),
wt AS (SELECT term, floor(1000 * ln((2.0 * n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight
       FROM tf, total WHERE term IN (SELECT term FROM it) GROUP BY term, n),
added AS (
  SELECT d, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(w)::BIGINT * n) // l))) AS part
  FROM tf JOIN wt USING (term) JOIN dt USING (d), total),
scored AS (SELECT i, item_id, d, sum(part)::BIGINT AS score FROM it JOIN added USING (term) GROUP BY i, item_id, d),
ranked AS (
  SELECT i, item_id, doc_id, score,
         row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored JOIN dt USING (d) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= {K}"""
