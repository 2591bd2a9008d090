"""Alignment, nearest neighbours and lexical search against plain versions of themselves."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from armlens.llm import align, lexical, permutation
from armlens.llm.queries import QUERIES
from armlens.llm.tokens import vocabulary_path

DATA = "/root/testdata/sf0.001"

# 11


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary_path(align.VOCABULARY_A))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=vocabulary_path(align.VOCABULARY_B))


def spans(lengths):
    ends = np.cumsum(lengths).tolist()
    return list(zip([0, *ends], ends))


def plain_alignment(libraries, text):
    """Ids, links and cuts of one text by comparing all spans."""
    a, b = libraries
    if not text:
        return [], [], [], []
    byte = align.byte_of_character()
    ia = a.encode(" " + text, add_special_tokens=False).ids
    ib = b.encode(text)
    bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ia]
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    bytes_b = [piece(i) for i in ib]
    if not b"".join(bytes_a) == b"".join(bytes_b) == b" " + text.encode():
        return [], [], [], []
    sa, sb = spans([len(x) for x in bytes_a]), spans([len(x) for x in bytes_b])
    links = [(x, y) for x, (s, e) in enumerate(sa) for y, (s2, e2) in enumerate(sb) if s < e2 and s2 < e]
    return ia, ib, links, sorted({e for _, e in sa} & {e for _, e in sb})


def plain_rows(libraries, documents):
    found = [(doc, *plain_alignment(libraries, text)) for doc, text in documents]
    counts = Counter((ia[x], ib[y]) for _, ia, ib, links, _ in found for x, y in links)
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(n, most.get(y, 0))
    rows = []
    for (doc, text), (_, ia, ib, links, cuts) in zip(documents, found):
        here = [(ia[x], ib[y]) for x, y in links]
        length = len(text.encode()) + 1 if ia else 0
        groups = []
        if ia:
            sa, sb = spans_of(libraries, text)
            for start, end in zip([0, *cuts], cuts):
                inside = [",".join(str(i) for i, (s, e) in zip(ids, side) if start <= s and e <= end) for ids, side in ((ia, sa), (ib, sb))]
                groups.append("|".join(inside))
            assert cuts[-1] == length
        rows.append(
            (
                doc, len(ia), len(ib), len(cuts), len(links),
                sum(counts[p] == most[p[1]] for p in here), sum(counts[p] for p in here),
                hashlib.sha256(";".join(groups).encode()).hexdigest() if ia else "",
            )
        )
    return rows


def spans_of(libraries, text):
    a, b = libraries
    byte = align.byte_of_character()
    la = [len(a.id_to_token(i)) for i in a.encode(" " + text, add_special_tokens=False).ids]
    assert all(c in byte for i in a.encode(text, add_special_tokens=False).ids for c in a.id_to_token(i))
    lb = [1 if b.is_byte(i) else len(b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    return spans(la), spans(lb)


def odd_texts():
    rng = random.Random(3)
    letters = ["a", "é", " ", "  ", "\n", "漢", "🙂", "<s>", "</s>", "<|endoftext|>", "<0x41>", "the ", "tion", "▁", "\x00", "Straße", "1234", "́"]
    return [None, "", " ", "▁", "x", "x", *("".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(120))]


def test_alignment_next_to_all_spans(spark, libraries, tmp_path):
    documents = list(enumerate(odd_texts())) + [(None, "no id"), (4, "x again")]
    frame = spark.createDataFrame([(d, t, 1, "p") for d, t in documents], "doc_id long, text string, block long, pair string")
    got = align.align(frame).select(*align.RESULT.names[:-1], "groups_sha256").collect()
    want = plain_rows(libraries, documents)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert sum(r["n_a"] > 0 for r in got) > 30


def test_query_on_real_texts(spark, libraries):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    got = {r["doc_id"]: r for r in QUERIES["op11_align"](spark, DATA).collect()}
    assert len(got) == len(rows) and all(r["n_a"] and r["n_b"] for r in got.values())
    short = [(r["doc_id"], r["text"]) for r in rows if len(r["text"]) < 1200][:40]
    for want in plain_rows(libraries, short):
        found = got[want[0]]
        assert tuple(found[c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")) == (*want[1:5], want[7])
        assert found["count_sum"] >= want[6]


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    one = sorted(map(tuple, align.align(docs).collect()))
    assert one == sorted(map(tuple, align.align(docs.repartition(7)).collect()))
    monkeypatch.setattr(align, "BLOCK_BYTES", 8 << 20)
    assert len(list(align._in_blocks(["a" * (5 << 20), "b" * (4 << 20), "c", "d" * (9 << 20)]))) == 3


def test_alignments_give_links_and_cuts(spark, libraries):
    texts = odd_texts()
    got = {r["doc_id"]: r for r in align.alignments(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for doc, text in enumerate(texts):
        ia, ib, links, cuts = plain_alignment(libraries, text)
        r = got[doc]
        assert (r["a_ids"], r["b_ids"], sorted(map(tuple, r["links"])), r["cuts"]) == (ia, ib, links, cuts)


# 12


def nearest(rows, every, k=10):
    ids = np.array(sorted(rows))
    points = np.array([rows[i] for i in ids])
    out = {}
    for place in np.flatnonzero(ids % every == 0):
        far = np.sqrt(((points - points[place]) ** 2).sum(1))
        far[place] = np.inf
        order = np.lexsort((ids, far))[: min(k, len(ids) - 1)]
        out[ids[place]] = [(ids[o], far[o]) for o in order]
    return out


def recall(found, want):
    hits = [len({v for v, _ in want[q]} & {r["vec_id"] for r in found if r["query_id"] == q}) / max(1, len(want[q])) for q in want]
    return sum(hits) / len(hits)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    want = nearest(rows, 100)
    found = QUERIES["op12_neighbours"](spark, folder).collect()
    assert recall(found, want) >= 0.9
    points = {i: np.array(v) for i, v in rows.items()}
    for q in want:
        mine = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(want[q]) + 1))
        assert [(r["score"], r["vec_id"]) for r in mine] == sorted((r["score"], r["vec_id"]) for r in mine)
        for r in mine:
            assert math.isclose(r["score"], np.linalg.norm(points[q] - points[r["vec_id"]]), rel_tol=1e-12, abs_tol=1e-15)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]),
        (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (10, [-1.0, 0.0]), (None, [1.0, 1.0]), (2, [0.0, 2.0]), (-3, [0.0, 1.0]),
        (100, [-1e9, 0.0]),
    ]
    frame = spark.createDataFrame([(*r, 1, "v", 3) for r in rows], "vec_id long, embedding array<double>, id long, v string, shard int")
    got = sorted(map(tuple, permutation.search(frame).collect()))
    far = math.sqrt(2.0)
    assert got[:5] == [(0, 1, 1, 0.0), (0, 2, -3, far), (0, 3, 2, far), (0, 4, 10, 2.0), (0, 5, 100, 1e9 + 1)]
    assert [r[2] for r in got[5:]] == [10, -3, 2, 0, 1]
    empty = permutation.search(frame.limit(0))
    assert empty.columns == ["query_id", "rank", "vec_id", "score"] and not empty.collect()
    alone = permutation.search(frame.filter("vec_id = 0"))
    assert not alone.collect()


def test_many_copies_and_shards(spark, monkeypatch):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(3000, 8))
    points[::3] = points[0]
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(permutation, "BLOCK_NUMBERS", 80)
    found = permutation.search(frame).collect()
    want = nearest(dict(enumerate(points)), 100)
    assert recall(found, want) >= 0.9
    copies = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == 300)
    assert copies == [(k + 1, 3 * k, 0.0) for k in range(10)]


# 13


def plain_search(documents, items, k=10):
    cut = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [cut.findall((t or "").translate(lower)) for _, t in documents]
    n_docs, n_terms = sum(map(bool, words)), sum(map(len, words))
    df = Counter(w for x in words for w in set(x))
    tf = [Counter(x) for x in words]
    out = []
    for item, text in items:
        asked = set(cut.findall((text or "").translate(lower)))
        scored = []
        for (doc, _), x, counts in zip(documents, words, tf):
            m = 10 + 90 * len(x) * n_docs // n_terms if n_terms else 0
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * counts[w] // (1000 * counts[w] + 8 * m))
                for w in asked
                if counts[w]
            )
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, rank + 1, doc, -score) for rank, (score, _, doc) in enumerate(sorted(scored, key=repr_key)[:k])]
    return out


def repr_key(row):
    return (row[0], row[1], row[2] or 0)


def test_search_next_to_a_plain_one(spark, monkeypatch):
    rng = random.Random(7)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(3000)]
    documents = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(0, 80)))) for k in range(900)]
    documents += [(901, None), (902, ""), (None, "w1 W2, w3"), (5, "w7 w7"), (5, "w7 w7"), (903, "É é ß"), (904, "w1 " * 3000)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(1, 12)))) for k in range(40)]
    items += [(3, "W1"), (None, "w2 w2"), (41, None), (42, "..."), (43, "é nowhere")]
    docs = spark.createDataFrame([(*d, 1, "t") for d in documents], "doc_id long, text string, item long, term string").repartition(3)
    rows = spark.createDataFrame([(*i, 1, "s") for i in items], "item_id long, text string, doc_id long, slice string")
    want = sorted(map(repr, plain_search(documents, items)))
    assert sorted(map(repr, map(tuple, lexical.search(docs, rows).collect()))) == want
    monkeypatch.setattr(lexical, "SLICE_DOCS", 16)
    assert sorted(map(repr, map(tuple, lexical.search(docs, rows, items_at_once=7).collect()))) == want
    assert not lexical.search(docs.limit(0), rows).collect() and not lexical.search(docs, rows.limit(0)).collect()


def test_a_stage_carries_only_what_can_still_win():
    step = lexical._stage({1: 100}, 30, 300, 2, last=False)
    sizes = list(range(1, 31))
    head = {"slice": [0], "item": [None], "docs": [None], "scores": [None], "ids": [list(range(30))], "sizes": [sizes]}
    carried = {"slice": [0], "item": [1], "docs": [np.arange(4, dtype=np.uint16).tobytes()], "scores": [np.array([500, 400, 299, 300]).tobytes()], "ids": [None], "sizes": [None]}
    bundle = lexical._table({k: head[k] + carried[k] for k in head}, lexical.BUNDLE)
    import pyarrow as pa

    none = pa.table({"docs": pa.array([], pa.binary()), "counts": pa.array([], pa.binary()), "weight": pa.array([], pa.int64()), "items": pa.array([], pa.list_(pa.int64()))})
    out = step(bundle, none).to_pydict()
    assert out["item"] == [None, 1]
    assert np.frombuffer(out["docs"][1], np.uint16).tolist() == [0, 1, 3]
