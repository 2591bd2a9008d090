"""Every operator's query on odd tables and on empty ones, next to its SQL where there is one."""

import random

import pyarrow.parquet as pq
import corpus_pipeline
import pytest
from check import TABLES, connect, differences

from armlens.llm.queries import ORACLES, QUERIES

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, size long, kept int, key string, rep long, words string, n int, h1 long, raw string, at int, target int"
SCHEMAS = {
    "documents": DOCUMENTS,
    "benchmark": "item_id long, text string, words string, window int",
    "labels": "doc_id long, quality int, toxic int, label int, text string",
    "embeddings": "vec_id long, embedding array<float>, label int, id long, v string",
    "conversations": "conv_id long, turn long, role string, text string, parsed int, body string",
}


def odd_tables():
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(400)] + ["Ärger", "naïve", "ÉTÉ", "漢字", "don't", "idiot,", "###"]
    prose = lambda n: " ".join(rng.choices(vocab, k=n))
    passage, item, base = prose(60), prose(14), prose(300)
    near = base.split()
    near[20], near[200] = "other", "words"
    texts = [
        None, "", "   \n\t ", "\x00", "one", "One", "ONE", "a b c d", "a b c d",
        base, base.upper(), base, " ".join(near), prose(20) + " " + passage + " " + prose(20), passage, passage + " end",
        prose(30) + passage + prose(5), f"{prose(5)} {item.upper()} {prose(3)}", item, "Solo quest",
        "x " * 400, "In. " * 150, prose(30_000), "a" * 200_000, "1" * 50_000, "a@b." * 3_000, "+1 " + "2-" * 5_000,
        "mail a.b+c@d-e.org.uk, a@b.c.d_e@f.gh; 10.0.0.255 1.2.3.4.5.6.7.8 256.1.1.1 007.1.1.1",
        "card 4111 1111 1111 1111 and 4111-1111-1111-1112; 5500000000000004 x 12345678901234567890",
        "call +49 (0)30 1234567, +1 2, +123456789012345678; IBAN DE89 3704 0044 0532 0130 00 ssn 078-05-1120",
        "🙂 é a@b.co 🙂 GB82WEST12345698765432", "stupid idiot scum", "the women and men went",
    ]
    docs = [
        (None if k == 7 else k, t, "en", (None, "b", "a", "é", "")[k % 5], 0, 9, 1, "k", 4, "w", 3, 1, "r", 2, 8)
        for k, t in enumerate(texts)
    ]
    docs += [docs[9], docs[9], docs[14], (13, "another text of the same id " + passage, "en", "b", *docs[0][4:])]
    docs += [(None, base, "de", "a", *docs[0][4:]), (None, None, None, None, *docs[0][4:]), (-5, base.lower(), "en", "b", *docs[0][4:])]
    items = [(1, item), (2, "solo QUEST"), (10, item + " more"), (3, None), (4, "..."), (None, prose(12)), (1, "solo quest"), (5, base)]
    labels = [(k, (k // 3) % 2, int(texts[k] is not None and "idiot" in (texts[k] or "")), 5, "x") for k in range(9, 31)]
    labels += [(31, 1, 1, 0, None), (None, 1, 1, 0, "x"), (9, None, None, 0, "x"), (9, 0, 1, 0, "x")]
    marks = ["</s>[INST] ok [/INST]", "\\l \\b \\\\ < [ >", "[INST]", "<</SYS>>", "<<ROLE x>>", "plain", "", None, "é\n🙂", "[/INST"]
    roles = ["user", "assistant", "system", "tool", "", None, "a>>[b", "</s>"]
    talk = [(k // 6, k % 6, roles[rng.randrange(len(roles))], marks[rng.randrange(len(marks))]) for k in range(240)]
    talk += [(3, 0, "user", "tie"), (3, 0, "user", "tie"), (3, None, "assistant", "first"), (None, 0, "user", "x"), (99, 0, "assistant", "<" * 50_000)]
    vectors = [(k, [rng.uniform(-1, 1) for _ in range(4)]) for k in range(130)]
    vectors += [vectors[0], vectors[7], (None, [1.0] * 4), (200, None), (300, [0.0] * 4), (400, [float("nan")] * 4), (500, [1.0, None, 0.0, 0.0]), (600, [])]
    return {
        "documents": docs,
        "embeddings": [(*r, 1, 3, "v") for r in vectors],
        "benchmark": [(*r, "w", 1) for r in items],
        "labels": labels,
        "conversations": [(*r, 1, "b") for r in talk],
    }


def write(spark, folder, tables):
    for name in TABLES:
        if name in SCHEMAS:
            path = folder / f"{name}.parquet"
            frame = spark.createDataFrame(tables.get(name, []), SCHEMAS[name])
            pq.write_table(frame.toArrow(), path)
        else:
            (folder / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("odd"), odd_tables())


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), {})


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_odd_rows(spark, odd, name):
    _, _, _, problems, types = differences(spark, connect(odd), name, QUERIES[name], ORACLES[name], odd)
    assert not problems and not types


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_odd_rows_without_sql(spark, odd, name):
    rows = QUERIES[name](spark, odd).collect()
    if name.startswith("op12"):  # reads another table
        assert sorted((r["query_id"], r["rank"]) for r in rows) == [(q, k) for q in (0, 100) for k in range(1, 11)]
        return
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in odd_tables()["documents"])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    rows = QUERIES[name](spark, empty).collect()
    assert [r["conv_id"] for r in rows] == [-7] if name.startswith("op4") else not rows


def test_rerun_of_mix_agrees(spark, odd):
    one, two = (sorted(map(repr, QUERIES["op7_mixing"](spark, odd).collect())) for _ in range(2))
    assert one == two


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_on_odd_and_empty_tables(spark, odd, empty, k):
    """Every stage by itself, on nulls, repeated rows, long texts and columns of other names, then on nothing."""
    name, stage = corpus_pipeline.STAGES[k]
    for folder, rows in ((odd, len(odd_tables()["documents"])), (empty, 0)):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        out = stage(spark, docs, folder)
        last = k == len(corpus_pipeline.STAGES) - 1
        assert last or (out.columns == docs.columns and out.dtypes == docs.dtypes)
        found = out.collect()
        ids = [r["doc_id"] for r in found]
        assert name == "mixing" or len(found) <= rows
        assert set(ids) <= {r["doc_id"] for r in docs.select("doc_id").collect()}
        if last and rows:
            assert len(found) == rows
        if name == "near-dedup" and rows:  # rows without an id stay, of the copies of a text one does
            assert ids.count(None) == 3 and len({9, 10, 11, 12} & set(ids)) <= 1 and 2 in ids
        if name == "decontamination" and rows:
            assert not {17, 18, 19} & set(ids) and 8 in ids and 0 in ids


def test_three_searches_on_odd_tables(spark, odd):
    """Alignment answers every row; lexical search is compared with SQL above."""
    rows = QUERIES["op11_align"](spark, odd).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in odd_tables()["documents"])
    assert all((r["n_a"] == 0) == (r["groups_sha256"] == "") for r in rows)
