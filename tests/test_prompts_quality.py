import random
import re
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from armlens import schema as S
from armlens.catalogue import QUERIES, adapters
from armlens.functions.stem import stem
from armlens.functions.udfs import lcs_length
from armlens.operators import prompts, quality
from armlens.sources import prompts as source


@pytest.fixture(scope="module")
def turns(spark):
    data = [(i, 0, "system", "be kind") for i in range(60)]
    data += [(i, 1, "user", f" question number {i:04d} ??") for i in range(60)]
    data += [(i, 3, "user", "second question is here") for i in range(60)]
    data += [(100, 0, "user", " " + "x" * 19 + "\n"), (101, 0, "user", "y" * 20), (102, 0, "assistant", "z" * 30)]
    data += [(103, 0, "user", "w" * 2000)]
    return spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string")


def test_chat_prompts(turns):
    first = prompts.first_turn(turns)
    got = rows(prompts.chat_prompts(first, n=1000), "id")
    assert [r[0] for r in got[:2]] == ["chat_0000", "chat_0001"] and len(got) == 62
    texts = {r[2] for r in got}
    assert "y" * 20 in texts and "x" * 19 not in texts and "w" * 1500 in texts
    assert all(t == t.strip() for t in texts)


def test_sample_does_not_depend_on_partitions(turns):
    first = prompts.first_turn(turns)
    a = rows(prompts.chat_prompts(first.repartition(1), n=10), "id")
    b = rows(prompts.chat_prompts(first.repartition(13), n=10), "id")
    c = rows(prompts.chat_prompts(first, n=10, seed=7), "id")
    assert a == b and len(a) == 10 and [r[2] for r in a] != [r[2] for r in c]


def test_code_prompts_repeat(spark):
    items = spark.createDataFrame([(i, f" p{i}\n", f"s{i}", f"e{i}") for i in range(4)], "item_id int, prompt string, canonical_solution string, entry_point string")
    got = rows(prompts.code_prompts(items, n=10), "id")
    assert [r[0] for r in got] == [f"code_{i:04d}" for i in range(10)]
    assert [r[2] for r in got] == [got[i % 4][2] for i in range(10)]
    assert {r[2] for r in got} == {"p0", "p1", "p2", "p3"}
    assert len(rows(prompts.code_prompts(items, n=3))) == 3


def test_summary_prompts(spark):
    texts = ["a" * 199, " " + "b" * 200 + " ", "c" * 2500]
    docs = spark.createDataFrame([(i, t, f"h{i}") for i, t in enumerate(texts)], "doc_id int, article string, highlights string")
    got = {r.reference_summary: r.prompt for r in prompts.summary_prompts(docs).collect()}
    assert got == {"h1": S.SUMMARY_INSTRUCTION + "b" * 200, "h2": S.SUMMARY_INSTRUCTION + "c" * 2000}


def test_cell_prompts_and_files(spark, turns, tmp_path):
    chat = prompts.chat_prompts(prompts.first_turn(turns), n=6)
    source.write_prompts(prompts.all_prompts(chat, chat.limit(0)), f"{tmp_path}/p")
    back = source.read_prompts(spark, f"{tmp_path}/p")
    assert rows(back, "id") == rows(chat, "id")
    assert Counter(r.concurrency for r in prompts.cell_prompts(back).collect()) == {1: 1, 4: 4, 8: 6, 16: 6, 32: 6}
    assert rows(prompts.prompt_counts(back)) == [("chat", 6)]


def test_nested_dialogues(spark, tmp_path):
    lines = [
        '{"id": "1", "conversations": [{"from": "gpt", "value": "g"}, {"from": "human", "value": "h"}, {"from": "human", "value": "h2"}]}',
        '{"id": "2", "conversations": []}',
        '{"id": "3", "conversations": [{"from": "gpt", "value": "g"}]}',
        '{"id": "4"}',
    ]
    (tmp_path / "d.json").write_text("\n".join(lines))
    got = rows(prompts.first_turn_nested(source.read_dialogues(spark, str(tmp_path))))
    assert got == [("1", "h")]


def f1(common, a, b):
    return 2 * common / (a + b) if common else 0.0


def brute(ref, hyp, stemming=False):
    a, b = ([w for w in re.split(r"[^a-z0-9]+", t.lower()) if w] for t in (ref, hyp))
    if stemming:
        a, b = ([stem(w) if len(w) > 3 else w for w in words] for words in (a, b))
    scores = []
    for n in (1, 2):
        x, y = (Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for w in (a, b))
        scores.append(f1(sum((x & y).values()), sum(x.values()), sum(y.values())))
    return scores + [f1(lcs_length(a, b), len(a), len(b))]


PAIRS = [
    ("the cat sat on the mat", "the cat is on the mat"),
    ("same text here", "same text here"),
    ("alpha beta", "gamma delta"),
    ("one", "one two three"),
    ("a a a b", "a b a a a"),
    ("...", "word"),
    ("Été 42 The END", "end the 42"),
    ("the running dogs ate happily", "a dog runs and eats happy ties"),
]


@pytest.mark.parametrize("stemming", [False, True])
def test_rouge_equals_brute_force(spark, stemming):
    data = [(str(i), "s", r, h) for i, (r, h) in enumerate(PAIRS)]
    pairs = spark.createDataFrame(data, "pair_id string, system string, ref string, hyp string")
    scored = quality.all_rouge(pairs, ["system"], stemming)
    got = rows(scored.select("pair_id", "rouge1", "rouge2", "rougeL"), "pair_id")
    for (_, *scores), (ref, hyp) in zip(got, PAIRS, strict=True):
        assert scores == pytest.approx(brute(ref, hyp, stemming))
    alone = {r.pair_id: r.rougeL for r in quality.rouge_l(pairs, stemming).collect()}
    assert alone == {r[0]: r[3] for r in got}


def test_stemming_unites_forms(spark):
    pairs = spark.createDataFrame([("1", "running dogs", "run dog")], "pair_id string, ref string, hyp string")
    assert quality.rouge_l(pairs, stem=True).first().rougeL == 1.0
    assert quality.rouge_l(pairs).first().rougeL == 0.0


def test_references_and_scorable(spark):
    outputs = spark.createDataFrame([("p1", "baseline", "h"), ("p2", "baseline", "h"), ("p3", "eagle3", "")], "prompt_id string, system string, hyp string")
    refs = spark.createDataFrame([("p1", "r"), ("p3", "r")], "id string, reference_summary string")
    joined = quality.with_reference(outputs, refs)
    assert [r.prompt_id for r in quality.scorable(joined).collect()] == ["p1"]
    assert joined.filter("prompt_id = 'p2'").first().ref == ""


def test_verdict_limits(spark):
    scored = spark.createDataFrame([("a", 0.7), ("b", 0.5), ("c", 0.49), ("d", 0.69)], "task string, rougeL double")
    assert [r[3] for r in rows(quality.consistency(scored), "task")] == ["PASS", "WARN", "FAIL", "WARN"]


@pytest.fixture(scope="module")
def outputs(spark):
    data = [
        ("p1_c1_t99", "p1", "baseline", "```python\nx = 1\n```"), ("p1_c1_t99", "p1", "eagle3", "```python\nx = (\n```"),
        ("p2_c1_t99", "p2", "baseline", "y = 1"), ("p2_c1_t99", "p2", "eagle3", "y = 1"),
        ("p3_c1_t99", "p3", "baseline", "only here"),
    ]
    df = spark.createDataFrame(data, "request_id string, prompt_id string, system string, output_text string")
    return df.select("*", F.lit("L4").alias("gpu_type"), F.lit("code").alias("task"), F.lit(1).alias("concurrency"), F.lit(99).alias("trial"))


def test_pairs_syntax_and_parity(spark, outputs):
    pairs = quality.paired_outputs(outputs)
    assert pairs.count() == 2
    checked = quality.syntax_check(pairs)
    assert [(r.baseline_ok, r.spec_ok, r.status) for r in checked.orderBy("prompt_id").collect()] == [(True, False, "DIFF"), (True, True, "OK")]
    assert rows(quality.syntax_counts(checked)) == [("code", 2, 2, 1, "WARN", 1)]
    assert rows(quality.parity(pairs)) == [("code", 2, 1, 0.5, 0.5 * abs(len("```python\nx = 1\n```") - len("```python\nx = (\n```")))]
    asked = spark.createDataFrame([("p1", "q" * 300)], "id string, prompt string")
    shown = rows(quality.side_by_side(pairs, asked, 1))
    assert shown == [("p1", "q" * 120, "```python\nx = 1\n```", "```python\nx = (\n```")]


def _plain_rouge(ref, hyp):
    a, b = (re.findall("[a-z0-9]+", t.lower()) for t in (ref, hyp))

    def f(m, h, r):
        return 2 * m * m / (h * r) / (m / h + m / r) if m else 0.0

    scores = []
    for n in (1, 2):
        x, y = (Counter(zip(*(w[i:] for i in range(n)))) for w in (a, b))
        scores.append(f((x & y).total(), y.total(), x.total()))
    row = [0] * (len(b) + 1)
    for word in a:
        last = 0
        for j, other in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if word == other else max(row[j], row[j + 1])
    return [*scores, f(row[-1], len(b), len(a))]


def test_rouge_of_whole_documents(spark, tmp_path):
    rng = random.Random(4)
    texts = [" ".join(rng.choices([f"w{k}" for k in range(60)], k=n)) for n in (1, 5, 40, 90, 1_200, 30, 1_500, 70, 80, 0)]
    texts += ["one", "two words", " ".join(rng.choices("abc", k=300)), "x" * 200 + " y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {"baseline": [], "eagle3": []}
    for k, text in enumerate(texts):
        cut = len(text) // 3
        ref = f"{text[cut:]} {text[:cut]}" if k % 10 != 7 else ""
        for system, hyp in (("baseline", text), ("eagle3", text[100:] if k % 13 else "")):
            if ref and hyp:
                assert not hyp.startswith(ref)
                want[system].append(_plain_rouge(ref, hyp))
    got = QUERIES["rouge_documents"](spark, str(tmp_path)).collect()
    assert {r["system"]: r["n"] for r in got} == {s: len(v) for s, v in want.items()}
    bars = {(r["system"], r["metric"]): r["score"] for r in QUERIES["rouge_document_bars"](spark, str(tmp_path)).collect()}
    for r in got:
        for k, metric in enumerate(("rouge1", "rouge2", "rougeL")):
            mean = sum(x[k] for x in want[r["system"]]) / len(want[r["system"]])
            assert abs(r[metric] - mean) <= 0.5001e-4
            assert bars[r["system"], metric] == r[metric]
    refs = {(r["pair_id"], r["ref"]) for r in adapters.whole_summaries(spark, str(tmp_path)).collect() if r["ref"]}
    stemmed = {r["pair_id"] for r in QUERIES["rouge_stemmed"](spark, str(tmp_path)).collect()}
    assert stemmed <= {p for p, _ in refs} and any(len(ref) > 3_000 for _, ref in refs)
    one = [r for r in QUERIES["rouge_stemmed"](spark, str(tmp_path)).collect() if r["pair_id"] == "summarization_4/baseline"]
    assert one[0]["rouge1"] > 0.99  # the whole reference, not its first 300 characters
