import random
from collections import Counter
from unittest import mock

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from armlens.functions import udfs
from armlens.functions.stem import stem
from armlens.functions.text import WHITESPACE, common_grams, fenced_code, grams, prompt_id, strip, tokens
from armlens.functions.udfs import lcs, lcs_length, overlaps, parses, stemmed, valid_python
from armlens.operators.quality import lcs_native


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_strip_removes_what_python_strips(spark):
    texts = ["  a b ", "\n\t\x0bx\x1c", " y ", "　", "", "z" + WHITESPACE]
    assert column(spark, texts, strip("t")) == [t.strip() for t in texts]


def test_tokens_and_grams(spark):
    texts = ["The cat, the CAT!", "", "--", "a1 b2\nc3", "é x"]
    assert column(spark, texts, tokens("t")) == [
        ["the", "cat", "the", "cat"],
        [],
        [],
        ["a1", "b2", "c3"],
        ["x"],
    ]
    assert column(spark, texts, grams(tokens("t"), 2)) == [
        ["the cat", "cat the", "the cat"],
        [],
        [],
        ["a1 b2", "b2 c3"],
        [],
    ]


def reference_fence(text):
    for mark in ("```python", "```"):
        head, found, tail = text.partition(mark)
        if found:
            return tail.partition("```")[0]
    return text


def test_fenced_code(spark):
    texts = [
        "x = 1",
        "a\n```python\ny = 2\n```\nb",
        "```\nz\n```",
        "```js\nq\n``` then ```python\nr\n``` end",
        "```python\nopen",
        "```python\na\n```python\nb\n```",
        "```",
    ]
    assert column(spark, texts, fenced_code("t")) == [reference_fence(t) for t in texts]


def test_prompt_id_with_marks_inside(spark):
    ids = ["chat_0001_c4_t2", "doc_chat_c9x_c16_t99", "odd"]
    assert column(spark, ids, prompt_id("t")) == ["chat_0001", "doc_chat_c9x", ""]


def test_stem_known_words():
    known = {
        "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "feed": "feed",
        "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sized": "size",
        "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky",
        "enjoy": "enjoy", "relational": "relat", "conditional": "condit", "digitizer": "digit",
        "vietnamization": "vietnam", "operator": "oper", "sensibility": "sensibl",
        "triplicate": "triplic", "hopeful": "hope", "goodness": "good", "adjustment": "adjust",
        "adoption": "adopt", "effective": "effect", "probate": "probat", "rate": "rate",
        "cease": "ceas", "controlling": "control", "roll": "roll", "dying": "die", "died": "die",
        "spied": "spi", "generalizations": "gener", "oscillators": "oscil", "geology": "geolog",
    }
    assert {w: stem(w) for w in known} == known


def test_stemmed_column_keeps_short_words_and_nulls(spark):
    df = spark.createDataFrame(
        [(1, ["the", "ties", "running"]), (2, []), (3, ["running", "as"])], "i int, w array<string>"
    )
    got = [r[0] for r in df.orderBy("i").select(stemmed("w")).collect()]
    assert got == [["the", "tie", "run"], [], ["run", "as"]]


def brute_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@given(st.lists(st.sampled_from("abcd"), max_size=80), st.lists(st.sampled_from("abcd"), max_size=80))
def test_lcs_equals_brute_force(a, b):
    assert lcs_length(a, b) == brute_lcs(a, b)


@settings(max_examples=3, deadline=None)
@given(st.integers(0, 10**6))
def test_lcs_column_equals_native_form(spark, seed):
    rng = random.Random(seed)
    pairs = [
        tuple([rng.choice(["a", "b", "c", "é"]) for _ in range(rng.randrange(12))] for _ in range(2))
        for _ in range(20)
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = df.orderBy("i").select(lcs("a", "b"), lcs_native(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(brute_lcs(a, b),) * 2 for a, b in pairs]


@settings(deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=60), st.lists(st.sampled_from("abcd"), max_size=60), st.integers(1, 9))
def test_lcs_in_strips_equals_brute_force(a, b, strip):
    with mock.patch.object(udfs, "STRIP", strip):
        assert lcs_length(a, b) == brute_lcs(a, b)


def test_overlaps_equal_array_functions(spark):
    """Common grams and stems on any number of rows coded at a time; missing and empty sides share nothing."""
    rng = random.Random(7)
    words = ["run", "running", "runs", "a", "tie", "ties", "é"]
    pairs = [tuple(rng.choices(words, k=rng.randrange(30)) for _ in range(2)) for _ in range(150)] + [([], ["a"]), (["a"], []), ([], [])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate([*pairs, (None, ["a"]), (["a"], None)])], "i int, a array<string>, b array<string>").repartition(1)
    for stem, one, two in ((False, F.col("a"), F.col("b")), (True, stemmed("a"), stemmed("b"))):
        shared = overlaps(F.col("a"), F.col("b"), (1, 2, 3), True, stem)
        plain = [F.coalesce(common_grams(grams(one, n), grams(two, n)), F.lit(0)) for n in (1, 2, 3)]
        rows = df.select("i", shared.alias("s"), *[c.alias(f"p{n}") for n, c in enumerate(plain, 1)], lcs(one, two).alias("l")).orderBy("i").collect()
        assert len(rows) == len(pairs) + 2
        assert all((r.s.c1, r.s.c2, r.s.c3, r.s.lcs) == (r.p1, r.p2, r.p3, r.l) for r in rows)


def test_overlaps_of_long_texts(spark):
    """Texts of 60,000 words are several strips."""
    a = [f"w{i % 9_000}" for i in range(60_000)]
    df = spark.createDataFrame([(a, a[20_000:] + a[:20_000])], "a array<string>, b array<string>")
    got = df.select(overlaps(F.col("a"), F.col("b"), (1, 2), True).alias("s")).first().s
    grams_a, grams_b = (Counter(zip(w, w[1:])) for w in (a, a[20_000:] + a[:20_000]))
    assert (got.c1, got.c2) == (60_000, (grams_a & grams_b).total()) and got.lcs >= 40_000


def test_syntax(spark):
    codes = ["x = 1", "def f(:", "a\x00b", "", "(" * 500 + ")" * 500, None]
    assert column(spark, codes, valid_python("t"))[:4] == [True, False, False, True]
    assert column(spark, codes, valid_python("t"))[5] is None
    assert parses("def f():\n    return 1") and not parses("return return")
