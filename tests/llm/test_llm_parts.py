"""The operators' parts against plain versions of themselves."""

import heapq
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from armlens.llm import chat, decontaminate, exact, mixing, near, pii, quality, repeats, tokens, toxicity
from armlens.llm.frames import WORDS, gram_hashes, word_hashes

DATA = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


# Hashes


@given(st.lists(st.sampled_from([b"a", b"b", b"ab", b"ba", "é".encode(), b"abc" * 9]), max_size=40), st.integers(1, 6))
def test_equal_words_and_grams_hash_alike(words, k):
    hashes = word_hashes(b"  ".join(words) + b" ")
    assert len(hashes) == len(words)
    assert len(set(hashes.tolist())) == len(set(words))
    grams = [tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1 if words else 0))]
    found = gram_hashes(hashes, k).tolist()
    assert len(found) == len(grams) and len(set(found)) == len(set(grams))


def test_words_across_steps(monkeypatch):
    from armlens.llm import frames

    rng = random.Random(1)
    words = [bytes(rng.choices(b"abcde", k=rng.randint(1, 40))) for _ in range(500)]
    whole = word_hashes(b" ".join(words))
    monkeypatch.setattr(frames, "STEP", 64)
    frames._powers.clear()
    assert (word_hashes(b" ".join(words)) == whole).all()
    frames._powers.clear()


# 1


def test_items_by_many_automata(spark):
    docs, items = documents(spark), spark.read.parquet(f"{DATA}/benchmark.parquet")
    one = decontaminate.find_items(docs, items).orderBy("doc_id").collect()
    assert one == decontaminate.find_items(docs, items, per_automaton=50).orderBy("doc_id").collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    hit = [r for r in one if r["n_hit"]]
    assert hit
    for r in hit:
        words = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
        assert sum(len(words.findall(texts[r["doc_id"]][s["start"] : s["stop"]])) for s in r["spans"]) == r["n_hit"]


# 2


def test_many_spans_keep_their_places(spark):
    text = "é " + " x ".join(f"u{k}@host{k}.org" for k in range(1200))
    spans = pii.find_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["spans"]
    assert [text[s["start"] : s["stop"]] for s in spans] == re.findall(r"\S+@\S+", text)


def test_context_moves_the_score(spark):
    rows = [(1, "see 078-05-1120"), (2, "his ssn: 078-05-1120"), (3, "IBAN DE89370400440532013000"), (4, "DE88370400440532013000")]
    found = pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [[s["kind"] for s in r["spans"]] for r in found] == [[], ["ssn"], ["iban"], []]


def test_ibans_before_other_words_and_ibans(spark):
    gb, de, no = "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "NO9386011117947"
    cases = [
        (f"IBAN {gb} Please pay", [gb]), (f"IBAN {de} BIC COBADEFF", [de]), (f"{de} 4711", [de]), (f"🙂 {de} {gb} {no} X1", [de, gb, no]),
        (f"AT12 {de}", [de]), (f"{gb}", [gb]), ("DE89 3704 0044 0532 0130 01 PAY", []), ("XY15 1234 5678 9012 3456", None),
    ]
    rows = [(k, text) for k, (text, _) in enumerate(cases)]
    found = pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in found:
        text, want = cases[r["doc_id"]]
        got = [text[s["start"] : s["stop"]] for s in r["spans"] if s["kind"] == "iban"]
        if want is None:  # a country without a listed length: mod 97 over the longest match decides
            value = text.replace(" ", "")
            want = [text] if int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1 else []
        assert got == want, text


def test_whole_words_and_numbers_that_exist(spark):
    texts = ["classnote 123-45-6789", "ssn 000-12-3456", "ssn 666-12-3456", "ssn 912-12-3456", "ssn 123-00-3456", "ssn 123-12-0000", "(SSN) 123-45-6789"]
    found = pii.find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [len(r["spans"]) for r in found] == [0, 0, 0, 0, 0, 0, 1]
    (hotel, tel) = pii.find_spans(spark.createDataFrame([(1, "hotel +4930123456789"), (2, "tel. +4930123456789")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert (hotel["spans"][0]["score"], tel["spans"][0]["score"]) == pii.SCORES["phone"]


def test_context_on_both_sides_and_across_matches(spark):
    far = "é🙂 filler " * 300
    texts = [
        "SSN: 123-45-6789, 787-65-4321, 111-22-3333", "123-45-6789 is my SSN", f"123-45-6789 {'x' * 40} ssn", f"ssn {'x' * 40} 123-45-6789",
        f"{far}123-45-6789 {far}", f"{far}ssn 123-45-6789, 787-65-4321 {far}", f"{far}123-45-6789 is an SSN", "call a@b.co, +4930123456789",
    ]
    found = pii.find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    for text, r in zip(texts, found):
        got = {(s["kind"], s["start"], s["stop"]): s["score"] for s in r["spans"]}
        want = {}
        for kind, pattern in (("ssn", r"\d{3}-\d{2}-\d{4}"), ("email", r"[a-z]+@[a-z.]+"), ("phone", r"\+\d+")):
            for m in re.finditer(pattern, text):
                near = text[max(m.start() - 40, 0) : m.start()] + "\n" + text[m.end() : m.end() + 40]
                score = pii.SCORES[kind][bool(re.search(pii.CONTEXT[kind], near.lower()))]
                if score >= pii.THRESHOLD:
                    want[kind, m.start(), m.end()] = score
        assert got == want, text[:60]
    assert [len(r["spans"]) for r in found] == [3, 1, 0, 0, 0, 2, 1, 2]


# 3


@given(st.binary(max_size=300), st.integers(0, 300))
def test_fingerprints_combine(data, cut):
    left, right = data[:cut], data[cut:]
    joined = exact.combine(exact.fingerprint(left), exact.fingerprint(right), len(right))
    assert joined == exact.fingerprint(data)


@pytest.mark.parametrize("primes, huge", [((3, 5), 1 << 25), (exact.PRIMES, 40), ((2, 3), 10)])
def test_colliding_and_huge_texts(spark, monkeypatch, primes, huge):
    monkeypatch.setattr(exact, "CHUNK", 16)
    exact._powers.clear()
    rng = random.Random(3)
    texts = ["".join(rng.choices("aAbBé", k=rng.choice((0, 1, 2, 40, 41)))) for _ in range(60)]
    rows = list(enumerate(texts + texts[:20]))
    got = exact.dedup(spark.createDataFrame(rows, "doc_id long, text string"), primes, huge).collect()
    exact._powers.clear()
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    for r in got:
        same = [i for i, t in rows if low(t) == low(rows[r["doc_id"]][1])]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(same), len(same), r["doc_id"] == max(same))


# 4


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "x<[>\\"]), st.text("</s>[INST]\\blog<SY ROLE", max_size=25)), min_size=1, max_size=60))
def test_conversations_come_back(spark, turns):
    rows = [(1 + k // 7, k, role, text) for k, (role, text) in enumerate(turns)]
    out = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for r in out:
        source = [(role, text) for c, _, role, text in rows if c == r["conv_id"]]
        assert [tuple(t) for t in r["parsed"]] == source
        spans = [r["formatted"][s["start"] : s["stop"]] for s in r["loss_spans"]]
        plain = [s.replace("\\g", ">").replace("\\o", "[").replace("\\l", "<").replace("\\b", "\\") for s in spans]
        assert len(plain) == sum(role == "assistant" for role, _ in source)
        assert all(p == t or s == t for p, s, t in zip(plain, spans, [t for role, t in source if role == "assistant"]))


def test_a_shifted_mask_changes_the_loss(spark):
    rows = [(1, 0, "user", "ask"), (1, 1, "assistant", "say </s> it"), (1, 2, "assistant", "[INST] more")]
    out = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    shift = lambda s: s.withField("start", s["start"] - 1).withField("stop", s["stop"] - 1)
    right, wrong = (chat.digest(x).first() for x in (out, out.withColumn("loss_spans", F.transform("loss_spans", shift))))
    import hashlib

    assert right["loss_sha256"] == hashlib.sha256(b"say </s> it[INST] more").hexdigest() and right["loss_chars"] == 22
    assert wrong["loss_sha256"] != right["loss_sha256"] and wrong["turns_sha256"] == right["turns_sha256"]


# 5


PIECES = [*"abcXYZ \n\t's,.!-_0123éßÿ×÷ªµāЖ漢\x85\xa0 　​\x1c\x0b\r🙂", "'s", "'ll", " the", "  ", "<|endoftext|>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=120).map("".join))
def test_pieces_encode_as_the_whole(text):
    from tokenizers import Tokenizer

    enc = tokens.encoder(tokens.vocabulary_path())
    plain = Tokenizer.from_file(tokens.vocabulary_path())
    plain.encode_special_tokens = True
    want = np.array(plain.encode(text, add_special_tokens=False).ids, enc.width).tobytes()
    assert enc.encode([text, text]) == [want, want]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*PIECES, "<|endoftext|>", " <|endoftext|> ", "<|endoftext", "|>"]), max_size=60).map("".join))
def test_added_tokens_as_the_library_has_them(text):
    from tokenizers import Tokenizer

    enc = tokens.encoder(tokens.vocabulary_path())
    want = Tokenizer.from_file(tokens.vocabulary_path()).encode(text, add_special_tokens=False).ids
    assert enc.ids(["x", text, ""])[1] == np.array(want, enc.width).tobytes()


def test_added_tokens_in_the_files(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "after\n<|endoftext|>\n\n x", "none"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokens.write_tokens(docs, str(tmp_path / "t"), tokens.vocabulary_path())
    got = tokens.read_tokens(spark, str(tmp_path / "t")).orderBy("doc_id").collect()
    plain = Tokenizer.from_file(tokens.vocabulary_path())
    ids = [[*plain.encode(t, add_special_tokens=False).ids, tokens.END_ID] for t in texts]
    assert [(r["n_tokens"], r["ids_crc32"]) for r in got] == [(len(i), zlib.crc32(np.array(i, "<u4"))) for i in ids]
    assert [r["start"] for r in got] == [sum(map(len, ids[:k])) for k in range(len(ids))]


def test_files_against_one_pass(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()] + [(None, "no id"), (3, None), (3, "again"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = tokens.write_tokens(docs, str(tmp_path / "t"), tokens.vocabulary_path())
    assert len(manifest["parts"]) >= 1
    got = tokens.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    plain = Tokenizer.from_file(tokens.vocabulary_path())
    ids = {t: [*plain.encode(t or "", add_special_tokens=False).ids, 2] for _, t in rows}
    want = sorted((i is not None, i or 0, zlib.crc32(np.array(ids[t], "<u4"))) for i, t in rows)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["ids_crc32"]) for r in got) == want
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert order == sorted(order)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]


# 6


def plain_alignment(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j + 1], new[j], row[j] + (x == y)))
        row = new
    return row[-1]


@given(st.lists(st.integers(0, 6), max_size=30), st.lists(st.integers(0, 6), max_size=30))
def test_alignment(a, b):
    x, y = np.array(a, np.uint64), np.array(b, np.uint64)
    best = plain_alignment(a, b)
    assert near.aligned(x, y, max(len(a), len(b), 1)) == best
    if a and b:
        assert near.similar(x, y, near.labelled(x), near.labelled(y)) == (9 * best >= 4 * (len(a) + len(b)))


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        at = rng.randrange(len(words))
        words[at : at + 1] = rng.choice(([], [f"new{rng.randrange(10**6)}"], [words[at], "more"]))
    return " ".join(words)


def test_classes_against_all_pairs(spark):
    rng = random.Random(11)
    vocab = [f"v{k}" for k in range(900)]
    rows = []
    for _ in range(12):
        base = rng.choices(vocab, k=rng.randint(30, 260))
        rows += [" ".join(base)] + [edited(rng, base, rng.randint(0, 6)) for _ in range(rng.randint(0, 14))]
    hub = rng.choices(vocab, k=200)
    rows += [" ".join(hub)] + [edited(rng, hub, 3) for _ in range(60)]
    rows += ["", "a", "A!", "a b", None, "x y z w"] + ["shared words of a long passage " * 4 + " ".join(rng.choices(vocab, k=20)) for _ in range(20)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near.near_classes(docs).collect()}
    found = [near.runs((t or "").encode()) for t in rows]
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            n, m = len(found[i]), len(found[j])
            if n and m and 5 * min(n, m) >= 4 * max(n, m) and 9 * near.aligned(found[i], found[j], max(n, m)) >= 4 * (n + m):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    assert got == {k: top(k) for k in range(len(rows))}


def test_pairs_of_short_texts_all_join(spark):
    """Nine words against their first eight share four of five runs."""
    rng = random.Random(21)
    rows = []
    for _ in range(1500):
        words = [f"s{rng.randrange(10**9)}" for _ in range(9)]
        rows += [" ".join(words), " ".join(words[:8])]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near.near_classes(docs).collect()}
    assert got == {k: k - k % 2 for k in range(3000)}


@given(st.integers(0, 2**32), st.integers(1, 9000), st.integers(0, 400), st.integers(0, 400))
@settings(max_examples=60, deadline=None)
def test_bitmaps_differ_in_no_more_places_than_runs(seed, common, left, right):
    drawn = np.random.default_rng(seed).integers(0, 2**64, common + left + right, np.uint64)
    a, b = drawn[: common + left], np.concatenate([drawn[:common], drawn[common + left :]])
    one, two = (np.frombuffer(near.bitmap(x), np.uint8) for x in (a, b))
    while len(one) != len(two):
        one, two = (near.folded(x) if len(x) > min(len(one), len(two)) else x for x in (one, two))
    assert np.bitwise_count(one ^ two).sum() <= left + right


def test_components_of_a_long_chain(spark):
    chain = [(k, k + 1) for k in range(1, 60)] + [(100, 103), (101, 103), (102, 101)]
    got = {r["node"]: r["root"] for r in near.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(2, 61)} | {101: 100, 102: 100, 103: 100}


# 7


@pytest.mark.parametrize("seed", range(4))
def test_highest_quotients(spark, seed):
    rng = random.Random(seed)
    claims = [(f"k{k:02}", float(rng.choice((0, 1, 7, 300, 4000)) * rng.random()), rng.choice((0, 3, 10_000))) for k in range(25)]
    seats = min(sum(m for _, c, m in claims if c > 0), rng.choice((5, 60, 700)))
    heap = [(-c / (2 * k + 1), key, k) for key, c, most in claims if c > 0 for k in range(min(most, seats))]
    want: dict[str, int] = {}
    for _, key, _ in heapq.nsmallest(seats, heap):
        want[key] = want.get(key, 0) + 1
    frame = spark.createDataFrame(claims, "key string, claim double, most long")
    got = {r["key"]: r["quota"] for r in mixing.apportion(frame, ["key"], [], F.lit(seats).cast("long")).collect()}
    if all(want.get(k, 0) < m for k, _, m in claims):  # no limit binds
        assert {k: v for k, v in got.items() if v} == want
    assert all(got[k] <= m for k, _, m in claims)


def test_small_shards_take_whole_documents(spark):
    rows = mixing.mix(documents(spark), block_words=8, shard_words=500).collect()
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], []).append(r)
    for some in by.values():
        assert abs(sum(r["taken"] for r in some) - some[0]["target"]) <= 8 * (2 + sum(r["size"] for r in some) // 500)


def test_mixed_documents_follow_the_counts(spark):
    docs = documents(spark).withColumn("_size", F.lit("clash")).withColumn("taken", F.lit(-1))
    want = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect() if r["taken"]}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = out.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("n"), F.min("_size").alias("c"))
    assert {r["doc_id"]: r["n"] for r in got.collect()} == want


# 8 and 10


def rates(scored, labels, column):
    rows = scored.filter("held_out").join(labels, "doc_id").groupBy(column, "predicted").count().collect()
    counts = {(r[column], r["predicted"]): r["count"] for r in rows}
    right = [counts.get((c, c), 0) / max(1, counts.get((c, 0), 0) + counts.get((c, 1), 0)) for c in (0, 1)]
    return right


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    clean, toxic = rates(toxicity.score(docs, labels), labels, "toxic")
    assert clean > 0.99 and toxic > 0.8
    low, good = rates(quality.score(docs, labels), labels, "quality")
    assert low > 0.97 and good > 0.98


def test_swaps_calm_the_score(spark):
    rows = [(k, f"the women spoke of things{k % 7} idiot" if k % 2 else f"a day with things{k % 7} and men") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")

    def change(fairness):
        model = toxicity.train(docs, labels, fairness)
        return abs(np.log(model.score(b"women came") / model.score(b"men came")))

    assert change(20.0) < 0.5 * change(0.0)


def test_every_name_is_swapped_for_another():
    assert [w for w, other in toxicity.SWAPS.items() if w == other] == []


def test_neutral_mentions_of_a_name_stay_calm(spark):
    rows = [(k, f"die frauen sagten dinge{k % 7} idiot" if k % 2 else f"ein tag mit dinge{k % 7} und wetter") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")

    def change(fairness):
        model = toxicity.train(docs, labels, fairness)
        return abs(np.log(model.score(b"frauen kamen") / model.score("männer kamen".encode())))

    assert change(20.0) < 0.5 * change(0.0)


def test_one_class_gives_no_model(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(50)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.score(docs, labels).select("score").distinct().collect()} == {0.0}
    assert {r["score"] for r in quality.score(docs, labels).select("score").distinct().collect()} == {0.5}


@given(st.binary(max_size=200))
def test_statistics_are_finite(data):
    assert len(quality.statistics(data)) == len(quality.STATISTICS) and np.isfinite(quality.statistics(data)).all()


# 9


def plain_repeats(rows, window):
    first, out = {}, {}
    split = {i: repeats.split((t or "").encode()) for i, t in rows}
    for i in sorted(split):
        for k in range(len(split[i]) - window + 1):
            first.setdefault(tuple(split[i][k : k + window]), i)
    for i, words in split.items():
        gone = {j for k in range(len(words) - window + 1) if first[tuple(words[k : k + window])] < i for j in range(k, k + window)}
        out[i] = (len(words), len(gone), b" ".join(w for j, w in enumerate(words) if j not in gone))
    return out


@pytest.mark.parametrize("window, docs_per_part, words_per_shard", [(12, 500, 40_000), (12, 2, 30), (3, 3, 100), (50, 1, 1)])
def test_repeats_against_all_windows(spark, window, docs_per_part, words_per_shard):
    import hashlib

    rng = random.Random(window)
    vocab = [f"v{k}" for k in range(40)]
    passages = [rng.choices(vocab, k=rng.randint(window, 3 * window)) for _ in range(4)]
    rows = [(0, None), (1, ""), (2, "a " * 90), (3, "a " * 100)]
    for k in range(4, 60):
        words = rng.choices(vocab, k=rng.randint(0, 60))
        for p in rng.choices(passages, k=rng.randint(0, 2)):
            a = rng.randrange(len(p))
            words += p[: rng.choice((len(p), a))] + rng.choices(vocab, k=rng.randint(0, 9))
        rows.append((k, "  ".join(words) if k % 9 else "\n".join(words)))
    rows += [(70 + k, rows[10 + k][1].replace("  ", " ")) for k in range(5)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = repeats.dedup(docs, window, docs_per_part, words_per_shard).collect()
    want = plain_repeats(rows, window)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == {
        i: (n, g, hashlib.sha256(t).hexdigest()) for i, (n, g, t) in want.items()
    }
    assert all(sum(x["stop"] - x["start"] for x in r["removed"]) == r["n_removed"] for r in got)


def test_normal_words():
    assert decontaminate.normal_words("Ab-c, É9\x7f漢".encode()) == [b"ab", b"c", "É9".encode(), "漢".encode()]
    assert len(WORDS) == 256
