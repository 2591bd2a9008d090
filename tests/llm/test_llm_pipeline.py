"""The pipeline stage by stage against plain versions of what each stage decides."""

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from armlens.llm import decontaminate, mixing, near, tokens, toxicity

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [decontaminate.normal_words(r["text"].encode()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + 10]) for w in items for k in range(max(1, len(w) - 9)) if w}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near-dedup", "decontamination", "mixing", "token ids"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, out = docs, stage(spark, docs, DATA).cache()
        seen[name] = {r["doc_id"] for r in out.select("doc_id").collect()}
        all_ids = {r["doc_id"] for r in before.select("doc_id").collect()}
        if name == "toxicity":
            scored = toxicity.score(before, spark.read.parquet(f"{DATA}/labels.parquet")).collect()
            assert seen[name] == {r["doc_id"] for r in scored if not r["predicted"]}
        elif name == "near-dedup":
            found = {r["doc_id"]: near.runs(r["text"].encode()) for r in before.collect()}
            ids = sorted(found)
            root = {i: i for i in ids}
            for j in ids:
                for i in ids:
                    if i < j and len(found[i]) and len(found[j]) and root[j] != root[i] and near.similar(found[i], found[j], near.labelled(found[i]), near.labelled(found[j])):
                        low, high = sorted((root[i], root[j]))
                        root = {k: low if v == high else v for k, v in root.items()}
            assert seen[name] == set(root.values())
        elif name == "decontamination":
            for r in before.collect():
                w = decontaminate.normal_words(r["text"].encode())
                grams = {tuple(w[k : k + n]) for n in {len(x) for x in windows} for k in range(len(w) - n + 1)}
                assert (r["doc_id"] in seen[name]) == (not grams & windows)
        elif name == "mixing":
            want = {r["doc_id"]: r["taken"] for r in mixing.mix(before).collect() if r["taken"]}
            got = out.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("n"))
            assert {r["doc_id"]: r["n"] for r in got.collect()} == want
        else:
            enc = tokens.encoder(tokens.vocabulary_path())
            texts = [r["text"] for r in before.collect()]
            assert sum(r["n_tokens"] for r in out.collect()) == sum(len(np.frombuffer(x, enc.width)) + 1 for x in enc.encode(texts))
        if name != "token ids":
            assert out.columns == docs.columns
        assert seen[name] <= all_ids
        docs = out


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, DATA)
    assert rows.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and rows.count() > 0
