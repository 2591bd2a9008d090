"""Queries over prompts and outputs (adapters: conversations, benchmark, documents)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from armlens import schema as S
from armlens.catalogue import adapters as A
from armlens.catalogue.registry import query, r, tidy
from armlens.functions.text import WHITESPACE, fenced_code, tokens
from armlens.operators import coverage, prompts, quality, report, series
from armlens.session import shared_dir
from armlens.sources import prompts as source

SAMPLE = 50
CODE_SAMPLE = 500

_WS = "concat(" + ", ".join(f"chr({ord(c)})" for c in WHITESPACE) + ")"


def strip_sql(c: str) -> str:
    return f"trim({c}, {_WS})"


def _sampled_sql(source_sql: str, ident: str, n: int) -> str:
    return f"""SELECT *, CAST(row_number() OVER (ORDER BY key, {ident}) - 1 AS INT) AS idx FROM
      (SELECT *, md5('42|' || CAST({ident} AS VARCHAR)) AS key FROM ({source_sql}) ORDER BY key, {ident} LIMIT {n})"""


_NUL = "CAST(NULL AS VARCHAR)"
_CHAT = f"""SELECT printf('chat_%04d', idx) AS id, 'chat' AS task, substr({strip_sql('text')}, 1, 1500) AS prompt,
  {_NUL} AS canonical_solution, {_NUL} AS entry_point, {_NUL} AS reference_summary FROM ({_sampled_sql(
    f"SELECT * FROM (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id) WHERE length({strip_sql('text')}) >= 20",
    'conv_id', SAMPLE)})"""
_CODE = f"""SELECT printf('code_%04d', place) AS id, 'code' AS task, {strip_sql('prompt')} AS prompt,
  canonical_solution, entry_point, {_NUL} AS reference_summary FROM (SELECT *, unnest(generate_series(idx,
  {CODE_SAMPLE - 1}, have)) AS place FROM (SELECT *, count(*) OVER () AS have FROM ({_sampled_sql(
    A.as_sql('benchmark', A.CODE_ITEMS), 'item_id', CODE_SAMPLE)})))"""
_SUMM = f"""SELECT printf('summarization_%04d', idx) AS id, 'summarization' AS task,
  'Summarize the following article in 3-4 sentences:' || chr(10) || chr(10) || substr({strip_sql('article')}, 1, 2000)
  AS prompt, {_NUL} AS canonical_solution, {_NUL} AS entry_point, highlights AS reference_summary FROM ({_sampled_sql(
    f"SELECT * FROM ({A.as_sql('documents', A.ARTICLES)}) WHERE length({strip_sql('article')}) >= 200", 'doc_id', SAMPLE)})"""
_ALL_PROMPTS = f"SELECT * FROM ({_CHAT}) UNION ALL SELECT * FROM ({_CODE}) UNION ALL SELECT * FROM ({_SUMM})"


def chat(spark, sf_dir):
    first = prompts.first_turn(A.table(spark, sf_dir, "conversations"))
    return prompts.chat_prompts(first, n=SAMPLE)


def code(spark, sf_dir):
    return prompts.code_prompts(A.code_items(spark, sf_dir), n=CODE_SAMPLE)


def summaries(spark, sf_dir):
    return prompts.summary_prompts(A.articles(spark, sf_dir), n=SAMPLE)


@query(_CHAT)
def chat_prompts(spark, sf_dir):
    """Seeded sample of chat prompts."""
    return chat(spark, sf_dir)


@query(_CODE)
def code_prompts(spark, sf_dir):
    """Seeded sample of code prompts, repeated to the wanted number."""
    return code(spark, sf_dir)


@query(_SUMM)
def summ_prompts(spark, sf_dir):
    """Seeded sample of articles with their reference summaries."""
    return summaries(spark, sf_dir)


@query(f"SELECT task, count(*) AS prompts FROM ({_ALL_PROMPTS}) GROUP BY task")
def prompt_counts(spark, sf_dir):
    """All three sets written, read back and counted."""
    path = shared_dir(spark, "prompts")
    sets = prompts.all_prompts(chat(spark, sf_dir), code(spark, sf_dir), summaries(spark, sf_dir))
    source.write_prompts(sets, path)
    return prompts.prompt_counts(source.read_prompts(spark, path))


@query(
    f"""SELECT task, c AS concurrency, id AS prompt_id FROM ({_ALL_PROMPTS}), (SELECT CAST(unnest([1, 4, 8, 16, 32])
    AS INT) AS c) WHERE CAST(string_split(id, '_')[-1] AS INT) < c"""
)
def cell_prompts(spark, sf_dir):
    """The prompts a cell of each concurrency sends."""
    sets = prompts.all_prompts(chat(spark, sf_dir), code(spark, sf_dir), summaries(spark, sf_dir))
    return prompts.cell_prompts(sets)


@query(
    f"""SELECT task FROM (VALUES ('chat'), ('code'), ('summarization')) t(task) WHERE task NOT IN
    (SELECT CASE WHEN lang = 'en' THEN 'summarization' ELSE 'chat' END FROM documents
     WHERE length({strip_sql('text')}) >= 200)"""
)
def missing_inputs(spark, sf_dir):
    """Tasks of a sweep without any prompt."""
    docs = A.table(spark, sf_dir, "documents").filter(prompts.long_enough("text", 200))
    task = F.when(F.col("lang") == "en", "summarization").otherwise("chat")
    return coverage.missing_inputs(docs.select(task.alias("task")))


@query(
    f"""SELECT 'chat' AS task, count(*) AS n, count(*) FILTER (length({strip_sql('text')}) >= 20) AS kept
    FROM conversations UNION ALL
    SELECT 'summarization', count(*), count(*) FILTER (length({strip_sql('text')}) >= 200) FROM documents"""
)
def prompt_filter(spark, sf_dir):
    """How many texts are long enough."""
    out = None
    for task, name, least in (
        ("chat", "conversations", S.MIN_CHAT_CHARS),
        ("summarization", "documents", S.MIN_ARTICLE_CHARS),
    ):
        counted = A.table(spark, sf_dir, name).agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(prompts.long_enough("text", least)).alias("kept"),
        ).select(F.lit(task).alias("task"), "n", "kept")
        out = counted if out is None else out.unionByName(counted)
    return out


@query(
    "SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents WHERE doc_id % 4 <> 0"
)
def nested_first_turn(spark, sf_dir):
    """First human turn from a dump with nested turns."""
    path = shared_dir(spark, "dialogues")
    docs = A.table(spark, sf_dir, "documents")

    def turn(speaker: str, value) -> Column:
        return F.struct(F.lit(speaker).alias("from"), value.alias("value"))

    opening, answer = turn("system", F.col("lang")), turn("gpt", F.col("source"))
    asked, again = turn("human", F.col("text")), turn("human", F.col("lang"))
    docs.select(
        F.col("doc_id").cast("string").alias("id"),
        F.when(F.col("doc_id") % 4 == 0, F.array(opening, answer))
        .otherwise(F.array(opening, asked, answer, again))
        .alias("conversations"),
    ).write.json(path)
    return prompts.first_turn_nested(source.read_dialogues(spark, path))


@query(
    f"""SELECT conv_id, idx FROM ({_sampled_sql(
        "SELECT DISTINCT conv_id FROM conversations WHERE role = 'user'", 'conv_id', 20)})"""
)
def sampled_prompts(spark, sf_dir):
    """The seeded sample itself, numbered."""
    first = prompts.first_turn(A.table(spark, sf_dir, "conversations"))
    return prompts.sample(first, "conv_id", 20).select("conv_id", "idx")


# --- quality -----------------------------------------------------------------------


def words_sql(c: str) -> str:
    clean = f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), ' ')"
    return f"CASE WHEN {clean} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split({clean}, ' ') END"


def _rouge_sql(pairs: str, n: int) -> str:
    gram = "words" if n == 1 else (
        "list_transform(generate_series(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1])"
    )
    return f"""(WITH p AS ({pairs}), side AS (SELECT pair_id, 'r' AS s, {words_sql('ref')} AS words FROM p
      UNION ALL SELECT pair_id, 'h', {words_sql('hyp')} FROM p),
    g AS (SELECT pair_id, s, unnest({gram}) AS gram FROM side),
    c AS (SELECT pair_id, gram, count(*) FILTER (s = 'r') AS r, count(*) FILTER (s = 'h') AS h FROM g GROUP BY ALL),
    t AS (SELECT pair_id, CAST(sum(least(r, h)) AS DOUBLE) AS m, CAST(sum(r) AS DOUBLE) AS r,
      CAST(sum(h) AS DOUBLE) AS h FROM c GROUP BY pair_id)
    SELECT pair_id, coalesce(2 * (m / nullif(h, 0)) * (m / nullif(r, 0)) /
      nullif(m / nullif(h, 0) + m / nullif(r, 0), 0), 0) AS f FROM p LEFT JOIN t USING (pair_id))"""


def _rouge_l_sql(pairs: str) -> str:
    """One row of the alignment table per step."""
    return f"""(WITH RECURSIVE p AS ({pairs}), t AS (SELECT pair_id, {words_sql('ref')} AS a, {words_sql('hyp')} AS b FROM p),
    step AS (SELECT pair_id, 0 AS i, list_transform(range(0, len(a) + 1), lambda k: 0) AS prev, a, b FROM t
      UNION ALL SELECT pair_id, i + 1, list_reduce(list_transform(range(0, len(a) + 1), lambda k: CASE WHEN k = 0 THEN [0]
        ELSE [CASE WHEN a[k] = b[i + 1] THEN prev[k] + 1 ELSE prev[k + 1] END] END),
        lambda acc, x: list_append(acc, greatest(acc[len(acc)], x[1]))), a, b FROM step WHERE i < len(b)),
    l AS (SELECT pair_id, CAST(prev[len(prev)] AS DOUBLE) AS m, CAST(len(a) AS DOUBLE) AS r, CAST(len(b) AS DOUBLE) AS h
      FROM step WHERE i = len(b))
    SELECT pair_id, coalesce(2 * (m / nullif(h, 0)) * (m / nullif(r, 0)) /
      nullif(m / nullif(h, 0) + m / nullif(r, 0), 0), 0) AS f FROM l)"""


_OUT = f"WITH outputs AS ({A.OUTPUTS_SQL}), pairs AS ({A.PAIRS_SQL})"
_CONV_PAIRS = f"{_OUT} SELECT prompt_id AS pair_id, task, baseline_text AS ref, spec_text AS hyp FROM pairs"


def conversation_pairs(spark, sf_dir):
    pairs = quality.paired_outputs(A.outputs(spark, sf_dir))
    return pairs.select(
        F.col("prompt_id").alias("pair_id"),
        "task",
        F.col("baseline_text").alias("ref"),
        F.col("spec_text").alias("hyp"),
    )


def scorable_summaries(spark, sf_dir):
    """Outputs of both systems with the reference of their prompt, whole texts."""
    return quality.scorable(A.whole_summaries(spark, sf_dir))


@query(
    f"""SELECT prompt_id, system, CAST(length(coalesce(reference_summary, '')) AS INT) AS ref_chars,
    md5(coalesce(reference_summary, '')) AS ref_md5 FROM ({A.SUMMARIES_SQL})"""
)
def reference_lookup(spark, sf_dir):
    """The reference text that belongs to each output's prompt."""
    outputs = A.summary_outputs(spark, sf_dir).drop("hyp")
    found = quality.with_reference(outputs, A.summary_references(spark, sf_dir))
    return found.select("prompt_id", "system", F.length("ref").alias("ref_chars"), F.md5("ref").alias("ref_md5"))


@query(
    f"{_OUT} SELECT gpu_type, task, prompt_id, concurrency, trial, baseline_text, spec_text FROM pairs"
)
def paired_outputs(spark, sf_dir):
    """Both arms' outputs for the same prompt."""
    return quality.paired_outputs(A.outputs(spark, sf_dir))


@query(f"SELECT pair_id, {r('f')} AS rouge1 FROM {_rouge_sql(A.SCORABLE_SQL, 1)}")
def rouge1(spark, sf_dir):
    """ROUGE-1 of every output against its reference."""
    return tidy(quality.rouge_n(scorable_summaries(spark, sf_dir), (1,)))


@query(f"SELECT pair_id, {r('f')} AS rouge2 FROM {_rouge_sql(A.SCORABLE_SQL, 2)}")
def rouge2(spark, sf_dir):
    """ROUGE-2 of every output against its reference."""
    return tidy(quality.rouge_n(scorable_summaries(spark, sf_dir), (2,)))


@query(f"SELECT pair_id, {r('f')} AS rougeL FROM {_rouge_l_sql(_CONV_PAIRS)}")
def rouge_l(spark, sf_dir):
    """ROUGE-L between the arms' outputs."""
    return tidy(quality.rouge_l(conversation_pairs(spark, sf_dir)).select("pair_id", "rougeL"))


@query()
def rouge_stemmed(spark, sf_dir):
    """The three scores with stemming, per output."""
    scored = quality.all_rouge(A.whole_summaries(spark, sf_dir), ["system"], stem=True)
    return tidy(scored)


# Each arm's output against a reference: for the baseline the reply, for the treatment the request.
_BY_SYSTEM = f"""{_OUT} SELECT prompt_id || '/' || system AS pair_id, system, ref, hyp FROM (
    SELECT prompt_id, 'baseline' AS system, spec_text AS ref, baseline_text AS hyp FROM pairs
    UNION ALL SELECT prompt_id, 'eagle3', baseline_text, spec_text FROM pairs) WHERE length(ref) > 0 AND length(hyp) > 0"""
_SCORES = f"""SELECT system, {r('avg(x.f)', 4)} AS rouge1, {r('avg(y.f)', 4)} AS rouge2, {r('avg(z.f)', 4)} AS "rougeL",
    count(*) AS n FROM ({_BY_SYSTEM}) p JOIN {_rouge_sql(_BY_SYSTEM, 1)} x USING (pair_id)
    JOIN {_rouge_sql(_BY_SYSTEM, 2)} y USING (pair_id) JOIN {_rouge_l_sql(_BY_SYSTEM)} z USING (pair_id) GROUP BY system"""


def outputs_with_reference(spark, sf_dir):
    """Both arms' outputs, one row each, with the text they are scored against."""
    pairs = quality.paired_outputs(A.outputs(spark, sf_dir))
    sides = F.array(
        F.struct(F.lit("baseline").alias("system"), F.col("spec_text").alias("ref"), F.col("baseline_text").alias("hyp")),
        F.struct(F.lit("eagle3").alias("system"), F.col("baseline_text").alias("ref"), F.col("spec_text").alias("hyp")),
    )
    rows = pairs.select("prompt_id", F.inline(sides))
    return rows.withColumn("pair_id", F.concat_ws("/", "prompt_id", "system"))


@query(_SCORES)
def rouge_summary(spark, sf_dir):
    """Mean of the three scores per system."""
    return quality.rouge_summary(quality.all_rouge(outputs_with_reference(spark, sf_dir), ["system"]))


@query(
    f"""WITH s AS ({_SCORES}), w AS (SELECT unnest(['baseline', 'eagle3', 'mlx_spec']) AS system)
    SELECT system, 'rouge1' AS metric, coalesce(rouge1, 0) AS score FROM w LEFT JOIN s USING (system)
    UNION ALL SELECT system, 'rouge2', coalesce(rouge2, 0) FROM w LEFT JOIN s USING (system)
    UNION ALL SELECT system, 'rougeL', coalesce("rougeL", 0) FROM w LEFT JOIN s USING (system)"""
)
def rouge_bars(spark, sf_dir):
    """Bar heights per system; what is missing is zero."""
    scored = quality.all_rouge(outputs_with_reference(spark, sf_dir), ["system"])
    return series.rouge_bars(quality.rouge_summary(scored), ("baseline", "eagle3", "mlx_spec"))


@query()
def rouge_documents(spark, sf_dir):
    """Mean of the three scores per system over all documents, long ones included."""
    return quality.rouge_summary(quality.all_rouge(A.whole_summaries(spark, sf_dir), ["system"]))


@query()
def rouge_document_bars(spark, sf_dir):
    """Bar heights per system over all documents; what is missing is zero."""
    scored = quality.all_rouge(A.whole_summaries(spark, sf_dir), ["system"])
    return series.rouge_bars(quality.rouge_summary(scored), ("baseline", "eagle3", "mlx_spec"))


@query(
    f"""SELECT task, count(*) AS n, {r('avg(f)', 5)} AS mean_rouge_l, CASE WHEN avg(f) >= 0.7 THEN 'PASS'
    WHEN avg(f) >= 0.5 THEN 'WARN' ELSE 'FAIL' END AS result FROM ({_CONV_PAIRS}) p
    JOIN {_rouge_l_sql(_CONV_PAIRS)} USING (pair_id) GROUP BY task"""
)
def rouge_verdict(spark, sf_dir):
    """Whether the arms' outputs agree, per task."""
    scored = quality.rouge_l(conversation_pairs(spark, sf_dir))
    return tidy(quality.consistency(scored), 5)


_THREE = f"""FROM ({_CONV_PAIRS}) p JOIN {_rouge_sql(_CONV_PAIRS, 1)} x USING (pair_id)
    JOIN {_rouge_sql(_CONV_PAIRS, 2)} y USING (pair_id) JOIN {_rouge_l_sql(_CONV_PAIRS)} z USING (pair_id)"""


@query(f"SELECT pair_id, task, {r('x.f')} AS rouge1, {r('y.f')} AS rouge2, {r('z.f')} AS rougeL {_THREE}")
def rouge_scores(spark, sf_dir):
    """The three scores of every output pair."""
    return tidy(quality.all_rouge(conversation_pairs(spark, sf_dir), ["task"]))


@query(
    f"""SELECT task, {r('avg(x.f)', 4)} AS rouge1, {r('avg(y.f)', 4)} AS rouge2, {r('avg(z.f)', 4)} AS rougeL,
    count(*) AS n {_THREE} GROUP BY task"""
)
def rouge_means(spark, sf_dir):
    """Mean of the three scores per task, 4 digits."""
    scored = quality.all_rouge(conversation_pairs(spark, sf_dir), ["task"])
    return quality.rouge_summary(scored, ["task"])


def _fence_sql(c: str) -> str:
    return (
        f"CASE WHEN contains({c}, '```python') THEN split_part(substr({c}, strpos({c}, '```python') + 9), '```', 1)"
        f" WHEN contains({c}, '```') THEN split_part(substr({c}, strpos({c}, '```') + 3), '```', 1) ELSE {c} END"
    )


@query(
    f"""SELECT prompt_id, {_fence_sql('baseline_text')} AS baseline_code, {_fence_sql('spec_text')} AS spec_code
    FROM ({A.ANSWERS_SQL})"""
)
def code_blocks(spark, sf_dir):
    """The code part of each answer."""
    return A.answers(spark, sf_dir).select(
        "prompt_id",
        fenced_code("baseline_text").alias("baseline_code"),
        fenced_code("spec_text").alias("spec_code"),
    )


# Answers are built to be valid or not, so the check knows the result.
_VALIDITY = f"SELECT *, base_variant <> 4 AS b, spec_variant <> 4 AS s FROM ({A.ANSWERS_SQL})"


@query(
    f"""SELECT prompt_id, task, b AS baseline_ok, s AS spec_ok, CASE WHEN b = s THEN 'OK' ELSE 'DIFF' END AS status
    FROM ({_VALIDITY})"""
)
def syntax_check(spark, sf_dir):
    """Whether the code of each answer parses."""
    rows = A.answers(spark, sf_dir).select("prompt_id", "task", "baseline_text", "spec_text")
    return quality.syntax_check(rows)


@query(
    f"""SELECT task, count(*) AS n, count(*) FILTER (b) AS baseline_pass, count(*) FILTER (s) AS spec_pass,
    CASE WHEN count(*) FILTER (s) >= count(*) FILTER (b) THEN 'PASS' ELSE 'WARN' END AS result,
    greatest(count(*) FILTER (b) - count(*) FILTER (s), 0) AS more_failures FROM ({_VALIDITY}) GROUP BY task"""
)
def syntax_counts(spark, sf_dir):
    """Pass counts per task and the verdict."""
    rows = A.answers(spark, sf_dir).select("prompt_id", "task", "baseline_text", "spec_text")
    return quality.syntax_counts(quality.syntax_check(rows))


@query(
    f"""{_OUT}, first AS (SELECT * FROM pairs ORDER BY prompt_id LIMIT 5)
    SELECT prompt_id, substr(text, 1, 120) AS prompt, substr(baseline_text, 1, 200) AS baseline,
    substr(spec_text, 1, 200) AS spec FROM first JOIN (SELECT 'chat_' || conv_id || '_' || turn AS prompt_id, text
    FROM conversations) USING (prompt_id)"""
)
def side_by_side(spark, sf_dir):
    """Five pairs for reading."""
    pairs = quality.paired_outputs(A.outputs(spark, sf_dir))
    asked = A.table(spark, sf_dir, "conversations").select(
        F.concat_ws("_", F.lit("chat"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col("text").alias("prompt"),
    )
    return quality.side_by_side(pairs, asked, 5)


@query(
    f"""SELECT task, count(*) AS n, count(*) FILTER (baseline_text = spec_text) AS identical,
    {r('avg(CAST(baseline_text = spec_text AS INT))')} AS identical_share,
    {r('avg(abs(length(baseline_text) - length(spec_text)))')} AS mean_length_gap
    FROM ({A.as_sql('documents', A.DOC_PAIRS)}) GROUP BY task"""
)
def output_parity(spark, sf_dir):
    """How often outputs are identical, and the gap of their lengths."""
    return tidy(quality.parity(A.doc_pairs(spark, sf_dir)))


@query(
    f"{_OUT} SELECT prompt_id, system, substr(output_text, 1, 500) AS preview FROM outputs"
)
def text_previews(spark, sf_dir):
    """The first 500 characters of each output."""
    rows = A.outputs(spark, sf_dir).select("prompt_id", "system", "output_text")
    return report.text_preview(rows)


@query(
    f"""SELECT doc_id, CAST(len({words_sql('text')}) AS INT) AS words FROM documents"""
)
def token_counts(spark, sf_dir):
    """Words of each text as the scores see them."""
    return A.table(spark, sf_dir, "documents").select("doc_id", F.size(tokens("text")).alias("words"))
