"""Output quality: ROUGE, code syntax, parity of paired outputs.

Pairs are one row each: ``pair_id`` (unique), ``ref``, ``hyp`` and what the caller
carries along.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armlens import schema as S
from armlens.functions.numeric import half_even, ratio
from armlens.functions.text import fenced_code, tokens
from armlens.functions.udfs import overlaps, valid_python
from armlens.operators.compare import PAIR_KEY, paired_requests
from armlens.operators.prompts import first_rows


def with_reference(outputs: DataFrame, prompts: DataFrame) -> DataFrame:
    """Look up each output's reference text by prompt; none gives an empty text. Of a prompt
    that is listed more than once the largest text is taken, so outputs are not multiplied."""
    refs = prompts.groupBy(F.col("id").alias("prompt_id")).agg(F.max("reference_summary").alias("reference_summary"))
    return outputs.join(refs, "prompt_id", "left").withColumn(
        "ref", F.coalesce("reference_summary", F.lit(""))
    )


def scorable(pairs: DataFrame) -> DataFrame:
    return pairs.filter((F.length("ref") > 0) & (F.length("hyp") > 0))


def f_measure(common: Column, ref_size: Column, hyp_size: Column) -> Column:
    p, r = ratio(common, hyp_size), ratio(common, ref_size)
    return F.coalesce(ratio(2 * p * r, p + r), F.lit(0.0))


def rouge_n(
    pairs: DataFrame, sizes: Sequence[int] = (1, 2), stem: bool = False, keep: Sequence[str] = ()
) -> DataFrame:
    """ROUGE-n F1 per pair for each n in ``sizes``; row by row, no shuffle."""
    return _with_scores(pairs, stem, sizes, False).select("pair_id", *keep, *[f"rouge{n}" for n in sizes])


def _with_scores(pairs: DataFrame, stem: bool, sizes: Sequence[int], order: bool) -> DataFrame:
    """ROUGE-n for each n in ``sizes`` and, with ``order``, ROUGE-L, in place of the texts. One function stems
    and counts what the two sides share, so the words of a pair reach Python once."""
    words = pairs.withColumns({"_ref": tokens("ref"), "_hyp": tokens("hyp")}).drop("ref", "hyp")
    found = words.withColumn("_shared", overlaps(F.col("_ref"), F.col("_hyp"), sizes, order, stem))

    def count(side: str, n: int) -> Column:
        return F.greatest(F.size(side) - (n - 1), F.lit(0)).cast("double")

    def score(name: str, n: int) -> Column:
        return f_measure(F.col(f"_shared.{name}").cast("double"), count("_ref", n), count("_hyp", n))

    scores = {f"rouge{n}": score(f"c{n}", n) for n in sizes}
    if order:
        scores["rougeL"] = score("lcs", 1)
    return found.withColumns(scores).drop("_shared", "_ref", "_hyp")


def rouge_l(pairs: DataFrame, stem: bool = False) -> DataFrame:
    """Add ROUGE-L F1; row by row, no shuffle."""
    return _with_scores(pairs, stem, (), True)


def lcs_native(a: Column, b: Column) -> Column:
    """LCS length with array functions only; slow, the check of the fast one."""
    zeros = F.transform(a, lambda _: F.lit(0))

    def next_row(row: Column, word: Column) -> Column:
        def step(acc: Column, cell: Column) -> Column:
            # acc holds the new row so far; cell has the word above and its place.
            left = F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0))
            best = F.when(
                cell["w"] == word, F.coalesce(F.get(row, cell["i"] - 1), F.lit(0)) + 1
            ).otherwise(F.greatest(left, F.get(row, cell["i"])))
            return F.array_append(acc, best)

        cells = F.transform(a, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
        return F.aggregate(cells, F.array().cast("array<int>"), step)

    last = F.aggregate(b, zeros, next_row)
    return F.coalesce(F.get(last, F.size(last) - 1), F.lit(0))


def rouge_summary(scored: DataFrame, keys: Sequence[str] = ("system",)) -> DataFrame:
    """Mean of each score, 4 digits."""
    return scored.groupBy(*keys).agg(
        *[half_even(F.avg(c), 4).alias(c) for c in ("rouge1", "rouge2", "rougeL") if c in scored.columns],
        F.count(F.lit(1)).alias("n"),
    )


def all_rouge(pairs: DataFrame, keep: Sequence[str], stem: bool = False) -> DataFrame:
    """The three scores per pair, row by row."""
    scored = _with_scores(scorable(pairs), stem, (1, 2), True)
    return scored.select("pair_id", *keep, "rouge1", "rouge2", "rougeL")


def consistency(scored: DataFrame, keys: Sequence[str] = ("task",)) -> DataFrame:
    """PASS, WARN or FAIL by the mean ROUGE-L between the two arms' outputs."""
    mean = F.avg("rougeL")
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        mean.alias("mean_rouge_l"),
        F.when(mean >= S.ROUGE_PASS, "PASS").when(mean >= S.ROUGE_WARN, "WARN").otherwise("FAIL").alias("result"),
    )


def paired_outputs(outputs: DataFrame, key: Sequence[str] = tuple(PAIR_KEY)) -> DataFrame:
    """Both arms' text for the same prompt."""
    return (
        paired_requests(outputs, key, ["output_text"])
        .withColumnRenamed("output_text_base", "baseline_text")
        .withColumnRenamed("output_text_spec", "spec_text")
    )


def syntax_check(pairs: DataFrame) -> DataFrame:
    """Whether each side's code parses, and whether the sides agree."""
    checked = pairs.withColumns(
        {
            "baseline_ok": valid_python(fenced_code("baseline_text")),
            "spec_ok": valid_python(fenced_code("spec_text")),
        }
    )
    return checked.withColumn(
        "status", F.when(F.col("baseline_ok") == F.col("spec_ok"), "OK").otherwise("DIFF")
    ).drop("baseline_text", "spec_text")


def syntax_counts(checked: DataFrame, keys: Sequence[str] = ("task",)) -> DataFrame:
    base, spec = F.count_if("baseline_ok"), F.count_if("spec_ok")
    return checked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        base.alias("baseline_pass"),
        spec.alias("spec_pass"),
        F.when(spec >= base, "PASS").otherwise("WARN").alias("result"),
        F.greatest(base - spec, F.lit(0)).alias("more_failures"),
    )


def preview(text: str, chars: int) -> Column:
    return F.substring(F.col(text), 1, chars)


def side_by_side(pairs: DataFrame, prompts: DataFrame, n: int = 5) -> DataFrame:
    """First n pairs with their prompt, cut for reading."""
    shown = first_rows(pairs, "prompt_id", n)
    asked = prompts.select(F.col("id").alias("prompt_id"), "prompt")
    return shown.join(asked, "prompt_id", "left").select(
        "prompt_id",
        preview("prompt", 120).alias("prompt"),
        preview("baseline_text", 200).alias("baseline"),
        preview("spec_text", 200).alias("spec"),
    )


def parity(pairs: DataFrame, keys: Sequence[str] = ("task",)) -> DataFrame:
    """How often the outputs are identical and how far their lengths differ."""
    gap = F.abs(F.length("baseline_text") - F.length("spec_text"))
    same = F.col("baseline_text") == F.col("spec_text")
    return pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(same).alias("identical"),
        F.avg(same.cast("int")).alias("identical_share"),
        F.avg(gap).alias("mean_length_gap"),
    )


