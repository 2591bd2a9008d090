"""Text helpers that run inside the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from armlens.functions.numeric import col

# The characters a Unicode-aware strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c) -> Column:
    return F.btrim(col(c), F.lit(WHITESPACE))


def tokens(c) -> Column:
    """Lower-case alphanumeric runs."""
    return F.array_remove(F.split(F.lower(col(c)), "[^a-z0-9]+"), "")


def grams(words: Column, n: int) -> Column:
    """Word n-grams of a token array, joined by one blank."""
    if n == 1:
        return words
    count = F.greatest(F.size(words) - (n - 1), F.lit(0))
    out = F.slice(words, F.lit(1), count)
    for shift in range(1, n):
        out = F.zip_with(
            out, F.slice(words, F.lit(shift + 1), count), lambda a, b: F.concat_ws(" ", a, b)
        )
    return out


def common_grams(one: Column, two: Column) -> Column:
    """How many grams two arrays share, each as often as in the side that has fewer of it; slow, the
    check of ``udfs.overlaps``.

    Both sides go sorted into one array, a gram's occurrences of the first side before those of the
    second. One pass counts the first and lets each of the second take one of them.
    """

    def side(words: Column, number: int) -> Column:
        return F.transform(words, lambda g: F.struct(g.alias("g"), F.lit(number).alias("s")))

    def step(acc: Column, x: Column) -> Column:
        same = acc["g"] == x["g"]
        left = F.when(same, acc["left"]).otherwise(0)
        first = x["s"] == 0
        taken = ~first & (left > 0)
        return F.struct(
            x["g"].alias("g"),
            F.when(first, left + 1).when(taken, left - 1).otherwise(left).alias("left"),
            (acc["common"] + taken.cast("long")).alias("common"),
        )

    merged = F.array_sort(F.concat(side(one, 0), side(two, 1)))
    start = F.struct(F.lit("").alias("g"), F.lit(0).alias("left"), F.lit(0).cast("long").alias("common"))
    return F.aggregate(merged, start, step, lambda acc: acc["common"])


def fenced_code(c) -> Column:
    """The first python fence, else the first fence, else the whole text."""
    text = col(c)

    def after(mark: str) -> Column:
        rest = F.substring_index(text, mark, 1)
        tail = F.substr(text, F.length(rest) + F.lit(len(mark) + 1))
        # The block ends at the next fence of any kind, or at the end.
        return F.substring_index(tail, "```", 1)

    return (
        F.when(F.contains(text, F.lit("```python")), after("```python"))
        .when(F.contains(text, F.lit("```")), after("```"))
        .otherwise(text)
    )


def prompt_id(request_id) -> Column:
    """The prompt part of a request id, safe for ids that hold ``_c`` elsewhere."""
    return F.regexp_extract(col(request_id), r"^(.*)_c\d+_t\d+$", 1)


def request_id(prompt, concurrency, trial) -> Column:
    return F.concat(
        col(prompt),
        F.lit("_c"),
        col(concurrency).cast("string"),
        F.lit("_t"),
        col(trial).cast("string"),
    )
