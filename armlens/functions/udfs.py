"""The Arrow-batched functions Spark has no expression for."""

import ast
import warnings
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from armlens.functions.stem import stem

#: Words of a strip of the LCS, and rows whose words are numbered at a time.
STRIP = 16_384
ROWS = 64


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets and values of a list column; a missing list has no values."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = lists.flatten()
    starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return starts, values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values


def _roots(words: pa.Array) -> pa.Array:
    """The stem of each word longer than three letters."""
    return pa.array([stem(w) if w is not None and len(w) > 3 else w for w in words.to_pylist()], pa.string())


@F.arrow_udf(T.ArrayType(T.StringType()))
def stemmed(words: pa.Array) -> pa.Array:
    """Stem the tokens longer than three letters; each distinct one once per batch."""
    starts, values = _flat(words)
    coded = values.dictionary_encode()
    out = _roots(coded.dictionary).take(coded.indices)
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), out)


def lcs_length(a, b) -> int:
    """Length of the longest common subsequence, bit-parallel (Hyyrö 2004).

    The shorter side is taken in strips of ``STRIP`` words. What a sum carries out of a strip at each
    word of the other side enters the next strip there, so memory is that of one strip.
    """
    if len(a) > len(b):
        a, b = b, a
    length, carries = 0, bytes(len(b))
    for at in range(0, len(a), STRIP):
        strip = a[at : at + STRIP]
        masks = {}
        for i, word in enumerate(strip):
            masks[word] = masks.get(word, 0) | (1 << i)
        full = (1 << len(strip)) - 1
        open_bits, out = full, bytearray(len(b))
        for j, word in enumerate(b):
            mask = masks.get(word, 0)
            if mask or carries[j]:
                hit = open_bits & mask
                total = open_bits + hit + carries[j]
                out[j] = total > full
                open_bits = (total | (open_bits - hit)) & full
        length += len(strip) - open_bits.bit_count()
        carries = out
    return length


def common_sizes(a: np.ndarray, b: np.ndarray, sizes: Sequence[int]) -> list[int]:
    """How many n-grams two arrays of word numbers share for each n, each as often as in the side that has fewer of it."""
    words, found = np.concatenate([a, b]).astype(np.int64), {}
    split, ranks = len(a), None
    for n in range(1, max(sizes) + 1):
        if n == 1:
            keys = words
        else:  # a gram is the one that is a word shorter, by its rank, and its last word
            base = words.max(initial=0) + 1
            ends = [words[n - 1 : len(a)], words[len(a) + n - 1 :]]
            keys = np.concatenate([x[: len(y)] * base + y for x, y in zip((ranks[:split], ranks[split:]), ends)])
            split = len(ends[0])
        _, ranks = np.unique(keys, return_inverse=True)
        kinds = ranks.max(initial=-1) + 1
        counts = [np.bincount(side, minlength=kinds) for side in (ranks[:split], ranks[split:])]
        found[n] = int(np.minimum(*counts).sum())
    return [found[n] for n in sizes]


def overlaps(ref, hyp, sizes: Sequence[int] = (), order: bool = False, stem: bool = False) -> Column:
    """What two token columns share, as one struct: ``c<n>``, the common n-grams for each n in ``sizes``,
    and with ``order`` ``lcs``, the length of the longest common subsequence; with ``stem``, of the
    stemmed tokens."""
    names = [f"c{n}" for n in sizes] + ["lcs"] * order

    @F.arrow_udf(T.StructType([T.StructField(name, T.LongType()) for name in names]))
    def shared(a: pa.Array, b: pa.Array) -> pa.Array:
        rows = np.empty((len(a), len(names)), np.int64)
        for i, (x, y) in enumerate(_coded(a, b, stem)):
            if sizes:
                rows[i, : len(sizes)] = common_sizes(x, y, sizes)
            if order:
                rows[i, -1] = lcs_length(x.tolist(), y.tolist())
        return pa.StructArray.from_arrays([pa.array(c) for c in rows.T], names)

    return shared(ref, hyp)


@F.arrow_udf(T.LongType())
def lcs(a: pa.Array, b: pa.Array) -> pa.Array:
    """LCS length of two token arrays, on word numbers instead of strings."""
    return pa.array([lcs_length(x.tolist(), y.tolist()) for x, y in _coded(a, b)], pa.int64())


def _coded(a: pa.Array, b: pa.Array, stem: bool = False):
    """The words of both columns as numbers, ``ROWS`` rows coded at a time, so that memory does not grow with a batch."""
    for at in range(0, len(a), ROWS):
        (starts_a, values_a), (starts_b, values_b) = _flat(a[at : at + ROWS]), _flat(b[at : at + ROWS])
        words = pa.concat_arrays([values_a, values_b]).dictionary_encode()
        coded = words.indices.to_numpy(zero_copy_only=False)
        if stem:  # words of one root get one number
            coded = _roots(words.dictionary).dictionary_encode().indices.to_numpy(zero_copy_only=False)[coded]
        left, right = coded[: len(values_a)], coded[len(values_a) :]
        for i in range(len(starts_a) - 1):
            yield left[starts_a[i] : starts_a[i + 1]], right[starts_b[i] : starts_b[i + 1]]


def parses(code: str) -> bool:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(code)
        return True
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return False


@F.pandas_udf(T.BooleanType())
def valid_python(code: pd.Series) -> pd.Series:
    """Copies inside a batch are parsed once."""
    known = {c: parses(c) for c in code.dropna().unique()}
    return code.map(known).astype("object")
