"""Seeded, engine-independent hashing for samples and bootstrap weights."""

import math
import random

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(text: Column) -> Column:
    """The first 32 bits of md5 as BIGINT."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def sample_key(seed: int, ident: Column) -> Column:
    """Sort key of a seeded shuffle; the same on any partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), ident.cast("string")))


#: A prime: a row's hash times one number plus another, modulo it, is a draw. Of two rows with
#: different hashes the draws are independent.
PRIME = 2**31 - 1


def draw_numbers(draws: int, seed: int) -> list[tuple[int, int]]:
    """The two numbers of each draw."""
    rng = random.Random(seed)
    return [(rng.randrange(1, PRIME), rng.randrange(PRIME)) for _ in range(draws)]


def poisson_cuts(levels: int = 10) -> list[int]:
    """Cumulative Poisson(1) probabilities scaled to the range of a draw."""
    total, cuts = 0.0, []
    for k in range(levels):
        total += math.exp(-1) / math.factorial(k)
        cuts.append(int(total * PRIME))
    return cuts


def poisson_draws(h: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """The Poisson(1) draws of rows with hashes ``h``, one column per draw, by inverting the distribution."""
    a, c = np.array(draw_numbers(draws, seed), np.int64).reshape(-1, 2).T
    return np.searchsorted(poisson_cuts(), (h[:, None] * a + c) % PRIME, side="right")
