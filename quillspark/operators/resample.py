"""Random weights that any engine draws alike: a function of a cell, a replicate and a seed, in whole numbers.

A row that is drawn with replacement among very many comes up a Poisson number of times with mean 1, and a cell of n equal rows with
mean n. The weight of a cell is drawn as the sum of a Poisson number for each binary digit of n, each read off a ladder of
whole numbers, so it costs as many steps as n has digits, and is exact for every n.

The uniform number that climbs a ladder is a polynomial modulo the prime 2**31 - 1: fifth powers are a bijection there, and
no product exceeds 2**62, so SQL's longs do."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

PRIME = 2_147_483_647
#: Fixed values of our own: they only keep apart what is added up.
OF_WHOLE, OF_PART, OF_SIDE, OF_DIGIT, OF_REPLICATE, OF_SEED, AGAIN = 69_621, 48_271, 16_807, 39_373, 1_664_525, 1_013_904_223, 31_337
PARTS = 1 << 30


@lru_cache(maxsize=64)
def ladder(digit: int) -> tuple[int, np.ndarray]:
    """For a Poisson number of mean 2**digit: how many values are below the first step, and the steps, of which those not above the uniform number count."""
    mean = float(1 << digit)
    below, steps, total, k = 0, [], 0.0, max(0, int(mean - 40 * math.sqrt(mean) - 40))
    below = k  # what is further off has no step of its own
    while True:
        total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        step = int(total * PRIME)
        if step >= PRIME or (k > mean and steps and step == steps[-1]):
            return below, np.array(steps, np.int64)
        if step == 0:
            below += 1
        else:
            steps.append(step)
        k += 1


def _fifth(x):
    square = x * x % PRIME
    return square * square % PRIME * x % PRIME


def code(score: np.ndarray, side: int) -> np.ndarray:
    """A number for each cell, from its score and its label's side."""
    whole = np.floor(score)
    part = np.floor((score - whole) * PARTS).astype(np.int64)
    return (np.fmod(whole, PRIME).astype(np.int64) % PRIME * OF_WHOLE + part * OF_PART + side * OF_SIDE) % PRIME


def uniform(codes: np.ndarray, digit: int, replicate: int, seed: int) -> np.ndarray:
    """Numbers from 0 up to PRIME - 1."""
    r = (replicate * OF_REPLICATE + seed * OF_SEED + 1) % PRIME
    c = _fifth((codes + digit * OF_DIGIT) % PRIME)
    return _fifth((_fifth((c + r) % PRIME) + r * AGAIN + 1) % PRIME)


def weights(codes: np.ndarray, counts: np.ndarray, replicate: int, seed: int) -> np.ndarray:
    """How often a replicate draws from each cell of so many rows."""
    out = np.zeros(len(codes), np.int64)
    for digit in range(int(counts.max(initial=0)).bit_length()):
        at = np.flatnonzero(counts >> digit & 1)
        if len(at):
            below, steps = ladder(digit)
            out[at] += below + np.searchsorted(steps, uniform(codes[at], digit, replicate, seed), side="right")
    return out


def fifth_sql(cte: str, source: str, argument: str, out: str) -> str:
    """CTEs that add the fifth power of `argument` modulo the prime to the rows of `source`, as the column `out`."""
    return (f"{cte}_a AS (SELECT *, {argument} AS {cte}_x FROM {source}),\n{cte}_b AS (SELECT *, {cte}_x * {cte}_x % {PRIME} AS {cte}_y FROM {cte}_a),\n"
            f"{cte} AS (SELECT *, {cte}_y * {cte}_y % {PRIME} * {cte}_x % {PRIME} AS {out} FROM {cte}_b)")
