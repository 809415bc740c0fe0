"""Kronecker (R-MAT) edges with a random-access generator.

Every edge depends on (seeds, index) alone, so any partitioning gives the same graph. The generator
is a five-term linear recurrence modulo 2^31 - 1; a jump by n steps is a 5x5 matrix power. A task
fills the states of a whole index range by doubling: the states of the upper half are one matrix
times those of the lower half.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the generator: modulus, the two recurrence factors, the initiator's fractions and
# the two scramble constants.
MODULUS = 2**31 - 1
FACTOR_1, FACTOR_5 = 107374182, 104480
A_PART, BC_PART, WHOLE = 5700, 1900, 10000
SCRAMBLE_0, SCRAMBLE_1 = 0x4519840211493211, 0x3050852102C843A5
LOW_30 = 0x3FFFFFFF

Matrix = list[list[int]]
_STEP: Matrix = [[FACTOR_1, 0, 0, 0, FACTOR_5], [1, 0, 0, 0, 0], [0, 1, 0, 0, 0], [0, 0, 1, 0, 0], [0, 0, 0, 1, 0]]


def _times(a: Matrix, b: Matrix) -> Matrix:
    return [[sum(x * y for x, y in zip(row, col)) % MODULUS for col in zip(*b)] for row in a]


def jump(n: int) -> Matrix:
    """The matrix that advances a state by n steps."""
    out = [[int(i == j) for j in range(5)] for i in range(5)]
    base = _STEP
    while n:
        if n & 1:
            out = _times(base, out)
        base = _times(base, base)
        n >>= 1
    return out


def spread_seed(seed1: int, seed2: int) -> list[int]:
    """Two 64-bit seeds as the five words of a state."""
    return [
        (seed1 & LOW_30) + 1,
        (seed1 >> 30 & LOW_30) + 1,
        (seed2 & LOW_30) + 1,
        (seed2 >> 30 & LOW_30) + 1,
        ((seed2 >> 60) << 4) + (seed1 >> 60) + 1,
    ]


def _apply(m: Matrix, state: np.ndarray) -> np.ndarray:
    """A matrix on every column of a (5, n) state."""
    out = np.zeros_like(state)
    p = np.uint64(MODULUS)
    for i in range(5):
        for j in range(5):
            if m[i][j]:
                out[i] = (out[i] + np.uint64(m[i][j]) * state[j] % p) % p
    return out


def advance(state: np.ndarray) -> np.ndarray:
    """One step of every column; the new word is row 0."""
    p = np.uint64(MODULUS)
    new = (np.uint64(FACTOR_1) * state[0] % p + np.uint64(FACTOR_5) * state[4] % p) % p
    return np.concatenate([new[None], state[:4]])


def states(seed: list[int], start: int, count: int, stride: int = 1 << 64) -> np.ndarray:
    """States ``stride * i`` steps from the seed for i in start..start + count - 1."""
    cur = _apply(jump(stride * start), np.array(seed, np.uint64)[:, None])
    width = 1
    while width < count:
        cur = np.concatenate([cur, _apply(jump(stride * width), cur)], axis=1)
        width *= 2
    return cur[:, :count]


def uniform(seed1: int, seed2: int, start: int, count: int) -> np.ndarray:
    """Doubles in [0, 1): value i uses outputs 2i and 2i + 1 of the stream."""
    s = states(spread_seed(seed1, seed2), start, count, stride=2)
    first = advance(s)
    second = advance(first)
    return first[0] / MODULUS + second[0] / (MODULUS * float(MODULUS))


def reverse_bits(x: np.ndarray) -> np.ndarray:
    """64-bit reversal, by swapping ever smaller halves."""
    x = x.astype(np.uint64)
    for shift in (32, 16, 8, 4, 2, 1):
        every = ((1 << 64) - 1) // ((1 << shift) + 1)  # 'shift' ones, 'shift' zeros, and so on
        low = np.uint64(every)
        k = np.uint64(shift)
        x = (x >> k & low) | ((x & low) << k)
    return x


def scramble(v: np.ndarray, scale: int, key0: int, key1: int) -> np.ndarray:
    """A bijection of the ids below 2^scale."""
    word = (1 << 64) - 1
    with np.errstate(over="ignore"):
        x = v.astype(np.uint64) + np.uint64((key0 + key1) & word)
        for factor in (key0 | SCRAMBLE_0, key1 | SCRAMBLE_1):
            x = reverse_bits(x * np.uint64(factor & word)) >> np.uint64(64 - scale)
    return x.astype(np.int64)


def scramble_keys(seed: list[int]) -> tuple[int, int]:
    """Both keys, from four outputs far along the stream."""
    s = np.array(seed, np.uint64)[:, None]
    s = _apply(jump((50 << 128) + (7 << 64)), s)
    words = []
    for _ in range(4):
        s = advance(s)
        words.append(int(s[0, 0]))
    word = (1 << 64) - 1
    return (words[0] * 0xFFFFFFFF + words[1]) & word, (words[2] * 0xFFFFFFFF + words[3]) & word


def edge_range(scale: int, seed1: int, seed2: int, start: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Both ends of the edges start..start + count - 1."""
    seed = spread_seed(seed1, seed2)
    key0, key1 = scramble_keys(seed)
    state = states(seed, start, count)
    src, dst = np.zeros(count, np.int64), np.zeros(count, np.int64)
    limit = MODULUS % WHOLE
    for level in range(scale - 1, -1, -1):
        state = advance(state)
        again = np.flatnonzero(state[0] < limit)
        while len(again):  # outputs below the limit are drawn anew, so that all residues are equally likely
            state[:, again] = advance(state[:, again])
            again = again[state[0, again] < limit]
        draw = state[0] % np.uint64(WHOLE)
        right = draw < BC_PART
        down = (draw >= BC_PART) & (draw < 2 * BC_PART)
        both = draw >= 2 * BC_PART + A_PART
        s_bit, t_bit = down | both, right | both
        flip = (src == dst) & s_bit & ~t_bit  # undirected: on the diagonal the lower half is mirrored
        s_bit, t_bit = s_bit & ~flip, t_bit | flip
        src += s_bit.astype(np.int64) << level
        dst += t_bit.astype(np.int64) << level
    return scramble(src, scale, key0, key1), scramble(dst, scale, key0, key1)


def kronecker_edges(spark: SparkSession, scale: int, edges: int, seed1: int = 111, seed2: int = 222, weighted: bool = False, partitions: int | None = None) -> DataFrame:
    """Columns ``src, dst, weight``; weights are uniform from the same seeds, or 0."""

    def make(batches):
        for b in batches:
            idx = b.column("id").to_numpy()
            if not len(idx):
                continue
            start, count = int(idx[0]), len(idx)  # a range partition is contiguous
            src, dst = edge_range(scale, seed1, seed2, start, count)
            w = uniform(seed2, seed1, start, count) if weighted else np.zeros(count)
            yield pa.record_batch([pa.array(src), pa.array(dst), pa.array(w)], names=["src", "dst", "weight"])

    return spark.range(0, edges, 1, partitions).mapInArrow(make, "src long, dst long, weight double")
