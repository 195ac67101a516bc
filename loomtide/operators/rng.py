"""Seeded randomness as a pure function of (seed, epoch, row, operation): partitioning never changes a draw."""

from __future__ import annotations

import numpy as np

_M = (1 << 64) - 1
# The finaliser's factors, the stream's step, the domains and the key's start.
F1, F2, STEP = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15
SAMPLER, TRANSFORM, TENSOR = 0x53414D504C455201, 0x5452414E53464D01, 0x54454E534F520101
KEY = 0x4F504B45595F5631
#: The smallest normal double: a draw of 0 counts as this where its logarithm is taken.
TINY = 2.2250738585072014e-308


def mix(v: int) -> int:
    v = (v ^ (v >> 30)) * F1 & _M
    v = (v ^ (v >> 27)) * F2 & _M
    return v ^ (v >> 31)


def combine(state: int, value: int) -> int:
    return mix(state ^ mix(value & _M))


def op_key(kind: str, occurrence: int = 0) -> int:
    k = combine(KEY, occurrence)
    for b in kind.encode():
        k = combine(k, b)
    return combine(k, len(kind.encode()))


def domain_seed(seed: int, domain: int, epoch: int) -> int:
    return combine(combine(combine(1, seed), domain), epoch)


class Stream:
    """Draws of one row and operation."""

    def __init__(self, state: int) -> None:
        self.state = state

    def u64(self) -> int:
        self.state = (self.state + STEP) & _M
        return mix(self.state)

    def f32(self) -> np.float32:
        return np.float32((self.u64() >> 40) / (1 << 24))

    def f64(self) -> float:
        return (self.u64() >> 11) / (1 << 53)

    def coin(self, p: float) -> bool:
        return self.f64() < p

    def below(self, n: int) -> int:
        """0 .. n-1 without bias: draws under 2**64 mod n are drawn again."""
        least = (1 << 64) % n
        while (v := self.u64()) < least:
            pass
        return v % n

    def between(self, low: int, high: int) -> int:
        return low + self.below(high - low)

    def normal(self) -> float:
        u = max(self.f64(), TINY)
        return float(np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * self.f64()))

    def u64s(self, n: int) -> np.ndarray:
        """The next ``n`` draws at once: a draw is its place's number, mixed."""
        with np.errstate(over="ignore"):
            out = first_draws(np.uint64(self.state) + np.arange(n, dtype=np.uint64) * np.uint64(STEP))
        self.state = (self.state + n * STEP) & _M
        return out

    def f32s(self, n: int) -> np.ndarray:
        return (self.u64s(n) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)

    def normals(self, n: int) -> np.ndarray:
        u = (self.u64s(2 * n) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        return np.sqrt(-2 * np.log(np.maximum(u[::2], TINY))) * np.cos(2 * np.pi * u[1::2])


class Context:
    def __init__(self, seed: int = 0, epoch: int = 0) -> None:
        self.root = domain_seed(seed, TRANSFORM, epoch)

    def stream(self, sample: int, key: int) -> Stream:
        return Stream(combine(combine(self.root, sample), key))


class Sampler:
    def __init__(self, seed: int = 0, epoch: int = 0) -> None:
        self.seed = domain_seed(seed, SAMPLER, epoch)

    def shuffle_seed(self, index: int, op_seed: int) -> int:
        return self.seed if index == 0 else combine(self.seed, combine(index, op_seed))


def fisher_yates(n: int, state: int) -> np.ndarray:
    """The permutation that swaps down from the last place."""
    s, out = Stream(state), list(range(n))
    for i in range(n - 1, 0, -1):
        j = s.below(i + 1)
        out[i], out[j] = out[j], out[i]
    return np.array(out, np.int64)


def first_draws(state: np.ndarray) -> np.ndarray:
    """The first u64 of many streams at once, by their states (uint64)."""
    v = state + np.uint64(STEP)
    v = (v ^ (v >> np.uint64(30))) * np.uint64(F1)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(F2)
    return v ^ (v >> np.uint64(31))


def combined(state: int, values: np.ndarray) -> np.ndarray:
    """combine(state, v) for many v."""

    def m(v: np.ndarray) -> np.ndarray:
        v = (v ^ (v >> np.uint64(30))) * np.uint64(F1)
        v = (v ^ (v >> np.uint64(27))) * np.uint64(F2)
        return v ^ (v >> np.uint64(31))

    return m(np.uint64(state) ^ m(values.astype(np.uint64)))


def row_states(context: Context, rows: np.ndarray, key: int) -> np.ndarray:
    """The stream states of many rows for one operation."""
    first = combined(context.root, rows)
    inner = np.uint64(mix(key & _M))
    v = first ^ inner
    v = (v ^ (v >> np.uint64(30))) * np.uint64(F1)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(F2)
    return v ^ (v >> np.uint64(31))
