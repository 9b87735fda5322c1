"""Counter-based random numbers: a pure function of (seed, keys), whatever the partitioning.

The stream is the first 52 bits of md5("seed|k1|k2|..."), so any SQL engine with md5 can
replay a draw. Keys must be integers or strings (never doubles: their text form varies).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys) -> Column:
    parts = [F.lit(str(seed))]
    parts += [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def pick(n: Column, seed: int, *keys) -> Column:
    """Integer in [0, n)."""
    return F.least(F.floor(uniform(seed, *keys) * n), n - 1).cast("long")


def exponential(seed: int, *keys) -> Column:
    return -F.log1p(-uniform(seed, *keys))


def normal(seed: int, *keys) -> Column:
    """Box-Muller from two independent substreams."""
    u1 = uniform(seed, *keys, F.lit("a"))
    u2 = uniform(seed, *keys, F.lit("b"))
    return F.sqrt(F.lit(-2.0) * F.log1p(-u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def erlang(shape: int, seed: int, *keys) -> Column:
    """Sum of `shape` unit exponentials (a Gamma with integer shape)."""
    out = F.lit(0.0)
    for i in range(shape):
        out = out + exponential(seed, *keys, F.lit(i))
    return out


# ---- runs of draws inside a task: the same streams, hashed by columns ------------------------------

LANES = 8192  # draws of a suffix hashed together: long enough for numpy, short enough for the cache
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5_head(padded: Sequence[bytes], varying: dict[int, np.ndarray], count: int) -> np.ndarray:
    """First 52 bits of md5, a row for each padded text, `count` columns that differ in the words `varying`: these are added to the text's."""
    fixed = np.stack([np.frombuffer(x, "<u4") for x in padded], 1)[:, :, None]
    state = [np.full((len(padded), count), v, np.uint32) for v in _START]
    for block in range(0, len(fixed), 16):
        a, b, c, d = state
        for i in range(64):
            if i < 16:
                f, g = d ^ (b & (c ^ d)), i
            elif i < 32:
                f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
            elif i < 48:
                f, g = b ^ c ^ d, (3 * i + 5) % 16
            else:
                f, g = c ^ (b | ~d), 7 * i % 16
            f += a
            f += fixed[block + g] + np.uint32(_SINES[i])
            if block + g in varying:
                f += varying[block + g]
            turn = _TURNS[i // 16][i % 4]
            up = f << np.uint32(turn)
            f >>= np.uint32(32 - turn)
            f |= up
            f += b
            a, d, c, b = d, c, b, f
        state = [x + y for x, y in zip(state, (a, b, c, d))]
    first, second = (x.byteswap().astype(np.uint64) for x in state[:2])
    return (first << np.uint64(20)) | (second >> np.uint64(12))


def uniform_runs(prefix: str, start: int, count: int, suffixes: Sequence[str]) -> np.ndarray:
    """uniform() of the texts prefix + i + suffix for i in [start, start + count), one row a suffix; suffixes of one length."""
    head, out = prefix.encode(), np.empty((len(suffixes), count))
    lo, end = start, start + count
    while lo < end:
        digits = len(str(lo))
        hi = min(lo + LANES, end, 10**digits)
        i, varying = np.arange(lo, hi), {}
        for j in range(digits):
            at = len(head) + j
            digit = (i // 10 ** (digits - 1 - j) % 10).astype(np.uint32) << np.uint32(8 * (at % 4))
            varying[at // 4] = varying[at // 4] + digit if at // 4 in varying else digit
        texts = [head + b"0" * digits + x.encode() for x in suffixes]
        padded = [t + b"\x80" + bytes(-(len(t) + 9) % 64) + (8 * len(t)).to_bytes(8, "little") for t in texts]
        out[:, lo - start : hi - start] = _md5_head(padded, varying, hi - lo)
        lo = hi
    out /= 2**52
    return out


def normal_runs(prefix: str, start: int, count: int, names: Sequence[str]) -> np.ndarray:
    """normal() with the keys of the prefix, i and a name, for i in [start, start + count), one row a name."""
    u = uniform_runs(prefix, start, count, [f"|{n}|{half}" for n in names for half in "ab"])
    return np.sqrt(-2.0 * np.log1p(-u[0::2])) * np.cos(2.0 * math.pi * u[1::2])
