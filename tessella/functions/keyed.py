"""Permutations of 0 .. n - 1 that need no sort: where a key sends one number, any task can tell by itself.

A number x below n is a place (x mod a, x div a) on a grid of a columns and b rows, with a the least whole number whose square
is n or more, and b the least that makes a x b cover n. ROUNDS rounds add, in turn, a hash of the row to the column (mod a)
and a hash of the column to the row (mod b); each can be undone, so the grid is permuted. A result beyond n is sent on until
it is below n. The same in numpy and, as `sql`, in any SQL engine with 64-bit integers.
"""

from __future__ import annotations

from math import isqrt

import numpy as np

#: Rounds; the modulus of all hashes; multipliers below it.
ROUNDS, BITS = 6, 31
M1, M2, M3, M4 = 73244475, 741103597, 668265263, 374761393
_MASK = np.uint32((1 << BITS) - 1)


def grid(n: int) -> tuple[int, int]:
    a = max(1, isqrt(max(0, n - 1)) + 1) if n > 1 else 1
    return a, -(-n // a)


def stir(h: np.ndarray) -> np.ndarray:
    """A mixing of 31-bit numbers, in place; products mod 2^32 keep their lower 31 bits."""
    h ^= h >> np.uint32(16)
    h *= np.uint32(M1)
    h &= _MASK
    h ^= h >> np.uint32(15)
    h *= np.uint32(M2)
    h &= _MASK
    h ^= h >> np.uint32(16)
    return h


def keys(seed: int, sites: np.ndarray) -> np.ndarray:
    """A key for each site's permutation under a seed."""
    s = int(stir(np.array([seed & 0x7FFFFFFF], np.uint32))[0])
    return stir(((s + sites.astype(np.int64) * M3) & 0x7FFFFFFF).astype(np.uint32))


def sent(x: np.ndarray, n: int, key: np.ndarray) -> np.ndarray:
    """Where each x (below n) goes under the key beside it (same shape)."""
    a, b = grid(n)
    x = x.astype(np.uint32)
    wide, high = np.uint32(a), np.uint32(b)

    def once(x, key):
        column, row = x % wide, x // wide
        for i in range(ROUNDS):
            start = key + np.uint32(i * M4 & 0x7FFFFFFF)
            if i % 2 == 0:
                column = (column + stir(start + row * np.uint32(M3) & _MASK) % wide) % wide
            else:
                row = (row + stir(start + column * np.uint32(M3) & _MASK) % high) % high
        return column + row * wide

    y = once(x, key)
    while (out := y >= n).any():
        y[out] = once(y[out], key[out])
    return y.astype(np.int64)


def _stir_sql(h: str, name: str) -> list[str]:
    m = 1 << BITS
    return [f"xor({h}, {h} >> 16) * {M1} % {m} AS {name}a", f"xor({name}a, {name}a >> 15) * {M2} % {m} AS {name}b", f"xor({name}b, {name}b >> 16) AS {name}"]


def sql_nested(columns: list[str], source: str) -> str:
    """source with columns, each of which may name those before it; one SELECT each, so that no expression is repeated."""
    for c in columns:
        source = f"(SELECT *, {c} FROM {source})"
    return source


def sql_key(seed: str, site: str) -> list[str]:
    """Columns for sql_nested; the last is k."""
    m = 1 << BITS
    return [f"CAST({seed} AS BIGINT) % {m} AS s0", *_stir_sql("s0", "s1"), f"(s1 + CAST({site} AS BIGINT) * {M3}) % {m} AS k0", *_stir_sql("k0", "k")]


def sql_step(x: str, n: str) -> list[str]:
    """Columns for sql_nested: one passage over the grid under key k; the last is y."""
    m = 1 << BITS
    out = [f"CAST(ceil(sqrt({n})) AS BIGINT) AS ga", f"({n} + ga - 1) // ga AS gb", f"{x} % ga AS c0", f"{x} // ga AS r0"]
    for i in range(ROUNDS):
        add = i * M4 & 0x7FFFFFFF
        if i % 2 == 0:
            out += [f"(k + {add} + r{i} * {M3}) % {m} AS h{i}", *_stir_sql(f"h{i}", f"f{i}"), f"(c{i} + f{i} % ga) % ga AS c{i + 1}", f"r{i} AS r{i + 1}"]
        else:
            out += [f"(k + {add} + c{i} * {M3}) % {m} AS h{i}", *_stir_sql(f"h{i}", f"f{i}"), f"(r{i} + f{i} % gb) % gb AS r{i + 1}", f"c{i} AS c{i + 1}"]
    return [*out, f"c{ROUNDS} + r{ROUNDS} * ga AS y"]
