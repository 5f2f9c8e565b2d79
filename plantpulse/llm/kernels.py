"""Array kernels over UTF-8 buffers, used inside Arrow batches.

All of them work on whole batches with numpy; nothing loops over characters.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_ODD))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_P, _P_INVERSE = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)
#: Bytes handled at once; bounds the working arrays.
SLICE = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, dtype=U64)
        out[0] = 1
        return np.multiply.accumulate(out)


_POW, _POW_INVERSE = _powers(_P, SLICE + 1), _powers(_P_INVERSE, SLICE + 1)


#: Of the first code points, which nearly all characters are.
_CODE = mix(np.arange(1, (1 << 16) + 1, dtype=U64) * U64(_ODD))


def _code_hashes(codes: np.ndarray) -> np.ndarray:
    out = _CODE[codes & np.uint32(0xFFFF)]
    rare = np.flatnonzero(codes > 0xFFFF)
    if len(rare):
        out[rare] = mix((codes[rare].astype(U64) + U64(1)) * U64(_ODD))
    return out


class CharHashes:
    """Hashes of substrings of an array of code points."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        power, self.inverse = (_POW, _POW_INVERSE) if n <= SLICE else (_powers(_P, n + 1), _powers(_P_INVERSE, n + 1))
        with np.errstate(over="ignore"):
            own = _code_hashes(codes)
            own *= power[:n]
            self.sums = np.zeros(n + 1, dtype=U64)
            np.cumsum(own, out=self.sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[hi] - self.sums[lo]) * self.inverse[lo]


def binary_column(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow binary column without nulls."""
    import pyarrow as pa

    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[at[0]:at[-1]] if len(at) else buf[:0], (at - at[0]) if len(at) else np.zeros(1, np.int64)


def word_hashes(buf: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all rows, in order, and the row of each.

    A polynomial hash over the word's bytes (A-Z lower-cased on request) from running
    sums modulo 2**64, so a word costs the same whatever its length.
    """
    n = len(buf)
    ends_of_rows = np.zeros(n + 1, dtype=bool)
    ends_of_rows[offsets] = True
    hashes, owners = [], []
    lo = 0
    while lo < n:
        hi = min(n, lo + SLICE)
        while hi < n and not (_SEPARATOR[buf[hi - 1]] or ends_of_rows[hi]):  # back to a place between words
            back = hi - 1 - np.flatnonzero((_SEPARATOR[buf[lo:hi - 1]] | ends_of_rows[lo + 1:hi])[::-1])[:1]
            if len(back) and back[0] > lo:
                hi = int(back[0])
                break
            ahead = np.flatnonzero(_SEPARATOR[buf[hi:hi + SLICE]] | ends_of_rows[hi + 1:hi + SLICE + 1][: len(buf[hi:hi + SLICE])])[:1]
            hi = hi + int(ahead[0]) + 1 if len(ahead) else min(n, hi + SLICE)
        piece = buf[lo:hi]
        word = ~_SEPARATOR[piece]
        cut = ends_of_rows[lo:hi]
        start = word.copy()
        start[1:] &= ~word[:-1] | cut[1:]
        end = word.copy()
        end[:-1] &= ~word[1:] | cut[1:]
        s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
        m = len(piece)
        pw, inv = (_POW, _POW_INVERSE) if m <= SLICE else (_powers(_P, m + 1), _powers(_P_INVERSE, m + 1))
        with np.errstate(over="ignore"):
            sums = np.zeros(m + 1, dtype=U64)
            np.cumsum(_BYTE[_LOWER[piece] if lower else piece] * pw[:m], out=sums[1:])
            hashes.append(mix((sums[e] - sums[s]) * inv[s] + (e - s).astype(U64)))
        owners.append(np.searchsorted(offsets, s + lo, side="right") - 1)
        lo = hi
    if not hashes:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def shingles(hashes: np.ndarray, owners: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words of a row and the row of each; a row
    with fewer words (one at least) gives one, of all its words."""
    with np.errstate(over="ignore"):
        n = len(hashes)
        rows, first, counts = np.unique(owners, return_index=True, return_counts=True)
        short = counts < k
        parts, of = [], []
        if n >= k:
            run = np.zeros(n - k + 1, dtype=U64)
            for j in range(k):
                run = mix(run * U64(_ODD) + hashes[j:n - k + 1 + j])
            same = owners[:n - k + 1] == owners[k - 1:]
            parts.append(run[same])
            of.append(owners[:n - k + 1][same])
        for row, at, c in zip(rows[short], first[short], counts[short], strict=True):
            x = np.full(1, c, dtype=U64)
            for j in range(c):
                x = mix(x * U64(_ODD) + hashes[at + j:at + j + 1] + U64(1))
            parts.append(x)
            of.append(np.full(1, row))
    if not parts:
        return hashes[:0], owners[:0]
    return np.concatenate(parts), np.concatenate(of)


def distinct_per_row(values: np.ndarray, owners: np.ndarray, n_rows: int):
    """Per row, its sorted distinct values."""
    order = np.argsort(owners, kind="stable")
    values, bounds = values[order], np.searchsorted(owners[order], np.arange(n_rows + 1))
    for i in range(n_rows):
        yield np.unique(values[bounds[i]:bounds[i + 1]])
