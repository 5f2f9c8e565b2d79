"""Where the tokens' words begin: the public split pattern, evaluated on arrays.

Every boundary of the pattern depends on the classes of at most three neighbouring
characters, so whole batches are cut with a few array comparisons.
"""

from __future__ import annotations

import numpy as np

OTHER, LETTER, NUMBER, BLANK, SPACE = range(5)
_CACHE: dict = {}


def classes() -> np.ndarray:
    """Class of every code point, as the tokenizer libraries' regular expressions see it.

    Asked from the library itself (one call per class), because Unicode tables differ between
    versions.
    """
    if "classes" not in _CACHE:
        import tiktoken

        single = {bytes([i]): i for i in range(256)}
        every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
        out = np.zeros(0x110000, dtype=np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
            e = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
            out[np.frombuffer(bytes(e.encode_ordinary(every)).decode().encode("utf-32-le"), dtype=np.uint32)] = kind
        out[32] = SPACE
        _CACHE["classes"] = out
    return _CACHE["classes"]


def boundaries(codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Which characters begin a word; ``begins`` are the first characters of the texts."""
    n = len(codes)
    if not n:
        return np.zeros(0, dtype=bool)
    c = classes()[codes]
    first = np.zeros(n + 1, dtype=bool)
    first[begins] = True
    first[n] = True
    blank = c >= BLANK
    before = np.empty(n, dtype=np.uint8)
    before[0], before[1:] = 255, c[:-1]
    before[first[:n]] = 255
    after_solid = np.zeros(n, dtype=bool)  # a character that is not blank follows in the same text
    after_solid[:-1] = ~blank[1:] & ~first[1:n]
    was_blank = (before == BLANK) | (before == SPACE)
    # blank: the first of its run, or the last one before something solid; solid: a change of class, but a space belongs to what follows
    start = np.where(blank, ~was_blank | after_solid, (before != c) & (before != SPACE))
    start |= first[:n]
    quote = np.flatnonzero((codes == 39) & ((before == 255) | (before == LETTER) | (before == NUMBER) | (before == BLANK)))
    if len(quote):
        def at(k: int) -> np.ndarray:  # the k-th character after the quote, 0 past the text's end
            p = np.minimum(quote + k, n - 1)
            ok = quote + k < n
            for j in range(1, k + 1):
                ok &= ~first[np.minimum(quote + j, n)]
            return np.where(ok, codes[p], 0)

        a, b = at(1), at(2)
        two = np.isin(a, [ord(x) for x in "stmd"])
        three = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for hit, size in ((quote[two], 2), (quote[three], 3)):
            start[hit + 1] = False
            ends = hit + size
            start[ends[ends < n]] = True
    return start


def byte_offsets(codes: np.ndarray) -> np.ndarray:
    """Place of every character (and of the end) in the UTF-8 form."""
    size = np.ones(len(codes) + 1, dtype=np.int64)
    size[0] = 0
    size[1:] += codes >= 0x80
    size[1:] += codes >= 0x800
    size[1:] += codes >= 0x10000
    return np.cumsum(size)


def cuts(text: str, limit: int):
    """Parts of a text of about ``limit`` characters, cut only before a blank that follows
    something solid: always a word boundary, whatever surrounds it."""
    lo, n = 0, len(text)
    while n - lo > limit:
        hi = lo + limit
        while hi < n and not (text[hi].isspace() and not text[hi - 1].isspace() and classes()[ord(text[hi])] >= BLANK
                              and classes()[ord(text[hi - 1])] < BLANK):
            hi += 1
        yield text[lo:hi]
        lo = hi
    if lo < n or not n:
        yield text[lo:]
