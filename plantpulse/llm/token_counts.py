"""Token counts by a finite-state transducer compiled from a BPE vocabulary.

A word's token count is computed left to right.  The transducer's state after some
bytes holds what later bytes can depend on: the longest suffix that may still
grow into a token and, at each place in it where a token may begin, the last
token before that place and the count there.  Its transition on a byte is
annotated with the change of the word's token count.  Which token ends a prefix
is decided by pair validity: the longest token that, next to the token before
it, is left alone by the merges.  States and transitions are compiled when
a text first needs them, into one table per worker, which is dropped
and begun anew when it exceeds ``MAX_STATES``.

A word boundary resets the state, so a chunk of text with a boundary maps every entry state to
one and the same end state, and its count is a constant plus that of its
bytes before the first boundary.  All chunks of a batch advance in step from
their first boundary; a scan over the chunk maps gives every chunk's entry
state; then the leading bytes are run.

Defined results: null counts as empty, with no tokens.  Texts are counted
whole, whatever their length.  Special strings inside a text are one token
each, as the vocabulary's library has it.  Repeated rows give equal rows;
extra columns are kept unless a result column has the name.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from plantpulse.llm.common import group_by_bytes, ship, table
from plantpulse.llm.pretokens import boundaries, byte_offsets

MAX_STATES = 1 << 18
#: Bytes of a chunk, and of a batch of chunks.
CHUNK, SLICE = 512, 1 << 20
LIMIT = 1024
VOCABULARY = "byte_bpe_50k.json"
_MACHINES: dict = {}


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones
    stand for themselves, the others follow from code point 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in own}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    return letters


class Transducer:
    """Byte transducer for one vocabulary; ``table[state * width + column[byte]]`` is
    ``next_state * 256 + change + 128``, or -1 where not compiled yet.  Bytes
    get their columns as they are met, so the table is as wide as the texts need."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        decode = lambda s: bytes(letters[x] for x in s)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(decode(a), decode(b)): i for i, (a, b) in enumerate(merges)}
        self.tokens = {decode(x) for x in spec["model"]["vocab"] if x not in special}
        self.tokens |= {bytes([b]) for b in range(256)}
        self.prefixes = {t[:k] for t in self.tokens for k in range(len(t))}
        self.valid: dict = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict = {}
        self.keys: list = []
        self.width = 128
        self.column, self.bytes = np.full(256, -1, dtype=np.int64), []
        self.table = np.full(1 << 18, -1, dtype=np.int32)
        self.state((b"", ((0, b"", 0),)))

    def columns(self, data: np.ndarray) -> np.ndarray:
        """The columns of bytes, with new ones for bytes not met before."""
        for b in np.flatnonzero((np.bincount(data, minlength=256) > 0) & (self.column < 0)).tolist():
            self.column[b] = len(self.bytes)
            self.bytes.append(b)
        if len(self.bytes) > self.width:
            rows = self.table.reshape(-1, self.width)
            self.table = np.concatenate([rows, np.full((len(rows), 256 - self.width), -1, dtype=np.int32)], axis=1).reshape(-1)
            self.width = 256
        return self.column[data]

    def state(self, key) -> int:
        if key not in self.states:
            self.states[key] = len(self.keys)
            self.keys.append(key)
            if len(self.keys) * self.width > len(self.table):
                self.table = np.concatenate([self.table, np.full(len(self.table), -1, dtype=np.int32)])
        return self.states[key]

    def merged(self, word: bytes) -> list[bytes]:
        """The word's tokens by the merges themselves (used on one or two tokens at a time)."""
        parts = [word[i:i + 1] for i in range(len(word))]
        while len(parts) > 1:
            ranks = [self.rank.get(p, 1 << 30) for p in zip(parts, parts[1:])]
            r = min(ranks)
            if r == 1 << 30:
                break
            i = ranks.index(r)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def beside(self, a: bytes, b: bytes) -> bool:
        """Whether the merges leave token ``b`` alone after ``a`` (none: at a word's start)."""
        if (a, b) not in self.valid:
            if len(self.valid) > 1 << 20:
                self.valid.clear()
            self.valid[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return self.valid[a, b]

    def compile(self, state: int, column: int) -> None:
        """One transition.  A key is the suffix and ``(distance, last token, relative count)`` per place."""
        suffix, places = self.keys[state]
        grown = suffix + bytes([self.bytes[column]])
        last = change = None
        for back, before, count in places:  # longest candidate first
            token = grown[len(grown) - back - 1:]
            if token in self.tokens and self.beside(before, token):
                last, change = token, count + 1
                break
        assert last is not None, "single bytes are tokens"
        kept = [(back + 1, before, count - change) for back, before, count in places
                if grown[len(grown) - back - 1:] in self.prefixes]
        kept.append((0, last, 0))
        longest = kept[0][0]
        to = self.state((grown[len(grown) - longest:], tuple(kept)))
        self.table[state * self.width + column] = to * 256 + change + 128

    def step(self, states: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and count changes of several lanes."""
        at = states * self.width + data
        found = self.table[at]
        missing = found < 0
        if missing.any():
            for x in np.unique(at[missing]).tolist():
                self.compile(*divmod(x, self.width))
            found = self.table[at]
        return found >> 8, (found & 255) - 128

    def changes(self, data: np.ndarray, starts: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        """Per byte, the change of the token count; the sum over a text is its count.

        ``starts`` marks bytes that begin a word; the first byte must be one.
        """
        n = len(data)
        lanes = -(-n // chunk)
        padded, reset = np.zeros(lanes * chunk, dtype=np.int64), np.ones(lanes * chunk, dtype=bool)
        padded[:n], reset[:n] = self.columns(data), starts
        grid, reset = np.ascontiguousarray(padded.reshape(lanes, chunk).T), np.ascontiguousarray(reset.reshape(lanes, chunk).T)
        out = np.zeros((chunk, lanes), dtype=np.int8)
        first = np.where(reset.any(axis=0), reset.argmax(axis=0), chunk)  # bytes before each chunk's first boundary
        # every chunk from its first boundary on: the constant part of its map
        state = np.zeros(lanes, dtype=np.int64)
        live = np.zeros(lanes, dtype=bool)
        for k in range(chunk):
            live |= reset[k]
            state[reset[k]] = 0
            if live.all():
                state, out[k] = self.step(state, grid[k])
            elif live.any():
                state[live], out[k, live] = self.step(state[live], grid[k, live])
        # scan: a chunk's entry state is the end state of the one before; a chunk without any boundary hands its own on
        entry, whole = np.concatenate([[0], state[:-1]]), first == chunk
        for lane in np.flatnonzero(whole).tolist():
            s, column = int(entry[lane]), grid[:, lane].tolist()
            for k, b in enumerate(column):
                found = int(self.table[s * self.width + b])
                if found < 0:
                    self.compile(s, b)
                    found = int(self.table[s * self.width + b])
                s, out[k, lane] = found >> 8, (found & 255) - 128
            if lane + 1 < lanes:
                entry[lane + 1] = s
        # the leading bytes of the others
        state = entry
        rest = np.where(whole, 0, first)
        for k in range(int(rest.max(initial=0))):
            lead = np.flatnonzero(rest > k)
            state[lead], out[k, lead] = self.step(state[lead], grid[k, lead])
        return out.T.reshape(-1)[:n]


def machine(path: str) -> Transducer:
    if path not in _MACHINES:
        _MACHINES[path] = Transducer(path)
    return _MACHINES[path]


def count_batch(texts: list[str], m: Transducer) -> np.ndarray:
    """Token counts of a list of texts."""
    if len(m.keys) > MAX_STATES:
        m.reset()
    out = np.zeros(len(texts), dtype=np.int64)
    joined = "".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    lens = np.array([len(t) for t in texts], dtype=np.int64)
    owner_starts = np.concatenate([[0], np.cumsum(lens)])
    begins = owner_starts[:-1][lens > 0]
    specials = []
    if m.special is not None:
        for i, t in enumerate(texts):  # a special string may not reach over two texts
            if "<" in t or m.special.search(t):
                specials += [(owner_starts[i] + x.start(), owner_starts[i] + x.end()) for x in m.special.finditer(t)]
    where = byte_offsets(codes)
    special = np.zeros(len(codes), dtype=bool)
    for lo, hi in specials:
        special[lo:hi] = True
    extra = np.array([p for x in specials for p in x if p < len(codes)], dtype=np.int64)
    start = boundaries(codes, np.concatenate([begins, extra]))
    data = np.frombuffer(joined.encode("utf-8"), dtype=np.uint8)
    starts = np.zeros(len(data), dtype=bool)
    starts[where[:-1][start]] = True
    if len(data):
        change = m.changes(data, starts).astype(np.int64)
        for lo, hi in specials:
            change[where[lo]:where[hi]] = 0
            change[where[lo]] = 1
        sums = np.concatenate([[0], np.cumsum(change)])
        at = where[owner_starts]
        out = sums[at[1:]] - sums[at[:-1]]
    return out


def count_texts(texts: list[str], m: Transducer) -> np.ndarray:
    """Token counts; a text longer than ``SLICE`` characters is counted in parts cut at word boundaries."""
    from plantpulse.llm.pretokens import cuts

    parts, of = [], []
    for i, t in enumerate(texts):
        # special strings hold no blank, so no cut falls into one
        for p in cuts(t, SLICE) if len(t) > SLICE else (t,):
            parts.append(p)
            of.append(i)
    out = np.zeros(len(texts), dtype=np.int64)
    for lo, hi in group_by_bytes([len(p) for p in parts], SLICE):
        np.add.at(out, of[lo:hi], count_batch(parts[lo:hi], m))
    return out


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """The input plus ``n_bytes``, ``n_tokens`` and ``over_limit``.

    ``vocabulary`` is the path of a byte-level BPE vocabulary (json) on every worker.
    """
    ship(docs.sparkSession)
    kept = docs.drop(*[c for c in ("n_bytes", "n_tokens", "over_limit") if c in docs.columns])
    staged = kept.withColumn("__t", F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))

    def run(batches):
        m = machine(vocabulary)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            sizes, counts = [], []
            for lo in range(0, len(column), 256):
                raw = column.slice(lo, 256).to_pylist()
                sizes += [len(x) for x in raw]
                counts.append(count_texts([x.decode("utf-8", "replace") for x in raw], m))
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)],
                                             [*batch.schema.names[:-1], "n_bytes", "n_tokens", "over_limit"])

    schema = T.StructType([*kept.schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()),
                           T.StructField("over_limit", T.BooleanType())])
    return staged.mapInArrow(run, schema)


def op10_token_counts(spark, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, vocabulary or public_tokenizers.path(VOCABULARY)).drop("text")
