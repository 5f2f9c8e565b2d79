"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Texts are cut into words by the public split pattern, and each distinct word of a
run of texts (``RUN`` bytes of a partition) is encoded once.  All new words of the run are laid out side by
side, and an inverted index maps the rank of every adjacent token pair to the
positions where it stands.  The ranks are replayed in order; a merge rewrites
only its two neighbours and files the two new pairs in the index.  A worker keeps
the words it has encoded (``MAX_WORDS`` at most) from run to run.

Ids are the ranks of the public rank file.  Decoding joins the bytes of the ids.

Defined results: null counts as empty: no ids, the hash of nothing.  Texts are
encoded whole, whatever their length, in parts cut at word boundaries.  Bytes that are not
UTF-8 become U+FFFD.  Repeated rows give equal rows; extra columns are kept
unless a result column has the name.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, functions as F, types as T

from plantpulse.llm.common import group_by_bytes, ship, table
from plantpulse.llm.kernels import binary_column
from plantpulse.llm.pretokens import boundaries, byte_offsets, cuts

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Words a worker remembers; bounds its memory, not the result.
MAX_WORDS = 600_000
#: Characters that are cut into words at once, and bytes of texts whose words are encoded together.
SLICE, RUN = 1 << 20, 24 << 20
_ENCODERS: dict = {}


class Encoder:
    """Ranks of a vocabulary, and the words encoded so far."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = (line.split() for line in f if line.strip())
            rank = {base64.b64decode(a): int(b) for a, b in pairs}
        token = {r: t for t, r in rank.items()}
        self.byte = np.array([rank[bytes([b])] for b in range(256)], dtype=np.int64)
        self.size = n = max(token) + 1
        self.at = np.concatenate([[0], np.cumsum([len(token.get(i, b"")) for i in range(n)])]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(token.get(i, b"") for i in range(n)), dtype=np.uint8)
        # every pair of tokens that is a token together
        merges = sorted((rank[t[:i]] * n + rank[t[i:]], r) for t, r in rank.items() for i in range(1, len(t))
                        if t[:i] in rank and t[i:] in rank)
        self.pair_key, self.pair_rank = (np.array([x[k] for x in merges], dtype=np.int64) for k in (0, 1))
        # tokens that can stand in a pair of a lower rank than their own
        left, right = np.divmod(self.pair_key, n)
        self.early = set(left[self.pair_rank < left].tolist()) | set(right[self.pair_rank < right].tolist())
        self.forget()

    def forget(self) -> None:
        self.words: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(1 << 16, dtype=np.uint32), 0

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of the merges of token pairs, -1 where there is none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], -1)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after the other, and how many each has, by
        replaying the merges in rank order over all the words at once."""
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        edge = np.concatenate([[0], np.cumsum(sizes)])
        n = len(data)
        token = self.byte[data]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[edge[1:] - 1] = -1
        before[edge[:-1]] = -1
        word = np.repeat(np.arange(len(words)), sizes)
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def file(places: np.ndarray) -> None:
            """Enters pairs, by their left positions, under their ranks."""
            r = self.ranks(token[places], token[after[places]])
            places, r = places[r >= 0], r[r >= 0]
            if not len(r):
                return
            order = np.argsort(r, kind="stable")
            places, r = places[order], r[order]
            cut = np.flatnonzero(np.diff(r)) + 1
            for k, part in zip(r[np.concatenate([[0], cut])].tolist(), np.split(places, cut), strict=True):
                if k not in index:
                    index[k] = []
                    heapq.heappush(queue, k)
                index[k].append(part)

        file(np.flatnonzero(after >= 0))
        while queue:
            r = heapq.heappop(queue)
            p = index.pop(r)
            p = np.unique(np.concatenate(p)) if len(p) > 1 else np.sort(p[0])
            p = p[(token[p] >= 0) & (after[p] >= 0)]
            q = after[p]
            same = self.ranks(token[p], token[q]) == r  # else a neighbour has been merged since
            p, q = p[same], q[same]
            if not len(p):
                continue
            chained = np.zeros(len(p), dtype=bool)
            chained[1:] = p[1:] == q[:-1]
            if chained.any():  # overlapping pairs: leftmost first, so every second one of a chain
                k = np.arange(len(p))
                keep = (k - np.maximum.accumulate(np.where(chained, 0, k))) % 2 == 0
                p, q = p[keep], q[keep]
            if r in self.early:
                # a merge that brings up a lower rank holds back the word's later places
                back, beyond = before[p], after[q]
                joined = np.zeros(len(p), dtype=bool)
                joined[1:] = back[1:] == q[:-1]
                left = self.ranks(np.where(joined, r, token[back]), np.full(len(p), r))
                right = self.ranks(np.full(len(p), r), token[beyond])
                stop = ((back >= 0) & (left >= 0) & (left < r)) | ((beyond >= 0) & (right >= 0) & (right < r))
                if stop.any():
                    seen = np.cumsum(stop) - stop
                    head = np.concatenate([[True], word[p[1:]] != word[p[:-1]]])
                    go = seen == np.maximum.accumulate(np.where(head, seen, 0))
                    if not go.all():
                        index[r] = [p[~go]]
                        heapq.heappush(queue, r)
                        p, q = p[go], q[go]
            token[p], token[q] = r, -1
            beyond = after[q]
            after[p] = beyond
            before[beyond[beyond >= 0]] = p[beyond >= 0]
            back = before[p]
            file(np.unique(np.concatenate([p[beyond >= 0], back[back >= 0]])))
        left = token >= 0
        return token[left].astype(np.uint32), np.add.reduceat(left, edge[:-1]) if n else sizes

    def learn(self, words: list[bytes]) -> None:
        """Encodes the words that are not known yet."""
        new = [w for w in dict.fromkeys(words) if w not in self.words]
        if not new:
            return
        ids, n = self.replay(new)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:self.used], np.zeros(max(self.used, len(ids)) * 2, dtype=np.uint32)])
        self.ids[self.used:self.used + len(ids)] = ids
        at = self.used + np.cumsum(n) - n
        self.used += len(ids)
        # place and number of a word's ids in one integer
        self.words.update(zip(new, (at << 24 | n).tolist(), strict=True))

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids, and the end of each id in them."""
        ids = ids.astype(np.int64)
        at = self.at[ids]
        n = self.at[ids + 1] - at
        return self.bytes[_ragged(at, n)], np.cumsum(n)


def _ragged(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Indices of runs of length ``n`` that begin at ``at``."""
    total = int(n.sum())
    return np.repeat(at - (np.cumsum(n) - n), n) + np.arange(total)


def _distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct word, and each word's number among them.

    Words are told apart by their bytes: up to 24 of them as three numbers beside the length;
    longer words one by one.
    """
    size = ends - starts
    padded = np.concatenate([data, np.zeros(24, dtype=np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, 8)
    key = size.astype(np.uint64)
    parts = []
    for k in range(3):
        at = np.minimum(starts + 8 * k, len(data))
        x = np.ascontiguousarray(view[at]).view(np.uint64).reshape(-1)
        have = np.clip(size - 8 * k, 0, 8).astype(np.uint64)
        x = np.where(have == 0, np.uint64(0), x & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * np.maximum(have, np.uint64(1)))))
        parts.append(x)
    with np.errstate(over="ignore"):
        for x in parts:
            key = (key ^ x) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
    long = np.flatnonzero(size > 24)
    if len(long):
        seen: dict[bytes, int] = {}
        raw = data.tobytes()
        for i in long.tolist():
            w = raw[starts[i]:ends[i]]
            j = seen.setdefault(w, i)
            key[i] = np.uint64(2 * j + 1)
            parts[0][i], parts[1][i], parts[2][i] = j, 0, 0
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    same = size == size[first][inverse]
    for x in parts:
        same &= x == x[first][inverse]
    if not same.all():  # two words under one key: each occurrence of the second kind stands for itself
        odd = np.flatnonzero(~same)
        inverse = inverse.copy()
        inverse[odd] = len(first) + np.arange(len(odd))
        first = np.concatenate([first, odd])
    return first, inverse


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_texts(texts: list[str], e: Encoder):
    """Yields ``(text number, ids, ids' decoded bytes)`` in order; long texts in several parts.

    First the distinct words of all texts are gathered and the new ones encoded
    together, then the texts are put together from their words' ids.
    """
    parts, of = [], []
    for i, t in enumerate(texts):
        for p in cuts(t, SLICE) if len(t) > SLICE else (t,):
            parts.append(p)
            of.append(i)
    if len(e.words) > MAX_WORDS:
        e.forget()
    runs = []
    for lo, hi in group_by_bytes([len(p) for p in parts], SLICE):
        joined = "".join(parts[lo:hi])
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        raw = joined.encode("utf-8")
        lens = np.array([len(p) for p in parts[lo:hi]], dtype=np.int64)
        edges = np.concatenate([[0], np.cumsum(lens)])
        where = byte_offsets(codes)
        starts = where[:-1][boundaries(codes, edges[:-1][lens > 0])]
        data = np.frombuffer(raw, dtype=np.uint8)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        first, inverse = _distinct_words(data, starts, ends) if len(starts) else (starts, starts)
        own = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        runs.append((lo, hi, own, inverse.astype(np.int32), starts.astype(np.int32), where[edges]))
    e.learn([w for run in runs for w in run[2]])
    for lo, hi, own, inverse, starts, place in runs:
        found = np.fromiter((e.words[w] for w in own), dtype=np.int64, count=len(own))
        at, n = (found >> 24)[inverse], (found & 0xFFFFFF)[inverse]
        ids = e.ids[_ragged(at, n)]
        decoded, ends = e.decode(ids)
        cut = np.searchsorted(np.repeat(starts, n), place)
        ends = np.concatenate([[0], ends])
        for k in range(hi - lo):
            a, b = cut[k], cut[k + 1]
            yield of[lo + k], ids[a:b], decoded[ends[a]:ends[b]]


def encode(docs: DataFrame, vocabulary: str, text: str = "text", with_ids: bool = True, digests: bool = False) -> DataFrame:
    """The input plus ``n_tokens`` and, as asked, ``ids`` (array<int>) or the
    hashes ``ids_sha256`` and ``decoded_sha256``.

    ``vocabulary`` is the path of a rank file on every worker.
    """
    ship(docs.sparkSession)
    new = ["n_tokens", *["ids"] * with_ids, *["ids_sha256", "decoded_sha256"] * digests]
    kept = docs.drop(*[c for c in new if c in docs.columns])
    staged = kept.withColumn("__t", F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))

    def run(batches):
        e = encoder(vocabulary)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            n, ids, hashes = [], [], []
            sizes = np.diff(binary_column(column)[1])
            for lo, hi in group_by_bytes(sizes, RUN):
                texts = [x.decode("utf-8", "replace") for x in column.slice(lo, hi - lo).to_pylist()]
                count, lists = [0] * len(texts), [[] for _ in texts]
                h = [(hashlib.sha256(), hashlib.sha256()) for _ in texts] if digests else None
                for i, x, decoded in encode_texts(texts, e):
                    count[i] += len(x)
                    if with_ids:
                        lists[i].append(x.astype(np.int32))
                    if digests:
                        h[i][0].update(np.ascontiguousarray(x, dtype="<u4"))
                        h[i][1].update(np.ascontiguousarray(decoded))
                n += count
                ids += [np.concatenate(x) for x in lists] if with_ids else []
                hashes += [(a.hexdigest(), b.hexdigest()) for a, b in h] if digests else []
            out = [pa.array(n, pa.int64())]
            if with_ids:
                out.append(pa.array(ids, pa.list_(pa.int32())))
            if digests:
                out += [pa.array([x[k] for x in hashes], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], [*batch.schema.names[:-1], *new])

    kinds = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    return staged.mapInArrow(run, T.StructType([*kept.schema.fields, *[T.StructField(c, kinds[c]) for c in new]]))


def decode(rows: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """The input plus ``bytes`` (binary): what the ids stand for.  Null ids give empty bytes."""
    ship(rows.sparkSession)
    kept = rows.drop(*[c for c in ("bytes",) if c in rows.columns])
    staged = kept.withColumn("__i", F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")))

    def run(batches):
        e = encoder(vocabulary)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            out = [e.decode(np.array(x.as_py(), dtype=np.int64))[0].tobytes() for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], [*batch.schema.names[:-1], "bytes"])

    return staged.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("bytes", T.BinaryType())]))


def op4_bpe(spark, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, vocabulary or public_tokenizers.path(VOCABULARY), with_ids=False, digests=True).drop("text")
