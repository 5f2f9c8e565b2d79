"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters, digits and apostrophes of the lower-cased text (every byte
above 0x7F counts as a letter), so punctuation next to a word does not change it.
A text's features are the distinct buckets (``2**BITS``) of its words, of its words cut to
their first 5 and 7 bytes (a plain stem, by which inflected forms share a weight), its pairs of
neighbouring words, and its pairs with one or two words between them.

The model (McMahan et al., 2013) keeps two sums per coordinate: a coordinate's
rate falls with its own gradients, and its weight is zero until the L1
bound is passed.  Weights that stay zero are neither broadcast nor looked at, so a text's
score comes from its few features with a weight.

The model is fitted in one task on a bounded sample of labelled texts
(``MAX_FIT_DOCS`` rows, ``MAX_FIT_BYTES`` bytes); a class that the sample shortens counts with
the weight of the rows it stands for.  Everything else reads all rows.

Defined results: null and empty texts, and texts without a word, have the score
of the intercept.  Very long texts are read whole, in blocks of words that overlap, with the same
result as in one piece.  Without labels every score is 0.5, with one class only every text gets
that class's smoothed share.  Ids labelled twice with different labels are not learned from; rows
without an id are scored, but are not held out.  Repeated rows are scored alike; extra columns are kept unless
a result column has the name.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from plantpulse.llm.common import group_by_bytes, ship, small_side, table
from plantpulse.llm.kernels import binary_column, mix, word_hashes

BITS = 20
#: Labelled rows that the model is fitted on at most, half of them of either class; those with the smallest hash of their id.
MAX_FIT_DOCS = 12_000
#: Bytes of text that the model is fitted on at most, half of them of either class.
MAX_FIT_BYTES = 48 << 20
THRESHOLD = 0.5
#: Learning rate, its offset, the L1 and L2 bounds, and passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 8.0, 0.0, 5
#: Bytes that the stems keep.
STEMS = (5, 7)
#: Distances of the word pairs: neighbours, and one or two words between.
PAIRS = (1, 2, 3)
#: Bytes of texts, and words of a longer text, whose features are held at once.
SLICE, BLOCK = 1 << 20, 1 << 17

_LETTER = np.full(256, 0x20, dtype=np.uint8)
for _range in (range(0x30, 0x3A), range(0x61, 0x7B), range(0x80, 0x100), (0x27,)):
    _LETTER[list(_range)] = list(_range)
for _upper in range(0x41, 0x5B):
    _LETTER[_upper] = _upper + 0x20


def hashed_words(text: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the words and of their stems, in order, and the row of each word."""
    letters = _LETTER[text]
    hashes, owners = word_hashes(letters, offsets, lower=False)
    at = np.arange(len(letters), dtype=np.int32)
    before = np.where(letters == 0x20, at, np.int32(-1))  # the place before each byte's word
    starts = offsets[:-1][np.diff(offsets) > 0]
    before[starts] = np.where(letters[starts] == 0x20, starts, starts - 1)
    into = at - np.maximum.accumulate(before)
    out = [hashes]
    for size in STEMS:
        out.append(word_hashes(np.where(into > size, np.uint8(0x20), letters), offsets, lower=False)[0])
    return out, owners


def word_buckets(hashed: list[np.ndarray], owners: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every word, stem and word pair."""
    shift, hashes = np.uint64(64 - bits), hashed[0]
    parts = [(mix(h + np.uint64(1 + 100 * i)) >> shift).astype(np.uint32) for i, h in enumerate(hashed)]
    rows = [owners] * len(hashed)
    with np.errstate(over="ignore"):
        for gap in PAIRS:
            if len(hashes) > gap:
                same = owners[:-gap] == owners[gap:]
                pair = mix(hashes[:-gap] * np.uint64(0x9E3779B97F4A7C15) + hashes[gap:] + np.uint64(gap))
                parts.append((pair >> shift).astype(np.uint32)[same])
                rows.append(owners[:-gap][same])
    return np.concatenate(parts), np.concatenate(rows)


def _long_row(text: np.ndarray, bits: int, wanted: np.ndarray | None) -> np.ndarray:
    """Distinct buckets of one long text, block by block; the last words of a block start the next."""
    hashed, owners = hashed_words(text, np.array([0, len(text)], dtype=np.int64))
    seen = np.zeros(1 << bits, dtype=bool)
    for lo in range(0, len(owners), BLOCK):
        block = slice(max(0, lo - max(PAIRS)), lo + BLOCK)
        seen[word_buckets([h[block] for h in hashed], owners[block], bits)[0]] = True
    return np.flatnonzero(seen if wanted is None else seen & wanted)


def rows_of_buckets(buf: np.ndarray, offsets: np.ndarray, bits: int = BITS, wanted: np.ndarray | None = None):
    """Distinct (row, bucket) pairs, sorted; only ``wanted`` buckets where given (a flag per bucket)."""
    out_rows, out_buckets = [], []
    for lo, hi in group_by_bytes(np.diff(offsets), SLICE):
        if hi - lo == 1 and offsets[hi] - offsets[lo] > SLICE:
            b = _long_row(buf[offsets[lo]:offsets[hi]], bits, wanted)
            r = np.full(len(b), lo)
        else:
            b, r = word_buckets(*hashed_words(buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]), bits)
            if wanted is not None:
                use = wanted[b]
                b, r = b[use], r[use]
            both = np.unique((r.astype(np.int64) + lo) << bits | b)
            r, b = both >> bits, both & ((1 << bits) - 1)
        out_rows.append(r)
        out_buckets.append(b)
    if not out_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_rows), np.concatenate(out_buckets)


def ftrl(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, dims: int, epochs: int = EPOCHS, alpha: float = ALPHA,
         beta: float = BETA, l1: float = L1, l2: float = L2, seed: int = 11) -> np.ndarray:
    """Weights (last: intercept, which has no L1 bound) of a logistic model of 0/1 indicators.

    ``rows`` are distinct coordinates, ending in ``dims``, the intercept's."""
    z, n = np.zeros(dims + 1), np.zeros(dims + 1)
    bound = np.full(dims + 1, l1)
    bound[dims] = 0.0

    def weights(i):
        far = np.sign(z[i]) * np.maximum(np.abs(z[i]) - bound[i], 0.0)
        return -far / ((beta + np.sqrt(n[i])) / alpha + l2)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for j in rng.permutation(len(rows)):
            i = rows[j]
            w = weights(i)
            g = weight[j] * (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y[j])
            grown = n[i] + g * g
            z[i] += g - (np.sqrt(grown) - np.sqrt(n[i])) / alpha * w
            n[i] = grown
    return weights(np.arange(dims + 1))


def fit_arrays(buf: np.ndarray, offsets: np.ndarray, label: np.ndarray, weight: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets with a weight, their weights, and the intercept."""
    none = np.zeros(0, np.int64), np.zeros(0)
    if len(set(label.tolist())) < 2:
        share = (label.sum() + 1) / (len(label) + 2) if len(label) else 0.5
        return *none, float(np.log(share / (1 - share)))
    rows = []
    for lo, hi in group_by_bytes(np.diff(offsets), SLICE):  # bounded working arrays; four bytes for a feature are kept
        r, b = rows_of_buckets(buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], bits)
        at, b = np.searchsorted(r, np.arange(hi - lo + 1)), b.astype(np.uint32)
        rows += [np.append(b[at[i]:at[i + 1]], np.uint32(1 << bits)) for i in range(hi - lo)]
    w = ftrl(rows, label.astype(float), weight, 1 << bits)
    use = np.flatnonzero(w[:-1])
    return use, w[use], float(w[-1])


def lowered(text: str | Column) -> Column:
    return F.lower(F.coalesce(F.col(text).cast("string") if isinstance(text, str) else text, F.lit(""))).cast("binary")


def fit(sample: DataFrame, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """Fits on ``text, label, weight, order`` of a frame of bounded size, in one Spark task."""
    ship(sample.sparkSession)
    rows = sample.select(F.lit(0).alias("g"), lowered("text").alias("text"), F.col("label").cast("int").alias("label"),
                         F.col("weight").cast("double").alias("weight"), "order")

    def run(data: pa.Table) -> pa.Table:
        data = data.sort_by([("order", "ascending"), ("text", "ascending")])
        buf, offsets = binary_column(data.column("text").combine_chunks())
        i, w, b = fit_arrays(buf, offsets, data.column("label").to_numpy(), data.column("weight").to_numpy(), bits)
        return pa.table({"i": [i.astype(np.int64).tobytes()], "w": [w.tobytes()], "b": [b]})

    found = rows.groupBy("g").applyInArrow(run, "i binary, w binary, b double").first()
    if found is None:
        return np.zeros(0, np.int64), np.zeros(0), 0.0
    return np.frombuffer(found["i"], dtype=np.int64), np.frombuffer(found["w"]), found["b"]


def score(docs: DataFrame, model, text: str = "text", bits: int = BITS, threshold: float = THRESHOLD) -> DataFrame:
    """The input plus ``score`` (0 to 1) and ``predicted``."""
    ship(docs.sparkSession)
    kept = docs.drop(*[c for c in ("score", "predicted") if c in docs.columns])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**bits weights
    staged, width = kept.withColumn("__lowered", lowered(docs[text])), len(kept.columns)

    def run(batches):
        at, w, intercept = shared.value
        weights, wanted = np.zeros(1 << bits), np.zeros(1 << bits, dtype=bool)
        weights[at], wanted[at] = w, True
        for batch in batches:
            if not batch.num_rows:
                continue
            buf, offsets = binary_column(batch.column(width))
            r, b = rows_of_buckets(buf, offsets, bits, wanted)
            margin = np.bincount(r, weights=weights[b], minlength=batch.num_rows) + intercept
            p = 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                                             [*batch.schema.names[:width], "score", "predicted"])

    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return staged.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit_sample(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_FIT_DOCS, max_bytes: int = MAX_FIT_BYTES) -> DataFrame:
    """``text, label, weight, order`` of a bounded sample of the labelled rows that are not held out.

    Both classes get half of the places.  The ids are chosen before any text is read; only rows chosen
    so are then measured, in one window per class of ``max_docs // 2`` rows.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()) \
        .groupBy("doc_id").agg(F.min("toxic").alias("label"), F.max("toxic").alias("__m")).where("label = __m").select("doc_id", "label")
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    order = F.xxhash64("doc_id")
    ids = None
    for k in (0, 1):
        own = known.where(F.col("label") == k).withColumns({
            "order": order, "weight": F.lit(max(1.0, sizes.get(k, 0) / (max_docs // 2)))}).orderBy("order").limit(max_docs // 2)
        ids = own if ids is None else ids.union(own)
    own = Window.partitionBy("label").orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
    return docs.select("doc_id", "text").join(small_side(ids, max_docs), "doc_id").dropDuplicates(["doc_id"]) \
        .withColumn("bytes", F.sum(F.octet_length("text")).over(own)).where(F.col("bytes") <= max_bytes // 2) \
        .select("text", "label", "weight", "order")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(fit_sample(docs, table(spark, sf_dir, "labels")))
    return score(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
