"""Quality classifier: naive Bayes support vectors (NBSVM).

A text's features are indicators of n-grams hashed into ``2**BITS`` buckets:
byte 2- and 3-grams of the text, and 1- to 4-grams of its word-repetition
signs (whether a word equals the one before).  Each indicator is scaled by the class
log-count ratio of its bucket; on the scaled, length-normalised vectors a
linear hinge-loss model is fitted by dual coordinate descent (Hsieh et al.,
2008).  Margins become probabilities through a one-dimensional logistic fit.

The model is fitted in one task on a bounded sample of labelled rows
(``MAX_FIT_DOCS``); what is broadcast is one weight per bucket.

Defined results: null and empty texts have no features and get the score of
the intercept.  Very long texts are read whole.  Without labels, or with one class only,
every text gets that class's share (0.5 without labels).  Repeated rows are
scored alike; extra columns are kept unless a result column has the name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from plantpulse.llm.common import group_by_bytes, ship, small_side, table, with_text
from plantpulse.llm.kernels import binary_column, word_hashes

BITS = 18
#: Labelled rows that the model is fitted on at most, those with the smallest hash of their id.
MAX_FIT_DOCS = 4_000
#: Score from which ``predicted`` is 1.
THRESHOLD = 0.7
EPOCHS = 12
C_PENALTY = 1.0
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


def _buckets(buf: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every n-gram of the rows (indicators not yet made distinct)."""
    (a, i), (b, j) = _byte_buckets(buf, offsets, bits), _sign_buckets(buf, offsets, bits)
    return np.concatenate([a, b]), np.concatenate([i, j])


def _byte_buckets(buf: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the byte 2- and 3-grams."""
    shift = np.uint32(32 - bits)
    n = len(buf)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    parts, rows = [], []
    with np.errstate(over="ignore"):
        c = buf.astype(np.uint32) + np.uint32(1)
        if n > 1:
            two = c[:-1] * _A + c[1:] * _B
            x = two ^ (two >> np.uint32(15))
            same = row[:-1] == row[1:]
            parts.append(((x * _C) >> shift)[same])
            rows.append(row[:-1][same])
        if n > 2:
            x = two[:-1] * _C + c[2:] * _A
            x ^= x >> np.uint32(13)
            same = row[:-2] == row[2:]
            parts.append(((x * _B) >> shift)[same])
            rows.append(row[:-2][same])
    if not parts:
        return np.zeros(0, np.uint32), np.zeros(0, np.int32)
    return np.concatenate(parts), np.concatenate(rows)


def _sign_buckets(buf: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the 1- to 4-grams of the word-repetition signs."""
    shift, parts, rows = np.uint32(32 - bits), [], []
    with np.errstate(over="ignore"):
        h, owner = word_hashes(buf, offsets)
        if len(h) > 1:
            inside = owner[1:] == owner[:-1]
            sign, of = (h[1:] == h[:-1])[inside].astype(np.uint32) + np.uint32(1), owner[1:][inside].astype(np.int32)
            x = np.zeros(len(sign), dtype=np.uint32)
            for k in range(4):
                if len(sign) <= k:
                    break
                x = (x[:-1] if k else x) * np.uint32(3) + sign[k:]
                same = of[:len(of) - k] == of[k:]
                y = (x + np.uint32(1000 * (k + 1))) * _A
                parts.append((((y ^ (y >> np.uint32(16))) * _B) >> shift)[same])
                rows.append(of[:len(of) - k][same])
    if not parts:
        return np.zeros(0, np.uint32), np.zeros(0, np.int32)
    return np.concatenate(parts), np.concatenate(rows)


#: Bytes of texts whose features are held at once; the byte n-grams of a longer text are found in slices that overlap by two bytes.
SLICE = 1 << 20


def indicator_sums(buf: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bits: int = BITS):
    """Per row, the sum of ``weights`` (buckets x k) over its distinct buckets."""
    out = np.zeros((len(offsets) - 1, weights.shape[1]))
    for lo, hi in group_by_bytes(np.diff(offsets), SLICE):
        for i in range(lo, hi):
            b = _row_buckets(buf, offsets, i, bits) if offsets[i + 1] - offsets[i] > SLICE else None
            if b is not None:
                out[i] = weights[b].sum(axis=0)
        if hi - lo > 1 or offsets[hi] - offsets[lo] <= SLICE:
            part = buf[offsets[lo]:offsets[hi]]
            b, r = _buckets(part, offsets[lo:hi + 1] - offsets[lo], bits)
            # of the same bucket of a row, the last entry counts
            order = np.argsort(r, kind="stable")
            b, r = b[order], r[order]
            bounds = np.searchsorted(r, np.arange(hi - lo + 1))
            place = np.zeros(1 << bits, dtype=np.int32)
            at = np.arange(len(b), dtype=np.int32)
            keep = np.empty(len(b), dtype=bool)
            for i in range(hi - lo):
                s = slice(bounds[i], bounds[i + 1])
                place[b[s]] = at[s]
                keep[s] = place[b[s]] == at[s]
            b, r = b[keep], r[keep]
            for k in range(weights.shape[1]):
                out[lo:hi, k] += np.bincount(r, weights=weights[b, k], minlength=hi - lo)
    return out


def _row_buckets(buf, offsets, i, bits) -> np.ndarray:
    """The distinct buckets of one row, read in slices."""
    seen = np.zeros(1 << bits, dtype=bool)
    lo, hi = int(offsets[i]), int(offsets[i + 1])
    for at in range(lo, hi, SLICE):  # the two bytes before a slice belong to its first n-grams
        part = buf[max(lo, at - 2):min(hi, at + SLICE)]
        seen[_byte_buckets(part, np.array([0, len(part)], dtype=np.int64), bits)[0]] = True
    seen[_sign_buckets(buf[lo:hi], np.array([0, hi - lo], dtype=np.int64), bits)[0]] = True  # words are never cut
    return np.flatnonzero(seen)


def dual_coordinate_descent(rows: list[np.ndarray], scale: list[np.ndarray], y: np.ndarray, cost: np.ndarray,
                            dims: int, epochs: int = EPOCHS, seed: int = 5) -> np.ndarray:
    """Weights (last entry: intercept) of a linear model under hinge loss.

    ``rows`` are distinct buckets, ``scale`` their values, ``y`` is -1 or 1,
    ``cost`` the upper bound of each row's dual variable.
    """
    w = np.zeros(dims + 1)
    alpha = np.zeros(len(rows))
    norm = np.array([float(s @ s) + 1.0 for s in scale])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * (w[rows[i]] @ scale[i] + w[dims]) - 1.0
            step = min(max(alpha[i] - g / norm[i], 0.0), cost[i]) - alpha[i]
            if step:
                alpha[i] += step
                w[rows[i]] += step * y[i] * scale[i]
                w[dims] += step * y[i]
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    return w


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of P(y = 1 | margin), by Newton steps with Platt's smoothed targets."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        g, h = np.array([((p - t) * margin).sum(), (p - t).sum()]), p * (1 - p) + 1e-9
        m = np.array([[(h * margin * margin).sum() + 1e-6, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(m, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit_arrays(buf: np.ndarray, offsets: np.ndarray, label: np.ndarray, bits: int = BITS):
    """``(weights, count_norm, slope, intercept)`` from texts and 0/1 labels."""
    y = np.where(label > 0, 1, -1)
    if len(set(y.tolist())) < 2:
        share = (label.sum() + 1) / (len(label) + 2) if len(label) else 0.5
        return np.zeros((1 << bits) + 1), 0.0, float(np.log(share / (1 - share)))
    rows = [_row_buckets(buf, offsets, i, bits) for i in range(len(label))]
    totals = np.ones((2, 1 << bits))  # add-one smoothing
    for r, k in zip(rows, (y > 0).astype(int), strict=True):
        totals[k][r] += 1
    ratio = np.log((totals[1] / totals[1].sum()) / (totals[0] / totals[0].sum()))
    scale = [ratio[r] / np.sqrt(max(1, len(r))) for r in rows]
    share = np.array([(y < 0).mean(), (y > 0).mean()])
    cost = C_PENALTY * np.where(y > 0, 0.5 / share[1], 0.5 / share[0])  # both classes weigh the same
    fold = np.arange(len(y)) % 4 == 3  # rows that only calibrate
    if len(set(y[fold].tolist())) < 2 or len(set(y[~fold].tolist())) < 2:
        fold = np.zeros(len(y), dtype=bool)
    pick = np.flatnonzero(~fold)
    w = dual_coordinate_descent([rows[i] for i in pick], [scale[i] for i in pick], y[pick], cost[pick], 1 << bits)
    margin = np.array([w[r] @ s + w[-1] for r, s in zip(rows, scale, strict=True)])
    a, b = _logistic(margin[fold] if fold.any() else margin, y[fold] if fold.any() else y)
    return np.append(w[:-1] * ratio, w[-1]), a, b


def fit(labelled: DataFrame, bits: int = BITS):
    """Fits on ``text`` and ``label`` of a frame of bounded size, in one Spark task."""
    ship(labelled.sparkSession)
    rows = labelled.select(F.lit(0).alias("g"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
                           F.col("label").cast("int").alias("label"), F.col("order"))

    def run(data: pa.Table) -> pa.Table:
        data = data.sort_by("order")
        buf, offsets = binary_column(data.column("text").combine_chunks())
        w, a, b = fit_arrays(buf, offsets, data.column("label").to_numpy(), bits)
        return pa.table({"w": [w.tobytes()], "a": [a], "b": [b]})

    found = rows.groupBy("g").applyInArrow(run, "w binary, a double, b double").first()
    if found is None:
        return np.zeros((1 << bits) + 1), 0.0, 0.0
    return np.frombuffer(found["w"]), found["a"], found["b"]


def score(docs: DataFrame, model, text: str = "text", bits: int = BITS, threshold: float = THRESHOLD) -> DataFrame:
    """The input plus ``score`` (0 to 1) and ``predicted``."""
    ship(docs.sparkSession)
    kept = docs.drop(*[c for c in ("score", "predicted") if c in docs.columns])
    w, a, b = model
    weights = docs.sparkSession.sparkContext.broadcast(np.stack([w[:-1], np.ones(len(w) - 1)], axis=1).astype(np.float32))
    intercept = float(w[-1])
    staged, taken = with_text(kept, docs, text)
    width = len(kept.columns)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            buf, offsets = binary_column(taken(batch))
            sums = indicator_sums(buf, offsets, weights.value, bits)
            margin = sums[:, 0] / np.sqrt(np.maximum(1, sums[:, 1])) + intercept
            p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                                             [*batch.schema.names[:width], "score", "predicted"])

    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return staged.mapInArrow(run, schema)


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def fit_sample(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_FIT_DOCS) -> DataFrame:
    """``text, label, order`` of the labelled rows not held out with the smallest id hashes.

    The ids are chosen before any text is read; conflicting labels of one id drop it.
    """
    # both classes get half of the places, so that the rarer one is seen often enough
    rest = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()) \
        .groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("__m")).where("label = __m")
    order = F.xxhash64("doc_id")
    ids = None
    for k in (0, 1):
        own = rest.where(F.col("label") == k).select("doc_id", "label", order.alias("order")).orderBy("order").limit(max_docs // 2)
        ids = own if ids is None else ids.union(own)
    return docs.select("doc_id", "text").join(small_side(ids, max_docs), "doc_id").dropDuplicates(["doc_id"]).select("text", "label", "order")


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(fit_sample(docs, table(spark, sf_dir, "labels")))
    return score(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
