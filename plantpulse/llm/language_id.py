"""Language identification: multinomial naive Bayes over hashed character n-grams.

Character 1-, 2- and 3-grams of the lower-cased text (runs that are not
letters count as a space) are hashed into ``2**BITS`` buckets.  The model is the
matrix of log probabilities, buckets by languages, and the languages' log priors; its size depends on the
languages only, and it is broadcast.  A batch is scored by gathering the rows of
its n-grams and summing them per text.  Languages with very many labelled texts are thinned each for itself, so
a rare one is learned from all of its texts however large the corpus is; priors count all labelled texts.

Defined results: null, empty and letterless texts are ``und`` with score 0.0.
Very long texts are scored whole, in slices.  Ties go to the language first in
code order.  Without any labelled text every text is ``und``.  Repeated rows
are scored alike; extra columns are kept unless a result column has the name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

from plantpulse.llm.common import group_by_bytes, lean, ship, table, with_text

BITS = 16
#: Expected number of labelled documents per language that the model is fitted on; more are thinned by a hash of the text.
MAX_FIT_DOCS = 5_000
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_M1, _M2, _M3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
#: Characters handled at once; bounds the working arrays.
SLICE = 1 << 17
_CODES: dict = {}


def _is_letter() -> np.ndarray:
    """Which code points are letters, by their Unicode category."""
    if "letter" not in _CODES:
        import unicodedata

        _CODES["letter"] = np.array([unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)])
    return _CODES["letter"]


def features(codes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Buckets of the 1-, 2- and 3-grams that end at each character, one row per order."""
    c = np.where(_is_letter()[codes], codes, np.uint32(32)).astype(np.uint32)
    shift = np.uint32(32 - bits)
    out = np.zeros((3, len(c)), dtype=np.uint32)
    with np.errstate(over="ignore"):
        x = c * _M1
        out[0] = x ^ (x >> np.uint32(15))
        x = (x[1:] ^ np.uint32(0x27D4EB2F)) + c[:-1] * _M2
        out[1, 1:] = (x ^ (x >> np.uint32(13))) * _M3
        x = x[1:] * np.uint32(0x165667B1) + c[:-2] * _M3 if len(c) > 2 else x[:0]
        out[2, 2:] = (x ^ (x >> np.uint32(16))) * _M1
    return out >> shift


def text_batches(column):
    """Texts of an Arrow binary column in runs of bounded size, as ``(lo, texts)``."""
    sizes = np.diff(np.frombuffer(column.cast(pa.large_binary()).buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]) if len(column) else []
    for lo, hi in group_by_bytes(sizes, SLICE):
        yield lo, [x.decode("utf-8", "replace") for x in column.slice(lo, hi - lo).to_pylist()]


def summed(texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text, the sum of ``weights`` rows over its n-grams, and the number of n-grams."""
    lowered = [t.lower() for t in texts]
    lens = np.array([len(t) for t in lowered], dtype=np.int64)
    total = np.zeros((len(texts), weights.shape[1]))
    # slices of at most SLICE characters that begin where a text begins, or two characters back inside a long text
    for i, j in group_by_bytes(lens, SLICE):
        joined = "".join(lowered[i:j])
        codes = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
        starts = np.concatenate([[0], np.cumsum(lens[i:j])[:-1]])
        for lo in range(0, len(codes), SLICE):
            hi, back = min(len(codes), lo + SLICE), min(lo, 2)
            grams = features(codes[lo - back:hi])[:, back:]
            # n-grams may not reach over the start of their text
            inner = starts[(starts >= lo) & (starts < hi)] - lo
            values = weights[grams[0]]
            for order in (1, 2):
                v = weights[grams[order]]
                for d in range(order):
                    p = inner + d
                    v[p[p < hi - lo]] = 0
                values = values + v
            cuts = np.concatenate([[0], inner[inner > 0]])
            part = np.add.reduceat(values, cuts, axis=0)
            owner = np.searchsorted(starts, cuts + lo, side="right") - 1
            np.add.at(total, i + owner, part)
    n = np.maximum(3 * lens - np.where(lens > 1, 3, 2), 0) * (lens > 0)
    return total, np.maximum(n, 1)


def fit(labelled: DataFrame, text: Column, lang: Column, bits: int = BITS,
        max_docs: int = MAX_FIT_DOCS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their log priors and the matrix of log probabilities (``2**bits`` x languages).

    N-gram counts are summed by Spark; the driver receives at most
    ``2**bits`` counts per language, and one number of texts.  About ``max_docs`` texts of a language are used.
    """
    ship(labelled.sparkSession)
    t = F.coalesce(text, F.lit(""))
    sample = labelled.select(t.cast("binary").alias("text"), lang.cast("string").alias("lang")).where("lang is not null")
    texts = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    thinned = {name: int(max_docs / n * (1 << 20)) for name, n in texts.items() if n > max_docs}
    if thinned:
        part = F.create_map(*[F.lit(x) for pair in sorted(thinned.items()) for x in pair])
        sample = sample.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.coalesce(F.try_element_at(part, F.col("lang")), F.lit(1 << 20)))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for lo, texts in text_batches(batch.column(0)):
                for i, x in enumerate(texts):
                    if x and _LETTER.search(x):
                        mine = sums.setdefault(langs[lo + i], np.zeros(1 << bits, dtype=np.int64))
                        lowered = x.lower()
                        for k in range(0, len(lowered), SLICE):
                            codes = np.frombuffer(lowered[max(0, k - 2):k + SLICE].encode("utf-32-le", "replace"), dtype=np.uint32)
                            g = features(codes, bits)
                            back = min(k, 2)
                            for order in range(3):
                                mine += np.bincount(g[order][max(back, order):], minlength=1 << bits)
        for name, mine in sums.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                                              pa.array(mine[at])], ["lang", "bucket", "n"])

    rows = sample.mapInArrow(lean(count), "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    counts = np.ones((1 << bits, len(langs)))  # add-one smoothing
    for k, name in enumerate(langs):
        own = rows[rows["lang"] == name]
        counts[own["bucket"].to_numpy(), k] += own["n"].to_numpy()
    if not langs:
        return [], np.zeros(0), np.zeros((1 << bits, 0), np.float32)
    share = np.array([texts[name] for name in langs], dtype=float)
    return langs, np.log(share / share.sum()), np.log(counts / counts.sum(axis=0)).astype(np.float32)


def posterior(loglik: np.ndarray, n: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Class probabilities from log priors and summed log likelihoods of ``n`` dependent n-grams.

    Neighbouring n-grams overlap, so the evidence of n of them is taken as
    that of their square root; else every longer text would score 0 or 1.
    """
    x = loglik / np.sqrt(n)[:, None] + prior
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text: str = "text") -> DataFrame:
    """The input plus ``lang_pred`` and ``score``."""
    kept = docs.drop(*[c for c in ("lang_pred", "score") if c in docs.columns])
    ship(docs.sparkSession)
    langs, prior, weights = model
    matrix = docs.sparkSession.sparkContext.broadcast(weights)  # 2**bits x languages floats
    staged, taken = with_text(kept, docs, text)
    width = len(kept.columns)

    def run(batches):
        w = matrix.value
        for batch in batches:
            column = taken(batch)
            names, scores = np.full(len(column), UNDETERMINED, dtype=object), np.zeros(len(column))
            for lo, texts in text_batches(column):
                known = np.array([bool(langs) and _LETTER.search(x) is not None for x in texts], dtype=bool)
                if known.any():
                    own = [x for x, k in zip(texts, known, strict=True) if k]
                    p = posterior(*summed(own, w), prior)
                    best = p.argmax(axis=1)
                    at = lo + np.flatnonzero(known)
                    names[at], scores[at] = np.array(langs, dtype=object)[best], p[np.arange(len(best)), best]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(names.tolist(), pa.string()), pa.array(scores)],
                                             [*batch.schema.names[:width], "lang_pred", "score"])

    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return staged.mapInArrow(lean(run), schema)


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def fit_on(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The model of labelled documents that are not held out."""
    rest = docs.where(~held_out() & F.col("lang").isNotNull())
    return fit(rest, F.col("text"), F.col("lang"))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_on(docs.select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model) \
        .select("doc_id", "held_out", "lang_pred", "score")
