"""Packing documents into padded, token-budgeted batches with optimal length buckets.

Documents longer than ``max_len`` tokens are cut into pieces of that length, so
the histogram of piece lengths has at most ``max_len`` entries whatever the
corpus.  A dynamic program over the whole corpus's histogram chooses ``n_buckets``
boundaries that minimise padding.  Inside a bucket, pieces are ordered by
length, document and piece; successive runs of ``budget // boundary`` pieces form
the batches, so a padded batch never exceeds the token budget.

Defined results: a document without tokens (null or blank) gives one row with
length 0 and null bucket, padded_len and batch_id.  Repeated rows each get their place (their
order among equals is arbitrary but their count is kept).  An empty table gives
an empty result.  Other columns of the input are not carried.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from plantpulse.llm.common import table, words, write_shared

MAX_LEN = 1024
N_BUCKETS = 16
BUDGET = 16_384
#: Ids per block when pieces of one length are numbered.
BLOCK_IDS = 1 << 12


def optimal_boundaries(histogram: dict[int, int], n_buckets: int = N_BUCKETS) -> list[int]:
    """Upper bounds (ascending; the last is the longest length) with least padding.

    ``cost(i, j)``: pieces with lengths in (l_i, l_j] padded to l_j.  Exact
    dynamic program, ``n_buckets * m**2`` steps over m <= max_len lengths.
    """
    lengths = np.array(sorted(histogram), dtype=np.int64)
    m = len(lengths)
    if m <= n_buckets:
        return lengths.tolist()
    counts = np.array([histogram[x] for x in lengths.tolist()], dtype=np.float64)
    c, t = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    best = np.full(m + 1, np.inf)
    best[0] = 0
    came = []
    for _ in range(n_buckets):
        now, at = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=np.int64)
        now[0] = 0
        for j in range(1, m + 1):
            total = best[:j] + lengths[j - 1] * (c[j] - c[:j]) - (t[j] - t[:j])
            at[j] = int(np.argmin(total))
            now[j] = total[at[j]]
        came.append(at)
        best = now
    bounds, j = [], m
    for at in reversed(came):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(at[j])
    return bounds[::-1]


def pieces(lengths: DataFrame, max_len: int) -> DataFrame:
    """``doc_id, piece, start, length`` from ``doc_id, n_tokens``."""
    n = F.col("n_tokens")
    cuts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(n / max_len) - 1, F.lit(0)).cast("bigint"))
    return lengths.select("doc_id", "n_tokens", F.posexplode(cuts).alias("piece", "k")) \
        .select("doc_id", F.col("piece").cast("bigint").alias("piece"), (F.col("k") * max_len).alias("start"),
                F.least(n - F.col("k") * max_len, F.lit(max_len)).cast("bigint").alias("length"))


def pack(docs: DataFrame, n_tokens: Column, max_len: int = MAX_LEN, n_buckets: int = N_BUCKETS,
         budget: int = BUDGET) -> DataFrame:
    """``doc_id, piece, start, length, bucket, padded_len, batch_id``; see the module."""
    if not 0 < max_len <= budget:
        raise ValueError("max_len must be positive and fit the token budget")
    rows = write_shared(pieces(docs.select("doc_id", F.coalesce(n_tokens, F.lit(0)).cast("bigint").alias("n_tokens")), max_len), "pieces")
    histogram = {r["length"]: r["count"] for r in rows.where("length > 0").groupBy("length").count().collect()}  # <= max_len rows
    bounds = optimal_boundaries(histogram, n_buckets)
    if not bounds:
        return rows.select("*", *[F.lit(None).cast("bigint").alias(c) for c in ("bucket", "padded_len", "batch_id")])
    # of each length: its bucket, and how many pieces stand before it there
    plan, before = [], 0
    for x in sorted(histogram):
        b = int(np.searchsorted(bounds, x))
        if plan and plan[-1][1] != b:
            before = 0
        plan.append((x, b, bounds[b], before))
        before += histogram[x]
    plan = docs.sparkSession.createDataFrame(plan, "length bigint, bucket bigint, padded_len bigint, before bigint")
    plan = F.broadcast(plan)  # max_len rows at most
    # rank within a length: rows of earlier id blocks, then the row number inside the block
    block = F.floor(F.coalesce(F.col("doc_id"), F.lit(0)) / BLOCK_IDS).alias("block")
    rows = rows.withColumn("block", block)
    per_block = rows.where("length > 0").groupBy("length", "block").count()
    earlier = per_block.withColumn("earlier", F.coalesce(F.sum("count").over(
        Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    own = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece"))
    placed = rows.where("length > 0").withColumn("own", own).join(earlier, ["length", "block"]).join(plan, "length") \
        .withColumn("batch_id", F.floor((F.col("before") + F.col("earlier") + F.col("own") - 1)
                                        / F.floor(F.lit(budget) / F.col("padded_len"))).cast("bigint"))
    columns = ["doc_id", "piece", "start", "length", "bucket", "padded_len", "batch_id"]
    none = rows.where("length = 0").select("doc_id", "piece", "start", "length",
                                           *[F.lit(None).cast("bigint").alias(c) for c in columns[4:]])
    return placed.select(*columns).union(none)


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """Packs all documents; a token is a word."""
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), n_words(F.col("text")))
