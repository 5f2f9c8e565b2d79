"""MinHash near-duplicates by one-permutation hashing with optimal densification.

One hash value per shingle serves all bins: its top bits choose the
bin, and a bin keeps its least value.  An empty bin borrows from the bin that a
shared hash of (bin, attempt) points to, again until a full one is met (optimal
densification: Shrivastava, 2017).  Bands of ``ROWS`` bins give the buckets; their
number follows from the similarity asked for.  A bucket yields star-shaped candidate edges: every member with the
bucket's smallest document, so a bucket of n documents gives n - 1 pairs.
Candidates are confirmed on full shingle sets.

A star alone would miss a pair whose members both differ from the centre.  So
the stars' unconfirmed components ("clouds") are kept beside the confirmed ones
("classes"); where a cloud holds several classes, the documents outside its
largest class are compared with all the cloud's documents, block by block, and
confirmed links (one per document and block) are added.  Blocks bound memory;
no pair of documents is emitted unless it is a link.

Missed links: two documents at similarity 0.85 share no bucket with
probability (1 - 0.85**5)**25 < 5e-7, at 0.8 with (1 - 0.8**5)**37 < 5e-7; every other loss is excluded.

Defined results: null, empty and blank texts have an empty set, link with
nothing and stay (component: their own id).  A text with fewer than five words
has one shingle, of all its words.  Equal sets link.  Very long texts are read
whole.  An empty table gives an empty result.  Sets are told apart by a digest, not by the id: different texts under one id (or
under a null id) have a component each, or share one only if links join them.  A component's id is its smallest id, null if it
has none; rows with that id are kept, so rows that agree in id and component are one document that appears as often as
the input has it.  Other columns of the input are not carried.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plantpulse.llm.common import group_by_bytes, lean, ship, small_side, table, write_shared
from plantpulse.llm.graph import connected_components
from plantpulse.llm.kernels import binary_column, distinct_per_row, mix, shingles, word_hashes

ROWS = 5
#: A pair at the least similarity shares no bucket with this probability at most.
MISSED = 5e-7
SHINGLE = 5
#: Least similarity, in hundredths.
PERCENT = 85
#: Documents of a block in the comparison inside clouds.
BLOCK = 256
#: Bytes of texts handled at once.
SLICE = 1 << 20


def bands_for(percent: int) -> int:
    """Bands of ``ROWS`` bins that miss a pair at ``percent`` with probability ``MISSED`` at most (25 at 85, 37 at 80)."""
    return 1 if percent >= 100 else math.ceil(math.log(MISSED) / math.log1p(-(percent / 100) ** ROWS))


@lru_cache
def _bins(bands: int) -> tuple[np.ndarray, np.ndarray]:
    """The least hash of each bin, of which there are enough for ``bands``, and for each
    bin those an empty one tries in turn (the same for all documents)."""
    bits = max(1, (bands * ROWS - 1).bit_length())
    bins = 1 << bits
    tries = 16 * bins
    with np.errstate(over="ignore"):
        x = mix(np.arange(bins * tries, dtype=np.uint64) + np.uint64(0xABCDEF))
    edges = np.arange(bins, dtype=np.uint64) << np.uint64(64 - bits)
    return edges, (x >> np.uint64(64 - bits)).astype(np.int64).reshape(bins, tries)


def signature(values: np.ndarray, bands: int) -> np.ndarray:
    """The densified one-permutation signature of sorted distinct hashes (not empty)."""
    edges, detours = _bins(bands)
    bins = len(edges)
    at = np.searchsorted(values, edges)
    full = np.append(at[1:], len(values)) > at
    out = np.zeros(bins, dtype=np.uint64)
    out[full] = values[at[full]]
    empty = np.flatnonzero(~full)
    if len(empty):
        # the first full bin on each empty bin's detour; should 16 x bins tries fail, the next full bin
        hit = full[detours[empty]]
        first = hit.argmax(axis=1)
        source = detours[empty, first]
        if not hit.any(axis=1).all():
            around = np.flatnonzero(full)
            source = np.where(hit.any(axis=1), source, around[np.searchsorted(around, empty) % len(around)])
        out[empty] = out[source]
    return out


def buckets(values: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit bucket key per band."""
    sig = signature(values, bands)[:bands * ROWS].reshape(bands, ROWS)
    with np.errstate(over="ignore"):
        key = np.arange(1, bands + 1, dtype=np.uint64)
        for j in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, j])
    return key.view(np.int64)


def _sets(batch, column: int):
    """Per row of a batch, the sorted distinct shingle hashes of its text."""
    buf, offsets = binary_column(batch.column(column))
    for lo, hi in group_by_bytes(np.diff(offsets), SLICE):
        h, owner = word_hashes(buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        yield from distinct_per_row(*shingles(h, owner, SHINGLE), hi - lo)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """``doc_id, shingles`` (array<bigint>, distinct) from ``doc_id, text``."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = [x.view(np.int64) for x in _sets(batch, 1)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(
                np.concatenate(found) if found else np.zeros(0, np.int64)))], ["doc_id", "shingles"])

    return _binary(docs).mapInArrow(lean(run), "doc_id bigint, shingles array<bigint>")


def sketches(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, text_hash, n_shingles, digest`` (hash of the whole set; null if empty) and ``keys`` (one per band)."""
    ship(docs.sparkSession)
    bands = bands_for(percent)

    def run(batches):
        for batch in batches:
            n, digest, keys = [], [], []
            for x in _sets(batch, 1):
                n.append(len(x))
                with np.errstate(over="ignore"):
                    low, high = (mix(x + np.uint64(k)).sum(dtype=np.uint64) for k in (1, 2))
                digest.append(low.tobytes() + high.tobytes() if len(x) else None)
                keys.append(buckets(x, bands).tolist() if len(x) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                                              pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "text_hash", "n_shingles", "digest", "keys"])

    return _binary(docs, text_hash()).mapInArrow(lean(run), "doc_id bigint, text_hash bigint, n_shingles bigint, digest binary, keys array<bigint>")


def _binary(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"), *more)


def text_hash() -> Column:
    """What tells texts under one id apart."""
    return F.xxhash64(F.col("text").cast("string")).alias("text_hash")


def alike(both: Column, a: Column, b: Column, percent: int = PERCENT) -> Column:
    """Whether sets of ``a`` and ``b`` elements with ``both`` in common are similar enough."""
    return 100 * both >= percent * (a + b - both)


def links_within(clouds: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links ``u, v`` between different classes of one cloud.

    ``clouds``: ``node, cloud, class`` of clouds with several classes.  The
    documents outside a cloud's largest class meet every document of the cloud
    in pairs of blocks of ``BLOCK`` documents.
    """
    sizes = clouds.groupBy("cloud", "class").count()
    largest = sizes.groupBy("cloud").agg(F.sum("count").alias("size"), F.max(F.struct(F.col("count"), -F.col("class"))).alias("m"))
    rows = clouds.join(largest, "cloud").select(
        "node", "cloud", "class", (F.col("class") != -F.col("m.col2")).alias("outside"),
        F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")) \
        .join(sets.withColumnRenamed("doc_id", "node"), "node")
    # an outside document goes to (own block, every block); any document to (every block with outsiders, own block)
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    left = rows.where("outside").withColumn("other", F.explode(every)).select(
        "cloud", F.col("block").alias("i"), F.col("other").alias("j"), F.lit(True).alias("asks"), "node", "class", "shingles")
    asking = rows.where("outside").select("cloud", F.col("block").alias("i")).distinct()
    right = rows.join(asking, "cloud").select(
        "cloud", "i", F.col("block").alias("j"), F.lit(False).alias("asks"), "node", "class", "shingles")

    def compare(data: pa.Table) -> pa.Table:
        asks = data.column("asks").to_numpy(zero_copy_only=False)
        node, cls = data.column("node").to_numpy(), data.column("class").to_numpy()
        lists = data.column("shingles").combine_chunks()
        at = lists.offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False)
        a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        out = []
        if len(a) and len(b):
            # shingles of the asked documents, sorted, with the place of their owner
            flat = np.concatenate([values[at[j]:at[j + 1]] for j in b])
            owner = np.repeat(np.arange(len(b)), [at[j + 1] - at[j] for j in b])
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            sizes = np.array([at[j + 1] - at[j] for j in b])
            for i in a:
                mine = values[at[i]:at[i + 1]]
                lo, hi = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
                n = hi - lo
                take = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                both = np.bincount(owner[take], minlength=len(b))
                good = (100 * both >= percent * (len(mine) + sizes - both)) & (cls[b] != cls[i])
                # one link per class met
                for c in np.unique(cls[b][good]):
                    out.append((node[i], node[b[np.flatnonzero(good & (cls[b] == c))[0]]]))
        u, v = ([x[k] for x in out] for k in (0, 1))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return left.union(right).groupBy("cloud", "i", "j").applyInArrow(compare, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id, kept`` for every row of ``doc_id, text``."""
    found = write_shared(sketches(docs, percent), "sketches", texts=True)
    # equal sets are one class; a row with its smallest id stands for it
    same = found.where("digest is not null").groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.min_by(F.struct("text_hash", "keys"), F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("x")) \
        .select("digest", "rep", F.col("x.text_hash").alias("th"), F.col("x.keys").alias("keys"))
    reps = write_shared(same, "classes")
    # a class is known by its smallest id, or by a hash of its digest where that id is null or stands for several sets
    shared = write_shared(reps.groupBy("rep").agg(F.count("*").alias("sets")).where("sets > 1 or rep is null").select(F.col("rep").alias("id")), "shared-ids")
    n_shared = shared.count()
    odd = small_side(shared.withColumn("odd", F.lit(True)), n_shared)
    reps = reps.join(odd, F.col("rep").eqNullSafe(F.col("id")), "left") \
        .select("digest", "rep", "th", "keys", F.when(F.col("odd"), F.xxhash64("digest")).otherwise(F.col("rep")).alias("node")) \
        if n_shared else reps.withColumn("node", F.col("rep"))
    keys = reps.select("node", F.explode("keys").alias("key"))
    centers = keys.groupBy("key").agg(F.min("node").alias("center"), F.count("*").alias("c")).where("c > 1").drop("c")
    stars = write_shared(keys.join(centers, "key").where("node <> center").select(F.col("center").alias("u"), F.col("node").alias("v")).distinct(), "stars")
    members = write_shared(stars.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "members")
    n = members.count()
    if n:
        # only documents that share a bucket need their whole sets
        asked = reps.select("node", "rep", "th").join(small_side(members, n), "node")
        rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", text_hash())
        wanted = rows.join(small_side(asked, n), F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("text_hash") == F.col("th"))) \
            .select(F.col("node").alias("doc_id"), "text").dropDuplicates(["doc_id"])
        sets = write_shared(shingle_sets(wanted), "sets", texts=True)
        left = sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("a"))
        right = sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("b"))
        sure = stars.join(left, "u").join(right, "v") \
            .where(alike(F.size(F.array_intersect("a", "b")), F.size("a"), F.size("b"), percent)).select("u", "v")
        sure = write_shared(sure, "confirmed")
        clouds = connected_components(stars).select("node", F.col("component").alias("cloud"))
        classes = connected_components(sure).select("node", F.col("component").alias("class"))
        clouds = write_shared(clouds.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node")), "clouds")
        mixed = clouds.groupBy("cloud").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a <> b").select("cloud")
        open_ = write_shared(clouds.join(mixed, "cloud"), "open")
        more = write_shared(links_within(open_, sets, percent), "more")
        if more.limit(1).count():
            classes = connected_components(classes.select(F.col("node").alias("u"), F.col("class").alias("v")).union(more)) \
                .select("node", F.col("component").alias("class"))
        reps = reps.join(classes, "node", "left").select("digest", "rep", F.coalesce("class", "node").alias("class"))
    else:
        reps = reps.select("digest", "rep", F.col("node").alias("class"))
    if n_shared:  # the smallest node need not be the smallest id
        reps = write_shared(reps, "components")
        reps = reps.join(reps.groupBy("class").agg(F.min("rep").alias("least")), "class").select("digest", F.col("least").alias("component_id"))
    else:
        reps = reps.select("digest", F.col("class").alias("component_id"))
    out = found.drop("keys").join(reps, "digest", "left")
    return out.select("doc_id", "text_hash", "n_shingles", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")) \
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op5_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_hash")


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), g AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4]) END)) AS s
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))
), reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.doc_id
)
SELECT r.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.root) AS component_id, r.doc_id = min(r.root) AS kept
FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id, n.n
"""
