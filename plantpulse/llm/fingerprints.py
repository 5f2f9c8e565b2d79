"""Document fingerprints by winnowing, in SQL expressions only.

A text's words (lower-cased) are hashed; rolling k-grams of five word hashes
are hashed again; in every window of 16 successive k-grams the smallest hash is
chosen, the rightmost on ties, and its position is kept.  Any run of
``window + k - 1`` = 20 words shared by two texts therefore leaves at least one
common fingerprint.  A chosen k-gram is packed in one long: 33 bits of hash
above 30 bits of reversed position, so the smallest long of a window is the
smallest hash and, among equals, the rightmost position.

Defined results: null counts as empty; an empty or blank text has no
fingerprints (the empty string); a text with fewer than five words has one,
of all its words; fewer than 16 k-grams form one window.  Two texts
without fingerprints are alike (1.0); one without and one with are not (0.0).
Equal texts have equal fingerprints.  Repeated rows each give a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plantpulse.llm.common import let, small_side, table, words, write_shared

K = 5
WINDOW = 16
POSITION_BITS = 30
#: Rows that share a window sort when neighbours in id order are brought together.
ROWS_PER_BLOCK = 1_000
QUANTILES = 256


def winnow(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """The packed fingerprints (array<bigint>) of a text in order of position.

    ``window`` is a power of two: minima of 2, 4, 8, ... successive k-grams
    are built from the halves.
    """
    top = F.lit((1 << POSITION_BITS) - 1)

    def packed(h: Column) -> Column:
        n = F.size(h)
        one = F.array(F.xxhash64(h))
        grams = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))),
                            lambda i: F.xxhash64(*[h[i + j] for j in range(k)]))
        return let(F.when(n >= k, grams).when(n > 0, one).otherwise(F.array().cast("array<bigint>")),
                   lambda g: F.transform(g, lambda x, i: F.shiftleft(F.shiftrightunsigned(x, POSITION_BITS + 1), POSITION_BITS)
                                         .bitwiseOR((top - i).cast("bigint"))))

    def chosen(p: Column) -> Column:
        m = F.size(p)

        def doubled(a: Column, step: int) -> Column:
            if step == window:
                return F.array_distinct(a)
            return let(F.transform(F.slice(a, 1, F.size(a) - step), lambda x, i: F.least(x, a[i + step])),
                       lambda b: doubled(b, 2 * step))

        return F.when(m > window, doubled(p, 1)).when(m > 0, F.array(F.array_min(p))).otherwise(p)

    hashes = F.transform(words(F.lower(text)), lambda x: F.xxhash64(x))
    return let(hashes, lambda h: let(packed(h), chosen))


def positions(packed: Column) -> Column:
    """Word positions of packed fingerprints."""
    top = F.lit((1 << POSITION_BITS) - 1)
    return F.transform(packed, lambda x: (top - x.bitwiseAND(top)).cast("int"))


def hash_set(packed: Column) -> Column:
    return F.array_distinct(F.transform(packed, lambda x: F.shiftright(x, POSITION_BITS)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two hash sets; 1.0 when both are empty."""
    return let(F.size(F.array_intersect(a, b)), lambda n: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0))
               .otherwise(n / (F.size(a) + F.size(b) - n)))


def as_text(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda x: F.lower(F.hex(x))), " ")


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input plus ``hashes`` (array<bigint>) and ``positions`` (array<int>), in step."""
    kept = docs.drop(*[c for c in ("hashes", "positions") if c in docs.columns])
    out = kept.withColumn("__p", winnow(F.coalesce(F.col(text), F.lit(""))))
    return out.select(*kept.columns, F.transform("__p", lambda x: F.shiftright(x, POSITION_BITS)).alias("hashes"),
                      positions(F.col("__p")).alias("positions"))


def with_next(docs: DataFrame, key: str = "doc_id", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Rows in blocks of neighbours in descending ``key`` order, each block
    followed by a copy of the next block's first row (``guest`` = true).

    Blocks are ranges of the key: quantiles, each cut evenly by its row count.
    Only key ranges travel through the driver (``QUANTILES`` numbers); the
    rows are shuffled once.  Rows without a key come last, in one block of their own.  The last block is followed by the very first row.
    """
    keys = docs.select(F.col(key).cast("bigint").alias("k")).where(F.col("k").isNotNull())
    n, low, high = keys.agg(F.count("*"), F.min("k"), F.max("k")).first()
    n, low, high = (n, low, high) if n else (1, 0, 0)  # no key at all: one block
    q = max(1, min(QUANTILES, n // rows_per_block))
    cut = keys.agg(F.percentile_approx("k", [i / q for i in range(1, q)], 10 * QUANTILES)).first()[0] if q > 1 else []
    edges = sorted({low, *cut})
    rows = max(1, n // len(edges))
    width = [max(1, ((edges + [high + 1])[i + 1] - e) * rows_per_block // rows) for i, e in enumerate(edges)]
    cuts = F.array(*[F.lit(e).cast("bigint") for e in edges])
    block = lambda k: F.size(F.filter(cuts, lambda x: x <= k)) - 1
    widths = F.array(*[F.lit(x).cast("bigint") for x in width])

    def placed(df: DataFrame) -> DataFrame:
        k = F.col(key).cast("bigint")
        df = df.withColumn("block", F.coalesce(block(k), F.lit(-1)).cast("bigint"))
        at = F.greatest(F.col("block"), F.lit(0)).cast("int")
        return df.withColumn("part", F.coalesce(F.floor((k - cuts[at]) / widths[at]), F.lit(0)).cast("bigint"))

    heads = write_shared(placed(docs.select(key)).groupBy("block", "part").agg(F.max(key).alias("head")), "heads")
    in_block = Window.partitionBy("block").orderBy(F.desc("part"))
    # a block of parts is followed by the highest part of the next lower block
    first = {r["block"]: r["part"] for r in heads.groupBy("block").agg(F.min("part").alias("part")).collect()}
    order = sorted(first, reverse=True)
    before = {b: order[i - 1] for i, b in enumerate(order)}  # of the first block: the last one
    prior = F.lit(None).cast("map<bigint,struct<block:bigint,part:bigint>>") if not order else F.create_map(*[x for b in order for x in (F.lit(b), F.struct(F.lit(before[b]).alias("block"), F.lit(first[before[b]]).alias("part")))])
    to = heads.select("block", "part", "head", F.coalesce(
        F.lag(F.struct("block", "part")).over(in_block), prior[F.col("block")]).alias("to"))
    spread = placed(docs).join(small_side(to, heads.count()), ["block", "part"])
    own = F.struct("block", "part", F.lit(False).alias("guest"))
    guest = F.struct(F.col("to.block").alias("block"), F.col("to.part").alias("part"), F.lit(True).alias("guest"))
    is_head = F.coalesce(F.col(key) == F.col("head"), F.col("head").isNull())
    return spread.withColumn("at", F.explode(F.when(is_head, F.array(own, guest)).otherwise(F.array(own)))) \
        .select(*docs.columns, "at.block", "at.part", "at.guest")


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    near = with_next(docs)
    order = Window.partitionBy("block", "part").orderBy(
        F.col("guest"), F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    out = near.withColumn("next_text", F.lead("text").over(order)) \
        .withColumn("n_chars", n.cast("bigint")) \
        .withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half),
                                       F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))) \
        .withColumn("p", winnow(F.col("text"))) \
        .withColumn("edited_p", F.when(F.col("guest"), F.lit(None)).otherwise(winnow(F.col("edited")))) \
        .withColumn("edited_sha256", F.sha2("edited", 256)) \
        .withColumn("s", hash_set(F.col("p"))) \
        .withColumn("edited_s", hash_set(F.col("edited_p"))) \
        .withColumn("next_s", F.lead("s").over(order))
    return out.where(~F.col("guest")).select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("p")).alias("fingerprint"),
        as_text(F.col("edited_p")).alias("edited_fingerprint"),
        likeness(F.col("s"), F.col("edited_s")).alias("near_edited"),
        likeness(F.col("s"), F.col("next_s")).alias("near_next"))
