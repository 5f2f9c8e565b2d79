"""Line dedup: an edit-distance join by segment partition, then one line of each class stays.

Two lines are near when few edits part them: one for every ``EDIT_CHARS`` characters of
the shorter line, at least one and at most ``MAX_EDITS``.  The shorter line (``l`` characters,
``e`` edits) is cut into ``e + 1`` segments, of which one must stand unchanged in
the longer one.  So each line enters an index under (length, segment number,
segment) and probes it, for every length it may meet, with the substrings at the positions
that the remaining edits allow.  Only probes that a bit table of all index keys lets through
become rows; the table is of bounded size and drops no key of the index.
An exact check by banded bit-parallel edit distance follows.

Where one segment is shared by very many lines (a template), the group is not
paired up.  Its lines agree on the segment, so the parts beside it must agree within what is left
of the edits, and the same cut is made again inside the longest part:
the key grows, the group falls apart, and no link is lost.  This repeats until groups
are small or no part is longer than its edits.  ``dedup_lines`` first checks the earliest lines of
each large group against all others of the group.  Lines decided by that leave it, and only what is still large is cut.

A pair costs a join with both texts, so pairs are first held against sketches of either line: 16
counts of characters, and which of 128 classes of neighbouring characters are odd in number.  An edit changes
the counts by two and the classes by four at most, so pairs whose sketches
are further apart than the edits allow are no links.

A line is removed if, and only if, a checked link leads to an earlier line that stays: no two lines that stay are near.
Rounds settle which: a line stays when all pairs it may be in are checked and none of its undecided
neighbours comes before it, and its neighbours go.  Lines come in the order of their first occurrence
(smallest document, then text hash and line number); of equal lines the first occurrence stays.
Links between lines that both go decide nothing, so a large group of near copies is not paired up.

Defined results: lines are split at ``\\n``; lines without a word are never
removed, and lines under ``min_chars`` characters match exactly only.  Equality is of
the lines' 64-bit hashes.  Null texts stay null, with 0 lines; an empty table gives an empty result; very long texts and lines are
read whole.  Decisions belong to a document's id and text together: rows that agree in both share them, different texts
under one id (or under a null id) do not.  Ids that are null come first.  Other columns are kept.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from plantpulse.llm.common import drop_shared, forget_shuffles, lean, let, ship, small_side, table, write_shared
from plantpulse.llm.graph import connected_components
from plantpulse.llm.kernels import CharHashes, mix

MAX_EDITS = 5
#: A line may differ in one edit for every so many characters (one edit at least).
EDIT_CHARS = 20
#: Lines this long also match within the edits.
MIN_CHARS = 20
#: Pairs that a group of lines with a common key may give before it is cut again.
GROUP_PAIRS = 4_096
#: Up to so many texts of candidate lines are broadcast to the checks.
BROADCAST_LINES = 100_000
#: The table of index keys has 2 to this many words of 64 bits (32 MB).
WORD_BITS = 22
#: Characters of lines whose keys are made at once.
SLICE = 1 << 17
#: Lines that a task knows as seen before it starts anew.
SEEN = 200_000
#: Rows of large groups that are made before they leave the worker.
REFINED_ROWS = 20_000
_MASK, _SPAN = (1 << 64) - 1, 32
#: What ``dedup_lines`` adds.
LINE_COLUMNS = ("n_lines", "n_removed", "n_near")
SKETCH = {"sketch": "bigint", "low": "bigint", "high": "bigint", "may": "int", "place": "bigint"}
ROW = f"key bigint, id bigint, probe boolean, gaps array<int>, sketch struct<{','.join(f'{n}:{t}' for n, t in SKETCH.items())}>"
#: Counts modulo 8 as four bits each, of which as many differ as the counts do (round the circle).
_CIRCLE = np.array([0, 1, 3, 7, 15, 14, 12, 8], dtype=np.uint64)


def line_id(line: str) -> int:
    """The 64-bit id of a line; equals SQL's ``xxhash64(line)``."""
    return _signed(xxhash.xxh64_intdigest(line.encode("utf-8", "replace"), 42))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _common(a: str, b: str) -> int:
    """Length of the common prefix, by halving."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def within(a: str, b: str, k: int) -> bool:
    """Whether ``a`` and ``b`` are at most ``k`` edits apart.

    Bit ``o + k`` of ``reach[e]`` says that ``e`` edits lead to offset ``o`` between
    the two readings; only the ``2k + 1`` offsets of the band exist.  Where a character of ``b`` meets
    its like in ``a`` is read from bit masks, made for ``_SPAN`` characters at a time.
    """
    if abs(len(a) - len(b)) > k:
        return False
    lo = _common(a, b)
    a, b = a[lo:], b[lo:]
    cut = _common(a[::-1], b[::-1])
    a, b = a[:len(a) - cut], b[:len(b) - cut]
    m, band = len(a), (1 << (2 * k + 1)) - 1
    reach = [1 << k]
    for _ in range(k):
        reach.append((reach[-1] | reach[-1] << 1) & band)
    for start in range(0, len(b), _SPAN):
        where: dict[str, int] = {}
        for i in range(max(0, start - k), min(m, start + _SPAN + k)):
            where[a[i]] = where.get(a[i], 0) | 1 << (i - start + 2 * k)
        for j, c in enumerate(b[start:start + _SPAN]):
            same = where.get(c, 0) >> (j + k) & band  # bit o + k: a[start + j + o] == c
            last = fresh = reach[0] & same
            out = [fresh]
            for e in range(1, k + 1):
                # a match, a character of b inserted, one replaced, one of a left out
                last = ((reach[e] & same) | reach[e - 1] >> 1 | reach[e - 1] | last << 1) & band
                out.append(last)
            reach = out
            if not reach[k]:
                return False
    return bool(reach[k] >> (m - len(b) + k) & 1)


def _codes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all lines and the line of each."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "replace"), dtype=np.uint32)
    return codes, np.repeat(np.arange(len(lines)), [len(x) for x in lines])


def sketches(lines: list[str]) -> np.ndarray:
    """Per line, 16 counts (modulo 8) of its characters by code, in the bits of one number."""
    codes, owner = _codes(lines)
    bucket = (codes * np.uint32(0x9E3779B1)) >> np.uint32(28)
    counts = np.bincount(owner * 16 + bucket, minlength=16 * len(lines)).reshape(-1, 16) & 7
    return np.bitwise_or.reduce(_CIRCLE[counts] << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=1).view(np.int64)


def pair_sketches(lines: list[str]) -> np.ndarray:
    """Per line, whether each of 128 classes of two neighbouring characters is odd in number, as two numbers."""
    codes, owner = _codes(lines)
    with np.errstate(over="ignore"):
        bucket = (mix(codes[:-1].astype(np.uint64) << np.uint64(32) | codes[1:].astype(np.uint64)) >> np.uint64(57)).astype(np.int64)
    inside = owner[:-1] == owner[1:]
    odd = np.bincount(owner[:-1][inside] * 128 + bucket[inside], minlength=128 * len(lines)).reshape(-1, 2, 64).astype(np.uint64) & np.uint64(1)
    return np.bitwise_or.reduce(odd << np.arange(64, dtype=np.uint64), axis=2).view(np.int64)


def sketch_distance(a: Column, b: Column) -> Column:
    """Bits that differ: of :func:`sketches` two for an edit at most, of both :func:`pair_sketches` four together."""
    return F.bit_count(a.bitwiseXOR(b))


def may_be_near(p: str, q: str) -> Column:
    """Whether the lines of two structs of sketches may be as near as the shorter one allows."""
    edits = F.least(f"{p}.may", f"{q}.may")
    apart = {n: sketch_distance(F.col(f"{p}.{n}"), F.col(f"{q}.{n}")) for n in ("sketch", "low", "high")}
    return (apart["low"] + apart["high"] <= 4 * edits) & (apart["sketch"] <= 2 * edits)


def cut_gap(key: int, gaps: tuple, line: str, probe: bool):
    """Keys one level down, as ``(key, gaps)``; none when no gap can be cut.

    A gap ``(s_lo, s_hi, edits, t_lo, t_hi)`` is a part that still differs: where
    it lies in the indexed line and in the probing one, and how many edits it may hold.
    The choice of the gap looks at the indexed side only, so both sides make it alike.
    """
    best = max(range(len(gaps)), key=lambda g: (gaps[g][1] - gaps[g][0] if gaps[g][1] - gaps[g][0] > gaps[g][2] else 0, -g), default=None)
    if best is None or gaps[best][1] - gaps[best][0] <= gaps[best][2]:
        return
    s_lo, s_hi, e, t_lo, t_hi = gaps[best]
    n = s_hi - s_lo
    for i in range(e + 1):
        a, b = s_lo + n * i // (e + 1), s_lo + n * (i + 1) // (e + 1)
        size, before, behind = b - a, a - s_lo, s_hi - b
        if probe:
            # i edits at most before the segment, the rest behind it
            places = range(max(t_lo, t_lo + before - i, t_hi - size - behind - (e - i)),
                           min(t_hi - size, t_lo + before + i, t_hi - size - behind + (e - i)) + 1)
        else:
            places = (a,)
        for p in places:
            left = ((s_lo, a, i, t_lo, p if probe else a),) if i else ()
            right = ((b, s_hi, e - i, p + size if probe else b, t_hi if probe else s_hi),) if e - i else ()
            down = xxhash.xxh3_64_intdigest(line[p:p + size].encode("utf-8", "replace"), (key * 1_000_003 + best * 64 + i) & _MASK)
            yield down, gaps[:best] + left + right + gaps[best + 1:]


def allowed(n: int, k: int, per: int) -> int:
    """The edits that a line of ``n`` characters may hold; ``per`` 0 allows ``k`` at any length."""
    return min(k, max(1, n // per)) if per else k


@lru_cache(4096)
def _places(n: int, k: int, per: int, least: int) -> tuple[np.ndarray, int]:
    """Columns ``length, segment, place, end, seed`` of all that a line of ``n`` characters asks for
    (``length`` and ``segment`` are the indexed line's), and how many of them, the first, are its own segments."""
    own, other = [], []
    for size in range(n, max(least, n - k) - 1, -1):
        e = allowed(size, k, per)
        d = n - size
        if d > e:
            continue
        for i in range(e + 1):
            a, b = size * i // (e + 1), size * (i + 1) // (e + 1)
            # i edits at most before the segment, the rest behind it
            for p in range(max(0, a - i, a + d - (e - i)), min(n - (b - a), a + i, a + d + (e - i)) + 1):
                (own if not d and p == a else other).append((size, i, p, p + b - a))
    out = np.array(own + other, dtype=np.int64).T
    with np.errstate(over="ignore"):
        seed = mix(out[0].astype(np.uint64) * np.uint64(1_000_003) + out[1].astype(np.uint64))
    return np.concatenate([out, seed.view(np.int64)[None]]), len(own)


def line_keys(lines: list[str], k: int, per: int, least: int, own: bool | None = None):
    """``keys, owner`` of what each line asks for: its own segments (index entries), the other probes, or all (None)."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "replace"), dtype=np.uint32)
    hashes = CharHashes(codes)
    sizes = np.array([len(x) for x in lines])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    tables = []
    for n in sizes.tolist():
        asked, first = _places(n, k, per, least)
        tables.append(asked[2:] if own is None else asked[2:, :first] if own else asked[2:, first:])
    owner = np.repeat(np.arange(len(lines)), [x.shape[1] for x in tables])
    place, end, seed = np.concatenate(tables, axis=1)
    at = starts[owner]
    return mix(hashes.of(place + at, end + at) ^ seed.view(np.uint64)).view(np.int64), owner


def first_gaps(line: str, key: int, probe: bool, k: int, per: int, least: int) -> list[tuple]:
    """The gaps of every alignment that gives ``line`` the first-level ``key``."""
    n, out = len(line), []
    asked, own = _places(n, k, per, least)
    keys, _ = line_keys([line], k, per, least)
    for j in np.flatnonzero(keys == key).tolist():
        if not probe and j >= own:
            continue
        size, i, p, end, _ = asked[:, j].tolist()
        e = allowed(size, k, per)
        a, b = size * i // (e + 1), size * (i + 1) // (e + 1)
        out.append((((0, a, i, 0, p),) if i else ()) + (((b, size, e - i, end, n),) if e - i else ()))
    return out


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([_signed(r[0]) for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
        pa.array([r[2] for r in rows], pa.bool_()), pa.array([[x for g in r[3] for x in g] for r in rows], pa.list_(pa.int32())), pa.array([r[4] for r in rows], pa.struct([(n, pa.int32() if t == "int" else pa.int64()) for n, t in SKETCH.items()]))],
        ["key", "id", "probe", "gaps", "sketch"])


def key_rows(docs: DataFrame, k: int, per: int, least: int, bits=None) -> DataFrame:
    """``key, id`` of all lines that may match within edits: their index entries, or, where ``bits``
    (the broadcast table of the index keys) is given, the other probes that may find one."""

    def slices(batch, seen):
        """New lines and their ids, of ``SLICE`` characters together at most (one line at least)."""
        lines, ids, total = [], [], 0
        for text in batch.column(0):
            for line in text.as_py().decode("utf-8", "replace").split("\n"):
                if len(line) < least:
                    continue
                own = line_id(line)
                if own in seen or not line.strip(" \t\n\x0b\x0c\r"):
                    continue
                seen.add(own)
                if lines and total + len(line) > SLICE:
                    yield lines, ids
                    lines, ids, total = [], [], 0
                lines.append(line)
                ids.append(own)
                total += len(line)
            if len(seen) >= SEEN:
                seen.clear()
        if lines:
            yield lines, ids

    def run(batches):
        words = None if bits is None else bits.value
        seen = set()
        for batch in batches:
            for lines, ids in slices(batch, seen):
                keys, owner = line_keys(lines, k, per, least, words is None)
                if words is not None:
                    u = keys.view(np.uint64)
                    one = np.uint64(1)
                    mask = one << (u & np.uint64(63)) | one << (u >> np.uint64(6) & np.uint64(63))
                    hit = words[u >> np.uint64(64 - WORD_BITS)] & mask == mask
                    keys, owner = keys[hit], owner[hit]
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.array(ids, dtype=np.int64)[owner])], ["key", "id"])

    return docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).mapInArrow(lean(run), "key bigint, id bigint")


def key_bits(keys: DataFrame) -> np.ndarray:
    """Two bits for every key, in a word that its first bits choose."""
    found = keys.groupBy(F.expr(f"shiftrightunsigned(key, {64 - WORD_BITS})").alias("w")) \
        .agg(F.expr("bit_or(shiftleft(1L, cast(key & 63 as int)) | shiftleft(1L, cast(shiftrightunsigned(key, 6) & 63 as int)))").alias("m")).toArrow()
    words = np.zeros(1 << WORD_BITS, dtype=np.uint64)
    words[found.column("w").to_numpy()] = found.column("m").to_numpy().view(np.uint64)
    return words


def refined(rows: DataFrame, texts: DataFrame, k: int, per: int, least: int) -> DataFrame:
    """The rows of large groups one level further down."""

    def run(batches):
        for batch in batches:
            out = []
            for key, own, probe, gaps, sketch, line in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if gaps is None:  # of the first level: found again from the line
                    found = first_gaps(line, key, probe, k, per, least)
                else:
                    found = [tuple(tuple(gaps[i:i + 5]) for i in range(0, len(gaps), 5))]
                for g in found:
                    out += [(x, own, probe, down, sketch) for x, down in cut_gap(key & _MASK, g, line, probe)]
                if len(out) >= REFINED_ROWS:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    return rows.join(texts.select("id", "line"), "id").select("key", "id", "probe", "gaps", "sketch", "line").mapInArrow(lean(run), ROW).distinct()


def _splittable(gaps: Column) -> Column:
    """Whether some part is longer than its edits, so that it can be cut."""
    n = F.coalesce(F.size(gaps), F.lit(-1))
    at = F.transform(F.sequence(F.lit(0), F.greatest(n / 5 - 1, F.lit(0)).cast("int")), lambda i: i * 5)
    return gaps.isNull() | ((n > 0) & F.exists(at, lambda i: gaps[i + 1] - gaps[i] > gaps[i + 2]))


def _narrow(gaps: Column) -> Column:
    """Whether no part is longer than its edits on the probing side either."""
    at = F.sequence(F.lit(0), F.greatest(F.size(gaps) - 5, F.lit(0)), F.lit(5))
    return (F.size(gaps) == 0) | ~F.exists(at, lambda i: F.get(gaps, i + 4) - F.get(gaps, i + 3) > F.get(gaps, i + 2))


def _candidates(docs: DataFrame, k: int, per: int, least: int):
    """Index entries and probes (:data:`ROW`) of the keys where lines meet, and their ``id, line`` and :data:`SKETCH`,
    both written, and how many lines these are.  ``place`` is a line's place in the order of first occurrences, if ``docs`` has a ``doc_id``."""
    spark = docs.sparkSession
    ship(spark)
    entries = write_shared(key_rows(docs, k, per, least), "line-index", texts=True)
    bits = spark.sparkContext.broadcast(key_bits(entries))
    forget_shuffles(spark)
    probes = write_shared(key_rows(docs, k, per, least, bits), "line-probes", texts=True)
    bits.destroy()
    all_rows = entries.withColumn("probe", F.lit(False)).union(probes.withColumn("probe", F.lit(True)))
    # keys where an index entry and another line meet; most lines have none
    shared = write_shared(all_rows.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.min("probe").alias("p"))
                          .where("a <> b and not p").select("key"), "line-keys")
    forget_shuffles(spark)
    rows = all_rows.join(small_side(shared, shared.count()), "key")
    # an index entry is a probe as well
    both = F.explode(F.when(F.col("probe"), F.array(F.lit(True))).otherwise(F.array(F.lit(False), F.lit(True))))
    rows = write_shared(rows.select("key", "id", both.alias("probe")).distinct()
                        .withColumn("gaps", F.lit(None).cast("array<int>")), "line-rows")
    drop_shared(entries, probes, shared)
    ids = write_shared(rows.select("id").distinct(), "line-ids")
    n_ids = ids.count()
    ordered = "doc_id" in docs.columns
    at = F.struct("doc_id", "th", "line_no") if ordered else F.lit(0)
    # hashed before the lines are laid out: beside them, a text would be hashed for each of its lines
    texts = docs.select("*", F.xxhash64("text").alias("th")).select("*", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("id", F.xxhash64("line")) \
        .select("id", "line", at.alias("own")).join(small_side(ids, n_ids), "id").groupBy("id").agg(F.first("line").alias("line"), F.min("own").alias("own"))
    # sorted rows are numbered upwards
    place = F.monotonically_increasing_id() if ordered else F.col("id")
    texts = (texts.orderBy("own") if ordered else texts).select("id", "line", place.alias("place"))

    def with_sketch(batches):
        for batch in batches:
            lines = batch.column(1).to_pylist()
            may = pa.array([allowed(len(x), k, per) for x in lines], pa.int32())
            low, high = pair_sketches(lines).T
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sketches(lines)), pa.array(low), pa.array(high), may, batch.column(2)],
                                             ["id", "line", *SKETCH])

    texts = write_shared(texts.mapInArrow(lean(with_sketch), "id bigint, line string, " + ", ".join(f"{n} {t}" for n, t in SKETCH.items())), "line-texts")
    bare, rows = rows, write_shared(rows.join(small_side(texts.select("id", F.struct(*SKETCH).alias("sketch")), n_ids), "id"), "line-rows")
    drop_shared(bare, ids)
    forget_shuffles(spark)
    return rows, texts, n_ids


def _few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, whose rows may be wide, with a broadcast hint when there are few."""
    return F.broadcast(df) if rows <= BROADCAST_LINES else df


def _checked(pairs: DataFrame, texts: DataFrame, n_ids: int, k: int, per: int) -> DataFrame:
    """Those of the pairs ``x, p, y, q`` (ids and sketches) that are links, as ``u, v`` with the earlier line first; written."""

    def verify(batches):
        for batch in batches:
            keep = [within(a, b, allowed(min(len(a), len(b)), k, per)) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    before = F.col("p.place") < F.col("q.place")
    found = pairs.where("x <> y").where(may_be_near("p", "q")) \
        .select(F.when(before, F.col("x")).otherwise(F.col("y")).alias("u"), F.when(before, F.col("y")).otherwise(F.col("x")).alias("v")).distinct()
    # the checks cost much more than the few bytes of a pair, by which adaptive execution would put them into one task
    found = found.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lines = _few(texts, n_ids)
    both = found.join(lines.select(F.col("id").alias("u"), F.col("line").alias("a")), "u") \
        .join(lines.select(F.col("id").alias("v"), F.col("line").alias("b")), "v").select("u", "v", "a", "b")
    return write_shared(both.mapInArrow(lean(verify), "u bigint, v bigint"), "line-links")


def _all_pairs(member: DataFrame, asking: DataFrame) -> DataFrame:
    """Pairs of index entries and probes with a common key."""
    return member.where("not probe").select("key", F.col("id").alias("x"), F.col("sketch").alias("p")) \
        .join(asking.select("key", F.col("id").alias("y"), F.col("sketch").alias("q")), "key").select("x", "p", "y", "q")


def _star_pairs(member: DataFrame) -> DataFrame:
    """Pairs of the ``centers`` of a group and its lines."""
    return member.select(F.explode("centers").alias("c"), F.col("id").alias("y"), F.col("sketch").alias("q")) \
        .select(F.col("c.id").alias("x"), F.col("c.sketch").alias("p"), "y", "q")


def _group_sizes() -> list[Column]:
    return [F.sum(F.when(F.col("probe"), 0).otherwise(1)).alias("s"), F.sum(F.when(F.col("probe"), 1).otherwise(0)).alias("t")]


def near_lines(docs: DataFrame, k: int = MAX_EDITS, min_chars: int = MIN_CHARS, per: int = 0, stars: bool = False) -> DataFrame:
    """Links ``u, v`` between ids of different lines at most ``allowed(shorter length, k, per)`` edits apart:
    all of them, or with ``stars`` enough to connect the same lines."""
    spark = docs.sparkSession
    least = max(min_chars, k + 1)
    rows, texts, n_ids = _candidates(docs.select("text"), k, per, least)

    def with_class(df, links):
        """``df`` with the ``class`` of its ``id``: what ``links`` join with ``stars``, else the id."""
        if links is None or not stars:
            return df.withColumn("class", F.col("id"))
        classes = write_shared(connected_components(links), "line-classes")
        return df.join(classes.withColumnRenamed("node", "id"), "id", "left").withColumn("class", F.coalesce("component", "id")).drop("component")

    links = None
    while True:
        ids_of = F.when(~F.col("probe"), F.struct("id", "sketch"))
        sizes = with_class(rows, links).groupBy("key").agg(
            *_group_sizes(),
            F.max(_splittable(F.col("gaps"))).alias("more"), F.min("class").alias("a"), F.max("class").alias("b"),
            F.array_distinct(F.array(F.min(ids_of), F.max(ids_of))).alias("centers")) \
            .where("s > 0 and t > 0 and a <> b").withColumn("many", F.col("s") * F.col("t") > GROUP_PAIRS)
        sizes = write_shared(sizes.select("key", (F.col("many") & F.col("more")).alias("large"),
                                          (F.col("many") & F.lit(stars)).alias("star"), "centers"), "line-groups")
        member = rows.join(sizes, "key")
        found = _all_pairs(member.where("not large"), member.where("probe and not large").where(~F.col("star") | ~_narrow(F.col("gaps"))))
        if stars:
            # index entries of a last group are all near each other
            found = found.union(_star_pairs(member.where("star")))
        sure = _checked(found, texts, n_ids, k, per)
        links = sure if links is None else links.union(sure)
        large = sizes.where("large").select("key")
        if not large.limit(1).count():
            break
        # groups whose lines are all connected by now need no further cut
        again = with_class(rows.join(large, "key"), links).groupBy("key").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a <> b")
        spent, rows = rows, write_shared(refined(rows.join(again.select("key"), "key"), texts, k, per, least), "line-rows")
        drop_shared(spent, sizes)
        forget_shuffles(spark)
    done = write_shared(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "line-links")
    drop_shared(links, rows, sizes, texts)
    forget_shuffles(spark)
    return done


def settled(links: DataFrame, waiting: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """The links (earlier line ``u``, later line ``v``) that are still open, and the ``id`` of the lines that go (None: no line).

    A line of ``waiting`` (``id``) may have links not found yet, so it does not stay for the time being.
    """
    gone = None
    n = links.count()
    held = None
    if n and waiting is not None:
        held = write_shared(waiting.join(small_side(links.select(F.col("u").alias("id")).distinct(), n), "id", "left_semi").distinct(), "line-held")
    while n:
        # lines with no undecided neighbour before them stay; their neighbours go
        stay = links.select("u").distinct().join(small_side(links.select(F.col("v").alias("u")), n), "u", "left_anti")
        if held is not None:
            stay = stay.join(small_side(held.select(F.col("id").alias("u")), n), "u", "left_anti")
        out = write_shared(links.join(small_side(stay, n), "u", "left_semi").select(F.col("v").alias("id")).distinct(), "line-gone")
        n_out = out.count()
        if not n_out:
            break
        gone = out if gone is None else gone.union(out)
        spent, links = links, write_shared(links.join(small_side(out.select(F.col("id").alias("u")), n_out), "u", "left_anti")
                                           .join(small_side(out.select(F.col("id").alias("v")), n_out), "v", "left_anti").select("u", "v"), "line-open")
        drop_shared(spent)
        n = links.count()
    if held is not None:
        drop_shared(held)
    return links, gone


def near_copies(docs: DataFrame, k: int = MAX_EDITS, min_chars: int = MIN_CHARS, per: int = EDIT_CHARS) -> DataFrame:
    """``id`` of the lines of ``docs`` (``doc_id, text``) that are near an earlier line that stays."""
    spark = docs.sparkSession
    least = max(min_chars, k + 1)
    rows, texts, n_ids = _candidates(docs.select("doc_id", "text"), k, per, least)
    gone = spark.createDataFrame([], "id bigint")
    links = None
    while True:
        # large groups alone are looked up: the earliest line and the earliest index entry are their centers
        place = F.col("sketch.place")
        sizes = write_shared(rows.groupBy("key").agg(
            *_group_sizes(), F.max(_splittable(F.col("gaps"))).alias("cut"), F.min("id").alias("a"), F.max("id").alias("b"),
            F.min(place).alias("first"), F.min(F.when(~F.col("probe"), place)).alias("entry"))
            .where("a <> b").where(F.col("s") * F.col("t") > GROUP_PAIRS).select("key", "cut", "first", "entry"), "line-groups")
        n_large = sizes.count()
        small = rows.join(_few(sizes.select("key"), n_large), "key", "left_anti") if n_large else rows
        pairs = _all_pairs(small, small.where("probe"))
        if n_large:
            large = rows.join(_few(sizes, n_large), "key")
            heads = sizes.select("key", F.explode(F.array_distinct(F.array("first", "entry"))).alias("place"))
            heads = texts.select(F.col("id").alias("x"), F.struct(*SKETCH).alias("p"), "place").join(_few(heads, 2 * n_large), "place").select("key", "x", "p")
            pairs = pairs.union(rows.select("key", F.col("id").alias("y"), F.col("sketch").alias("q"))
                                .join(_few(heads, 2 * n_large), "key").select("x", "p", "y", "q"))
        sure = _checked(pairs, texts, n_ids, k, per)
        links = sure if links is None else links.union(sure)
        # pairs of the centers are done; the others of a large group wait
        left = None
        if n_large:
            left = write_shared(large.where((place != F.col("first")) & (place != F.col("entry"))).select("key", "id", "probe", "gaps", "sketch", "cut"), "line-left")
        waits = left is not None and left.limit(1).count() > 0
        links, out = settled(links, left.select("id") if waits else None)
        if out is not None:
            gone = gone.union(out)
        if not waits:
            break
        if out is not None:
            left = left.join(small_side(out, out.count()), "id", "left_anti")
        open_ = write_shared(left.groupBy("key").agg(*_group_sizes(), F.min("id").alias("a"), F.max("id").alias("b"), F.first("cut").alias("cut"))
                             .where("s > 0 and t > 0 and a <> b").select("key", (F.col("cut") & (F.col("s") * F.col("t") > GROUP_PAIRS)).alias("again")), "line-groups")
        left = left.drop("cut").join(_few(open_, open_.count()), "key")
        names = ("key", "id", "probe", "gaps", "sketch")
        spent, rows = rows, write_shared(refined(left.where("again").select(*names), _few(texts, n_ids), k, per, least)
                                         .union(left.where("not again").select(*names)), "line-rows")
        drop_shared(spent, sizes)
        forget_shuffles(spark)
    done = write_shared(gone.distinct(), "line-gone")
    drop_shared(rows, sizes, texts, links)
    forget_shuffles(spark)
    return done


def dedup_lines(docs: DataFrame, k: int = MAX_EDITS, min_chars: int = MIN_CHARS, per: int = EDIT_CHARS) -> DataFrame:
    """The input with later copies of lines removed from ``text``, plus
    ``n_lines`` (with a word, before), ``n_removed`` and ``n_near`` (removed without an equal earlier line)."""
    kept = docs.drop(*[c for c in LINE_COLUMNS if c in docs.columns])
    near = near_copies(kept.select("doc_id", "text"), k, min_chars, per).withColumn("gone", F.lit(True))
    all_lines, blank = F.split("text", "\n"), " \t\n\x0b\x0c\r"
    lines = kept.select("doc_id", F.xxhash64("text").alias("th"), "text").select("doc_id", "th", F.posexplode(all_lines).alias("line_no", "line")) \
        .where(F.ltrim("line", F.lit(blank)) != "").select("doc_id", "th", "line_no", F.xxhash64("line").alias("id"))
    lines = write_shared(lines, "lines")
    at = F.struct("doc_id", "th", "line_no")
    # only lines with a copy or a near copy have anything to remove
    rule = write_shared(lines.groupBy("id").agg(F.min(at).alias("own"), F.count("*").alias("n")).join(near, "id", "left").where("n > 1 or gone")
                        .select("id", "own", F.coalesce("gone", F.lit(False)).alias("gone")), "line-rules")
    removed = lines.join(small_side(rule, rule.count()), "id").withColumn("first", at.eqNullSafe(F.col("own"))) \
        .where(F.col("gone") | ~F.col("first")).select("doc_id", "th", "line_no", (F.col("gone") & F.col("first")).alias("near"))
    removed = write_shared(removed.distinct().groupBy("doc_id", "th").agg(
        F.collect_list("line_no").alias("__gone"), F.sum(F.col("near").cast("bigint")).alias("n_near")), "line-removed")
    drop_shared(lines, rule, near)
    forget_shuffles(docs.sparkSession)
    size = removed.agg(F.sum(F.size("__gone"))).first()[0] or 0
    # bound once per row: inside the loop over lines the text would be split again for every line
    body = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(let(all_lines, lambda a: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(a) - 1), F.col("__gone")), lambda i: F.get(a, i)), "\n")))
    return kept.join(small_side(removed.withColumnsRenamed({"doc_id": "__d", "th": "__h"}), size),
                     F.col("doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__h")), "left") \
        .withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(
            F.size(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D])[^\n]*"), F.lit(1)))).cast("bigint")) \
        .withColumn("text", body).withColumn("n_removed", F.coalesce(F.size("__gone"), F.lit(0)).cast("bigint")) \
        .withColumn("n_near", F.coalesce("n_near", F.lit(0)).cast("bigint")).select(*kept.columns, "n_lines", "n_removed", "n_near")


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: its lines, those removed, and the hash of what stays."""
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", "n_near", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
