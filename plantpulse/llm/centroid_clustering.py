"""Centroid clustering over a VA-file.

Every vector is stored twice: whole, and as an approximation of ``BITS`` bits
per dimension (the cell its component falls in).  Per round, tables over
(dimension, cell, centroid) give the least and greatest distance that a
vector of these cells can have to every centroid; distances are taken relative to
that from the centroids' mean, whose part is common to all.  A vector whose best
interval overlaps no other is assigned without being read.

A round is one scan of the approximations.  They are placed under the last
round's centroids and under the new ones; where both placements are certain
and equal, nothing changes.  Only the other vectors are fetched, and the
clusters' exact sums move by what they left and entered.  No assignment
is stored between rounds.  All arithmetic on components is in integers.

What leaves a round is one row per (cluster, dimension); the driver
holds the centroids.  When no centroid moves, the remaining rounds cannot
change anything and are left out.

Defined results: vectors that are null, of another length, or with a null or
non-finite component are left out.  Components are clamped to +-``LARGEST``
after scaling, which keeps every squared distance in 64 bits.  Repeated rows and
repeated ids are vectors of their own; a null id counts as an empty one in the
starting order, whose ties fall to the smaller vector.  With fewer than ``k`` vectors there are as
many centroids as vectors; an empty table gives an empty result.  Other columns
are not carried.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from plantpulse.llm.common import drop_shared, ship, small_side, table, write_shared

DIMS = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
#: Bits of a cell.
BITS = 8
LARGEST = 1 << 26
#: Vectors handled at once.
SLICE = 1 << 13


def kept_vectors(vectors: DataFrame, dims: int = DIMS, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``vec_id`` and the scaled integer components ``x`` of the usable vectors."""
    v = F.col(column)
    fits = (F.size(v) == dims) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    unit = lambda e: F.floor(F.least(F.greatest(e.cast("double") * SCALE, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))).cast("int")
    return vectors.where(F.coalesce(fits, F.lit(False))).select(F.col(id_col).alias("vec_id"), F.transform(v, unit).alias("x"))


def _matrix(column, dims: int) -> np.ndarray:
    """The rows of an Arrow list column as an integer matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _cells(column, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, dims)


def cell_edges(stats: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Per dimension, the first value of every cell and the end of the last.

    ``stats`` holds least, greatest, mean and standard deviation.  Cells are equally wide within three
    deviations of the mean; the outer two reach the extremes.
    """
    n = 1 << bits
    edges = np.zeros((len(stats), n + 1), dtype=np.int64)
    for d, (lo, hi, mean, sd) in enumerate(stats):
        inner = np.floor(np.linspace(mean - 3 * sd, mean + 3 * sd, n + 1)).astype(np.int64)
        edges[d] = np.clip(inner, int(lo), int(hi) + 1)
        edges[d, 0], edges[d, -1] = int(lo), int(hi) + 1
    return edges


def to_cells(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    out = np.empty(x.shape, dtype=np.uint8)
    for d in range(x.shape[1]):
        out[:, d] = np.searchsorted(edges[d, 1:-1], x[:, d], side="right")
    return out


def interval_tables(edges: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest of ``(x - c)**2 - (x - m)**2`` per dimension, cell and centroid.

    Linear in ``x``, so the extremes are at the ends of a cell; ``m`` is the centroids' rounded mean.
    """
    c = np.array(centroids, dtype=np.int64)
    m = c.sum(axis=0) // len(c)
    first, last = edges[:, :-1, None], np.maximum(edges[:, 1:, None] - 1, edges[:, :-1, None])
    at = lambda x: 2 * x * (m - c).T[:, None, :] + (c * c - m * m).T[:, None, :]
    a, b = at(first), at(last)
    return np.minimum(a, b), np.maximum(a, b)


def place(cells: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The centroid of each approximation, or -1 where intervals overlap."""
    least, most = tables
    k = least.shape[2]
    lower, upper = np.zeros((len(cells), k), dtype=np.int64), np.zeros((len(cells), k), dtype=np.int64)
    for d in range(cells.shape[1]):
        lower += least[d][cells[:, d]]
        upper += most[d][cells[:, d]]
    best = upper.argmin(axis=1)
    rows = np.arange(len(cells))
    bound = upper[rows, best]
    lower[rows, best] = np.iinfo(np.int64).max
    return np.where((lower > bound[:, None]).all(axis=1), best, -1)


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Exact nearest centroid (the smaller number of equals) and squared distance."""
    d = np.stack([((x - np.array(c, dtype=np.int64)) ** 2).sum(axis=1) for c in centroids], axis=1)
    k = d.argmin(axis=1)
    return k, d[np.arange(len(x)), k]


def assign(x: np.ndarray, cells: np.ndarray, tables, centroids) -> np.ndarray:
    """Clusters of fetched vectors: by their cells where certain, else exactly."""
    k = place(cells, tables)
    open_ = np.flatnonzero(k < 0)
    if len(open_):
        k[open_] = nearest(x[open_], centroids)[0]
    return k


def _slices(batch: pa.RecordBatch):
    for lo in range(0, batch.num_rows, SLICE):
        yield batch.slice(lo, SLICE)


class VaFile:
    """The two tables of a set of vectors, ``whole`` (at, vec_id, x, cells) and ``approximations`` (its columns at, cells)."""

    def __init__(self, vectors: DataFrame, dims: int = DIMS, bits: int = BITS):
        """``vectors``: ``vec_id`` and ``x`` as :func:`kept_vectors` gives them."""
        self.spark, self.dims = vectors.sparkSession, dims
        ship(self.spark)
        numbered = write_shared(vectors.withColumn("at", F.monotonically_increasing_id()), "vectors")
        stats = self._stats(numbered)
        self.n = int(stats[0][0]) if len(stats) else 0
        self.edges = cell_edges(np.array([s[1:] for s in stats]), bits) if self.n else np.zeros((dims, (1 << bits) + 1), np.int64)
        edges = self.spark.sparkContext.broadcast(self.edges)

        def run(batches):
            for batch in batches:
                for part in _slices(batch):
                    c = to_cells(_matrix(part.column(2), dims), edges.value)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array([r.tobytes() for r in c], pa.binary())], ["at", "vec_id", "x", "cells"])

        id_type = vectors.schema["vec_id"].dataType.simpleString()
        self.whole = write_shared(numbered.select("at", "vec_id", "x").mapInArrow(
            run, f"at bigint, vec_id {id_type}, x array<int>, cells binary"), "va-file")
        drop_shared(numbered)
        self.approximations = self.whole.select("at", "cells")

    def _stats(self, numbered: DataFrame) -> list[tuple]:
        """Count, least, greatest, mean and deviation per dimension, from one row per task and dimension."""
        dims = self.dims

        def run(batches):
            n, s, q = 0, np.zeros(dims), np.zeros(dims)
            lo, hi = np.full(dims, np.iinfo(np.int64).max), np.full(dims, np.iinfo(np.int64).min)
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column(0), dims)
                    n, s, q = n + len(x), s + x.sum(axis=0), q + (x.astype(float) ** 2).sum(axis=0)
                    lo, hi = np.minimum(lo, x.min(axis=0)), np.maximum(hi, x.max(axis=0))
            if n:
                yield pa.RecordBatch.from_pydict({"d": np.arange(dims, dtype=np.int32), "n": np.full(dims, n), "lo": lo, "hi": hi, "s": s, "q": q})

        found = numbered.select("x").mapInArrow(run, "d int, n bigint, lo bigint, hi bigint, s double, q double") \
            .groupBy("d").agg(F.sum("n").alias("n"), F.min("lo"), F.max("hi"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("d").collect()
        return [(r["n"], r[2], r[3], r["s"] / r["n"], max(r["q"] / r["n"] - (r["s"] / r["n"]) ** 2, 0.0) ** 0.5) for r in found]

    def first(self, k: int, salt: str) -> list[list[int]]:
        """The vectors with the smallest digests of their ids."""
        digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
        return [list(r["x"]) for r in self.whole.select(digest.alias("h"), "x").orderBy("h", "x").limit(k).collect()]

    def totals(self, centroids) -> list[list[int]]:
        """Per cluster, the sums of its vectors' components and, last, their number."""
        tables, dims = self.spark.sparkContext.broadcast(interval_tables(self.edges, centroids)), self.dims

        def moves(part):
            x, cells = _matrix(part.column(0), dims), _cells(part.column(1), dims)
            return x, None, assign(x, cells, tables.value, centroids)

        out = self._sums(self.whole.select("x", "cells"), moves, len(centroids))
        tables.destroy()
        return out

    def undecided(self, old, new, tables=None) -> DataFrame:
        """``at`` of the vectors that may change their cluster, from the approximations alone (``tables``: the broadcast
        interval tables of both, where they are at hand)."""
        tables, dims = tables or self.spark.sparkContext.broadcast([interval_tables(self.edges, c) for c in (old, new)]), self.dims

        def run(batches):
            for batch in batches:
                for part in _slices(batch):
                    a, b = (place(_cells(part.column(1), dims), t) for t in tables.value)
                    yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array((a != b) | (a < 0)))], ["at"])

        return self.approximations.mapInArrow(run, "at bigint")

    def moved(self, old, new) -> list[list[int]]:
        """How the totals change when the centroids go from ``old`` to ``new``."""
        tables, dims = self.spark.sparkContext.broadcast([interval_tables(self.edges, c) for c in (old, new)]), self.dims
        ids = write_shared(self.undecided(old, new, tables), "va-undecided")
        n = ids.count()
        if not n:
            tables.destroy()
            return [[0] * (self.dims + 1) for _ in new]
        rows = self.whole.select("at", "x", "cells")
        if 2 * n < self.n:
            rows = rows.join(small_side(ids, n), "at", "left_semi")

        def moves(part):
            x, cells = _matrix(part.column(0), dims), _cells(part.column(1), dims)
            return x, assign(x, cells, tables.value[0], old), assign(x, cells, tables.value[1], new)

        out = self._sums(rows.select("x", "cells"), moves, len(new))
        tables.destroy()
        drop_shared(ids)
        return out

    def _sums(self, rows: DataFrame, moves, k: int) -> list[list[int]]:
        dims = self.dims

        def run(batches):
            total = np.zeros((k, dims + 1), dtype=np.int64)
            for batch in batches:
                for part in _slices(batch):
                    x, old, new = moves(part)
                    x = np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1)
                    for c in range(k):
                        total[c] += x[new == c].sum(axis=0)
                        if old is not None:
                            total[c] -= x[old == c].sum(axis=0)
            c, d = np.nonzero(total)
            yield pa.RecordBatch.from_pydict({"c": c.astype(np.int32), "d": d.astype(np.int32), "s": total[c, d]})

        out = [[0] * (dims + 1) for _ in range(k)]
        for r in rows.mapInArrow(run, "c int, d int, s bigint").groupBy("c", "d").agg(F.sum("s").alias("s")).collect():
            out[r["c"]][r["d"]] = int(r["s"])
        return out

    def nearest(self, centroids) -> DataFrame:
        """``vec_id``, ``cluster`` and ``distance`` of every vector."""
        dims = self.dims

        def run(batches):
            for batch in batches:
                for part in _slices(batch):
                    k, d = nearest(_matrix(part.column(1), dims), centroids)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(k.astype(np.int32)), pa.array(d)], ["vec_id", "cluster", "distance"])

        id_type = self.whole.schema["vec_id"].dataType.simpleString()
        return self.whole.select("vec_id", "x").mapInArrow(run, f"vec_id {id_type}, cluster int, distance bigint")


def fit(va: VaFile, k: int = CLUSTERS, rounds: int = ROUNDS, salt: str = "3:") -> list[list[int]]:
    """Final centroids after ``rounds`` rounds of assigning and averaging (componentwise floor)."""
    centroids = va.first(k, salt)
    totals, before = None, None
    for _ in range(rounds if centroids else 0):
        if totals is None:
            totals = va.totals(centroids)
        else:
            totals = [[a + b for a, b in zip(t, m, strict=True)] for t, m in zip(totals, va.moved(before, centroids), strict=True)]
        before = centroids
        centroids = [[s // t[-1] for s in t[:-1]] if t[-1] else c for t, c in zip(totals, before, strict=True)]
        if centroids == before:
            break
    return centroids


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS) -> tuple[DataFrame, list[list[int]]]:
    """``vec_id, cluster, distance`` of the usable vectors, and the centroids."""
    va = VaFile(kept_vectors(vectors, dims), dims)
    centroids = fit(va, k, rounds)
    return va.nearest(centroids), centroids


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster(table(spark, sf_dir, "embeddings"))
    found = write_shared(found, "clusters")
    named = spark.createDataFrame([(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)],
                                  "cluster int, centroid_sha256 string")
    own = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    own = own.crossJoin(F.broadcast(own.agg(F.sum("cluster_inertia").alias("inertia")))).join(F.broadcast(named), "cluster")
    return found.join(F.broadcast(own), "cluster") \
        .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # own: one row per cluster


def _op11_sql(k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS) -> str:
    near = """SELECT row_no, vec_id, x, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
      SELECT v.row_no, v.vec_id, v.x, m.c, list_sum(list_transform(list_zip(v.x, m.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
      FROM v, {m} m) GROUP BY ALL"""
    steps = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x
      FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims})""",
             f"m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS c, x FROM v QUALIFY c < {k})"]
    for r in range(rounds):
        steps.append(f"""a{r} AS MATERIALIZED ({near.format(m=f'm{r}')}),
    s{r} AS (SELECT c, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, {dims + 1}) t(i) GROUP BY ALL),
    m{r + 1} AS MATERIALIZED (SELECT m.c, coalesce(u.x, m.x) AS x FROM m{r} m LEFT JOIN (
      SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{r} GROUP BY c) u USING (c))""")
    return f"""WITH {', '.join(steps)}, f AS MATERIALIZED ({near.format(m=f'm{rounds}')})
    SELECT vec_id, f.c::INT AS cluster, f.d AS distance, sum(f.d) OVER (PARTITION BY f.c)::BIGINT AS cluster_inertia,
      sum(f.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(m.x, ',')) AS centroid_sha256
    FROM f JOIN m{rounds} m ON m.c = f.c"""


OP11_SQL = _op11_sql()
