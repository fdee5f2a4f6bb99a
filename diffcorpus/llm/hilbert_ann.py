"""Approximate nearest neighbours by shifted Hilbert curves over projected vectors.

Each curve projects the vectors on a few random directions, shifts the grid
and orders all vectors by their Hilbert key.  Spark range-partitions every
order; ranks cut it into blocks of equal size, and a query meets the vectors
of its own and the neighbouring blocks of each curve, by exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stages import sampled, stage

#: Vectors that the grid is fitted on, and queries that the window is measured with, about.
FIT_SAMPLE, MEASURED = 4_096, 128


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer cells (rows, axes); ``bits`` per axis, 63 at most in all.

    From the top bit down, every axis swaps or flips the lower bits of the
    first; a Gray code over all axes ends it, and the bits are interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    for b in range(bits - 1, 0, -1):
        bit, low = 1 << b, (1 << b) - 1
        for axis in x:
            flip = (axis & bit) != 0
            swap = np.where(flip, 0, (x[0] ^ axis) & low)
            x[0] ^= np.where(flip, low, swap)
            axis ^= swap
    np.bitwise_xor.accumulate(x, axis=0, out=x)
    turn = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << b), (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | ((axis >> b) & 1)
    return key


@dataclass
class Curves:
    """Directions (curves, dimension, axes), the quantile grid along each, and a shift per axis."""

    directions: np.ndarray
    edges: np.ndarray
    shifts: np.ndarray
    bits: int

    def keys(self, unit: np.ndarray) -> Iterator[np.ndarray]:
        cells = 1 << self.bits
        for way, edge, shift in zip(self.directions, self.edges, self.shifts):
            flat = unit @ way
            share = np.stack([np.searchsorted(e, f) / len(e) for e, f in zip(edge, flat.T)], axis=1)
            yield hilbert_keys(np.minimum(((share + shift) / 2 * cells).astype(np.int64), cells - 1), self.bits)


def fit_curves(sample: np.ndarray, curves: int, axes: int, seed: int = 17) -> Curves:
    """Random orthogonal directions; cell borders from the quantiles of a bounded sample of unit vectors."""
    rng, dim = np.random.default_rng(seed), sample.shape[1]
    axes = min(axes, dim)
    ways = np.stack([np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, :axes] for _ in range(curves)])
    edges = np.stack([np.quantile(sample @ way, np.linspace(0, 1, 257), axis=0).T for way in ways])
    return Curves(ways, edges, rng.random((curves, axes)), min(8, 62 // axes))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _best(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, top: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (query, vector, cosine): of each query the ``top`` nearest, ties to the smaller id."""
    q, v = _unit(queries), _unit(vectors)
    order = np.argsort(ids, kind="stable")
    for a in range(0, len(q), 256):
        score = q[a : a + 256] @ v[order].T
        if score.shape[1] > 4 * top:  # what ties with the last one kept stays in sight
            least = -np.partition(-score, top - 1, axis=1)[:, top - 1] - 1e-12
            row, col = np.nonzero(score >= least[:, None])
        else:
            row, col = (x.ravel() for x in np.indices(score.shape))
        pick = order[col]
        x, y = queries[a + row], vectors[pick]
        exact = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
        far = ~np.isfinite(exact)  # sums out of the range of doubles
        exact[far] = np.einsum("ij,ij->i", q[a + row[far]], v[pick[far]])
        by = np.lexsort((ids[pick], -exact, row))
        place = np.arange(len(by)) - np.searchsorted(row[by], row[by])
        by = by[place < top]
        yield a + row[by], pick[by], exact[by]


def nearest(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, curves: int = 16, axes: int = 8, block: int = 512, recall: float = 0.95
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows by cosine for every row where ``is_query`` holds.

    Vectors that are null, zero, or hold null or non-finite components take no
    part, nor do rows with a null id or a length other than the table's
    commonest.  Equal vectors are indexed once, with their ``k + 1`` smallest
    ids, so copies cost one row and none is lost; a repeated row of one id
    counts once.  Ties go to the smaller id.

    Every vector is indexed.  How many blocks a query looks at to either side
    is measured: it is the least number that finds a share of ``recall`` of the
    true neighbours of about ``MEASURED`` queries, whatever that takes.
    """
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), is_query.alias("asks")).where(
        F.col("id").isNotNull()
        & F.col("vec").isNotNull()
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vec", lambda x: x != 0)
    )
    spark, kind = vectors.sparkSession, src.schema["vec"].dataType.simpleString()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    common = src.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return empty
    dim = common.dim
    src = src.where(F.size("vec") == dim).withColumns({"h": F.xxhash64("vec"), "g": F.hash("vec")})

    # equal vectors: one class, its smallest ids (limited before the shuffle), named by the smallest
    by_class = W.partitionBy("h", "g").orderBy("id")
    few = src.select("h", "g", "id").distinct().withColumn("n", F.row_number().over(by_class)).where(F.col("n") <= k + 1)
    named = few.groupBy("h", "g").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    held = src.groupBy("h", "g").agg(F.first("vec").alias("vec"), F.coalesce(F.bool_or("asks"), F.lit(False)).alias("asks"))
    classes = stage(named.join(held, ["h", "g"]).withColumn("cid", F.col("ids")[0]), "ann-classes")
    total, asking = classes.agg(F.count("*"), F.count_if("asks")).first()
    if not asking:
        return empty

    rows = sampled(classes.select("cid", "vec"), "cid", FIT_SAMPLE, total).select("vec").toArrow()["vec"]
    fitted = spark.sparkContext.broadcast(fit_curves(_unit(_matrix(rows.combine_chunks(), dim)), curves, axes))

    def order(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if batch.num_rows:
                for c, keys in enumerate(fitted.value.keys(_unit(_matrix(batch.column("vec"), dim)))):
                    yield pa.record_batch([pa.array(np.full(len(keys), c, np.int32)), pa.array(keys), *batch.columns], names=["curve", "key", *batch.schema.names])

    keyed = classes.select("cid", "ids", "asks", "vec").mapInArrow(order, f"curve int, key long, cid long, ids array<long>, asks boolean, vec {kind}")
    # the number of a row in its sorted partition, then, with the sizes of the partitions before, in its curve
    dealt = stage(keyed.repartitionByRange("curve", "key", "cid").sortWithinPartitions("curve", "key", "cid").withColumn("m", F.monotonically_increasing_id()), "ann-order")
    part = F.shiftright("m", 33).alias("part")
    sizes = dealt.groupBy("curve", part).agg(F.count("*").alias("n"), F.min("m").alias("first"))
    before = W.partitionBy("curve").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))  # one row per partition and curve
    placed = dealt.withColumn("part", part).join(F.broadcast(starts.select("curve", "part", "first", "start")), ["curve", "part"])
    ranked = placed.withColumn("block", F.floor((F.col("start") + F.col("m") - F.col("first")) / block)).drop("part", "m", "first", "start")

    # the window: how far apart, on the nearest curve, are queries and their true neighbours?
    some = sampled(classes.where("asks").select("cid", "vec"), "cid", MEASURED, asking).toArrow()
    truth = spark.sparkContext.broadcast((some["cid"].to_numpy(), _matrix(some["vec"].combine_chunks(), dim)))

    def exact(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, qs = truth.value
        for batch in source:
            if batch.num_rows and len(names):
                ids = batch.column("cid").to_numpy()
                for q, v, s in _best(qs, _matrix(batch.column("vec"), dim), ids, k + 1):
                    yield pa.record_batch([pa.array(names[q]), pa.array(ids[v]), pa.array(s)], names=["q", "cid", "score"])

    order_by = W.partitionBy("q").orderBy(F.desc("score"), "cid")
    pairs = classes.select("cid", "vec").mapInArrow(exact, "q long, cid long, score double").withColumn("n", F.row_number().over(order_by)).where(F.col("n") <= k + 1).select("q", "cid")
    at = ranked.select("curve", "cid", "block")
    near = F.broadcast(pairs)  # k + 1 rows for each measured query
    mine = at.join(F.broadcast(pairs.select(F.col("q").alias("cid")).distinct()), "cid").select(F.col("cid").alias("q"), "curve", F.col("block").alias("own"))
    theirs = at.join(near, "cid").select("q", "cid", "curve", "block")
    gaps = mine.join(theirs, ["q", "curve"]).groupBy("q", "cid").agg(F.min(F.abs(F.col("own") - F.col("block"))).alias("gap")).select("gap").toArrow()["gap"].to_numpy()
    reach = int(np.quantile(gaps, recall, method="higher")) if len(gaps) else 0
    reach = max(1, reach)

    looking = ranked.where("asks").select(F.col("curve").alias("curve"), F.explode(F.sequence(F.col("block") - reach, F.col("block") + reach)).alias("block"), F.col("cid").alias("cid"), F.col("vec").alias("vec"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"q": [], "cid": [], "ids": [], "score": []}
        if left.num_rows and right.num_rows:
            left, right = left.combine_chunks(), right.combine_chunks()
            names, ids = left["cid"].to_numpy(), right["cid"].to_numpy()
            for q, v, s in _best(_matrix(left["vec"].combine_chunks(), dim), _matrix(right["vec"].combine_chunks(), dim), ids, k + 1):
                out["q"].append(names[q])
                out["cid"].append(ids[v])
                out["score"].append(s)
                out["ids"].append(right["ids"].combine_chunks().take(pa.array(v)))
        if not out["q"]:
            return pa.table({"q": pa.array([], pa.int64()), "cid": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.float64())})
        return pa.table({"q": np.concatenate(out["q"]), "cid": np.concatenate(out["cid"]), "ids": pa.concat_arrays(out["ids"]), "score": np.concatenate(out["score"])})

    there = ranked.select(*[F.col(c).alias(c) for c in ("curve", "block", "cid", "ids", "vec")])
    met = looking.groupBy("curve", "block").cogroup(there.groupBy("curve", "block")).applyInArrow(meet, "q long, cid long, ids array<long>, score double")
    best = met.groupBy("q", "cid").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    flat = best.select("q", "score", F.explode("ids").alias("vec_id"))
    first = flat.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1)
    lists = first.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("found"))

    # every asking row takes its class's list, without itself
    asks = src.where("asks").select("h", "g", F.col("id").alias("query_id")).distinct().join(classes.select("h", "g", F.col("cid").alias("q")), ["h", "g"])
    told = asks.join(lists, "q").select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return told.select("query_id", F.posexplode("found").alias("pos", "x")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
