"""Exact ranks, prefix sums, first rows and cut points without a single-partition window.

Two ways, by the order that is asked for:

* seeded order ``md5('<seed>:<id>')``: the first hex digits of the key are
  ``16**digits`` uniform buckets whatever the data.  A per-bucket count (a
  bounded table) gives every bucket its rank offset: ``cut_points`` finds the
  sort key at given ranks inside one bucket each, so a split becomes a
  map-side comparison, and ``global_rank`` numbers rows inside their buckets;
* any other order: slim rows are range-partitioned, sorted and written with
  their place in their partition (``placed``).  The partitions' counts or sums
  (one row a partition) then give exact ranks and prefix sums.  For the first
  ``n`` of many rows a mergeable quantile sketch bounds the candidates
  beforehand, so that only about ``n`` rows are sorted.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

BUCKET_DIGITS = 4
SKETCH = 10_000  # a quantile sketch errs by at most 1 / SKETCH of the rows
_PLACE_BITS = 33  # of a monotonically increasing id: the row's place in its partition


def seeded_key(order_col: Column | str, seed: int) -> Column:
    """Deterministic shuffle key: ``md5('<seed>:<id>')`` as 32 hex chars."""
    c = F.col(order_col) if isinstance(order_col, str) else order_col
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def hex_bucket(key: str, digits: int = BUCKET_DIGITS) -> Column:
    """Bucket of a hex key: its first ``digits`` hex digits as an int."""
    return F.conv(F.substring(F.col(key), 1, digits), 16, 10).cast("int")


def order_number(col: str, dtype: T.DataType) -> Column:
    """A DOUBLE that does not fall where the column rises; it may tie where the column does not.

    Texts count by their first six bytes; types that have no number here all tie.
    """
    c = F.col(col)
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    if isinstance(dtype, (T.DateType, T.TimestampType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return F.lit(0.0)


def placed(df: DataFrame, sort_cols: list[str], name: str = "placed") -> DataFrame:
    """``df`` written in ``sort_cols`` order, with ``_part`` and ``_place``: ordered partition and 0-based place in it."""
    ordered = df.repartitionByRange(*sort_cols).sortWithinPartitions(*sort_cols).withColumn("_at", F.monotonically_increasing_id())
    out = materialize(ordered, name)
    return out.withColumn("_part", F.shiftright("_at", _PLACE_BITS).cast("int")).withColumn("_place", F.col("_at").bitwiseAND((1 << _PLACE_BITS) - 1)).drop("_at")


def _with_offsets(parts: DataFrame, size: Column) -> DataFrame:
    """``parts`` with ``_offset``: the total ``size`` of the partitions before; one row a partition reaches the driver."""
    sizes = sorted((r[0], r[1]) for r in parts.groupBy("_part").agg(size).collect())
    before = accumulate([0] + [n for _, n in sizes])
    offsets = parts.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "_part INT, _offset BIGINT")
    return parts.join(F.broadcast(offsets), "_part")


def range_rank(df: DataFrame, sort_cols: list[str], out: str = "rank") -> DataFrame:
    """Exact 0-based rank in ``sort_cols`` order, which should be unique; for slim rows, as all columns are sorted and written."""
    return _with_offsets(placed(df, sort_cols), F.count(F.lit(1))).withColumn(out, F.col("_offset") + F.col("_place")).drop("_part", "_place", "_offset")


def prefix_sum(df: DataFrame, sort_cols: list[str], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over all rows before, in ``sort_cols`` order (unique); for slim rows."""
    before = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    parts = _with_offsets(placed(df, sort_cols), F.sum(value))
    return parts.withColumn(out, F.col("_offset") + F.coalesce(F.sum(value).over(before), F.lit(0))).drop("_part", "_place", "_offset")


def first_rows(df: DataFrame, n: int, order_col: str, out: str, key: Column | None = None) -> DataFrame:
    """The first ``n`` rows by ``key`` (default: the id itself), then by ``order_col``, with their 0-based rank ``out``.

    The ids are written once; a sketch of them gives a bound that at least
    ``n`` do not exceed, and about ``n`` ids are sorted and joined back.  One
    plan for every ``n``.  Ids are unique and may be of any orderable type; a
    null id fails.
    """
    cols = [order_col] if key is None else ["_key", order_col]
    keyed = df.select(checked_id(order_col)) if key is None else df.select(checked_id(order_col), key.alias("_key"))
    ids = materialize(keyed, "ids")
    total = ids.count()
    if n < total:
        number = order_number(cols[0], ids.schema[cols[0]].dataType)
        # the share that is asked for exceeds n by twice the error, so the bound's true rank does not fall below n
        bound = ids.agg(F.percentile_approx(number, min(1.0, n / total + 2 / SKETCH), SKETCH)).first()[0]
        few = ids.where(number <= F.lit(bound))
        ids = few if few.count() >= n else ids
    ranked = range_rank(ids, cols, out).where(F.col(out) < n)
    return df.join(ranked.select(order_col, out), order_col).select(*df.columns, out)


def checked_id(col: str) -> Column:
    """The id itself; a null id fails the job instead of losing its row in a join."""
    return F.when(F.col(col).isNull(), F.raise_error(F.lit(f"{col} is null: rows need an id here"))).otherwise(F.col(col)).alias(col)


def with_checked_id(df: DataFrame, col: str) -> DataFrame:
    return df.select(*[checked_id(c) if c == col else F.col(c) for c in df.columns])


def bucket_offsets(df: DataFrame, bucket: Column) -> tuple[list[int], list[int], int]:
    """(buckets, rows before each bucket, total) from one aggregated pass."""
    counts = sorted((r[0], r[1]) for r in df.groupBy(bucket.alias("b")).count().collect())
    buckets = [b for b, _ in counts]
    sizes = [n for _, n in counts]
    before = [0] + list(accumulate(sizes))[:-1]
    return buckets, before, sum(sizes)


def _any(conds) -> Column:
    out = F.lit(False)
    for c in conds:
        out = out | c
    return out


def cut_points(df: DataFrame, sort_cols: list[str], ranks, bucket: Column) -> list[tuple | None]:
    """Sort-key tuple of the row at each 0-based rank, ``None`` past the end.

    ``sort_cols`` must order rows uniquely and ``bucket`` must be
    non-decreasing in that order.  ``ranks`` is a list, or a function of the
    row count returning one.
    """
    buckets, before, total = bucket_offsets(df, bucket)
    if callable(ranks):
        ranks = ranks(total)
    wanted: dict[tuple[int, int], list[int]] = {}
    for i, r in enumerate(ranks):
        if 0 <= r < total:
            j = max(k for k in range(len(buckets)) if before[k] <= r)
            wanted.setdefault((buckets[j], r - before[j] + 1), []).append(i)
    out: list[tuple | None] = [None] * len(ranks)
    if not wanted:
        return out
    target_buckets = sorted({b for b, _ in wanted})
    w = Window.partitionBy("b").orderBy(*sort_cols)
    rows = (
        df.select(*sort_cols, bucket.alias("b"))
        .where(F.col("b").isin(target_buckets))
        .withColumn("rn", F.row_number().over(w))
        .where(_any((F.col("b") == b) & (F.col("rn") == n) for b, n in wanted))
        .collect()
    )
    for r in rows:
        for i in wanted[(r["b"], r["rn"])]:
            out[i] = tuple(r[c] for c in sort_cols)
    return out


def before_cut(sort_cols: list[str], cut: tuple | None) -> Column:
    """True for rows strictly before the cut in ``sort_cols`` order (all rows when ``cut`` is None)."""
    if cut is None:
        return F.lit(True)
    cond = F.lit(False)
    for i in reversed(range(len(sort_cols))):
        less = F.col(sort_cols[i]) < F.lit(cut[i])
        cond = less if i == len(sort_cols) - 1 else (less | ((F.col(sort_cols[i]) == F.lit(cut[i])) & cond))
    return cond


def global_rank(
    df: DataFrame, sort_cols: list[str], bucket: Column, out: str = "rank", keep_bucket: bool = False
) -> DataFrame:
    """Add an exact 0-based rank in ``sort_cols`` order.

    With ``keep_bucket`` the result keeps ``_b`` (its partitioning key),
    ``_offset`` (rank of the bucket's first row) and ``_bucket_rows``.
    """
    spark = df.sparkSession
    buckets, before, total = bucket_offsets(df, bucket)
    sizes = [b - a for a, b in zip(before, before[1:] + [total])]
    # one row per non-empty bucket: bounded by the bucket count
    offsets = spark.createDataFrame(list(zip(buckets, before, sizes)), "_b INT, _offset BIGINT, _bucket_rows BIGINT")
    w = Window.partitionBy("_b").orderBy(*sort_cols)
    ranked = (
        df.withColumn("_b", bucket)
        .join(F.broadcast(offsets), "_b")
        .withColumn(out, F.col("_offset") + F.row_number().over(w) - 1)
    )
    return ranked if keep_bucket else ranked.drop("_b", "_offset", "_bucket_rows")
