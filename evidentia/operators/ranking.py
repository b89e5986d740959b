"""Exact ranks over tables of any size, without a single-task sort.

Arrival caps and deep pages need the k-th row of a total order. A global
``limit(k)`` funnels k rows per partition into one task, so the boundary value
is found by narrowing histograms instead (each pass returns at most
``BUCKETS`` counts to the driver) and the result is a plain filter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import ArrayType, MapType, StructType

from ..session import cut_lineage

BUCKETS = 4096
NATIVE_LIMIT = 1000


def kth_value(df: DataFrame, column: str, k: int, descending: bool = False) -> tuple[int, int] | None:
    """Value at 1-based rank ``k`` and the rank left among rows equal to it; null ranks are skipped."""
    found = kth_place(df, column, k, descending)
    return None if found is None else found[:2]


def kth_place(df: DataFrame, column: str, k: int, descending: bool = False) -> tuple[int, int, int] | None:
    """As ``kth_value``, and how many rows are equal to the value."""
    values = df.select(F.col(column).cast("bigint").alias("v")).where(F.col("v").isNotNull())
    low, high, total = values.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if k < 1 or total < k:
        return None
    remaining, equal = k, total
    while low < high:
        width = -(-(high - low + 1) // BUCKETS)
        bucket = F.call_function("div", F.col("v") - F.lit(low), F.lit(width).cast("bigint"))
        histogram = (
            values.where(F.col("v").between(low, high)).groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()
        )
        for b, n in sorted(((row["b"], row["n"]) for row in histogram), reverse=descending):
            if remaining <= n:
                low, high = low + b * width, min(high, low + (b + 1) * width - 1)
                equal = n
                break
            remaining -= n
    return low, remaining, equal


def row_bound(df: DataFrame, order: list[tuple[str, bool]], k: int) -> list[int] | None:
    """Values of the ``(column, descending)`` order columns in the row at rank ``k``, and its rank among their equals."""
    bound: list[int] = []
    rows, remaining = df, k
    for column, descending in order:
        found = kth_value(rows, column, remaining, descending)
        if found is None:
            return None
        value, remaining = found
        bound.append(value)
        rows = rows.where(F.col(column) == value)
    return [*bound, remaining]


def _reaches(order: list[tuple[str, bool]], bound: list[int], after: bool) -> Column:
    """Rows at or after (at or before) ``bound`` in the given order."""
    result = F.lit(True)
    for (column, descending), value in reversed(list(zip(order, bound))):
        beyond = F.col(column) > value if after != descending else F.col(column) < value
        result = beyond | ((F.col(column) == value) & result)
    return result


def sort_columns(order: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c, descending in order]


def tie_names(df: DataFrame, order: list[tuple[str, bool]]) -> list[str]:
    """Every other column that can be sorted."""
    named = {c for c, _ in order}
    return [f.name for f in df.schema if f.name not in named and not isinstance(f.dataType, (ArrayType, MapType, StructType))]


def tie_columns(df: DataFrame, order: list[tuple[str, bool]]) -> list[Column]:
    """Order of rows that are equal in ``order``: by the other plain columns, then by the text of nested ones."""
    named = {c for c, _ in order}
    nested = [F.to_json(F.struct(F.col(f.name))).asc() for f in df.schema if f.name not in named and isinstance(f.dataType, (ArrayType, MapType, StructType))]
    return [*[F.col(c).asc() for c in tie_names(df, order)], *nested]


def slice_rows(df: DataFrame, ordering: list[Column], start: int, stop: int | None) -> DataFrame:
    """Rows ``start`` (from 0) up to ``stop`` of a total order, without bringing many into one task.

    Few first rows are a plain top-k. Others are sorted over all tasks, and a row's
    rank is its place in its task behind the rows of the tasks before.
    """
    if stop is not None and stop <= NATIVE_LIMIT:
        return df.orderBy(*ordering).offset(start).limit(stop - start)
    placed = cut_lineage(df.orderBy(*ordering).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row a task
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = placed.join(sizes.select("_part", before.alias("_before")), part == F.col("_part"))
    rank = place + F.col("_before")
    wanted = rank >= start if stop is None else (rank >= start) & (rank < stop)
    return ranked.where(wanted).select(*df.columns)


def page(df: DataFrame, order: list[tuple[str, bool]], offset: int, limit: int) -> DataFrame:
    """Rows ``offset+1 … offset+limit`` of the order (integer columns), exactly, at any depth.

    Nulls come first ascending and last descending; rows that tie in the order
    follow by their other columns. Shallow pages are a plain top-k, deep ones a
    filter between two bounds; both give the same rows.
    """
    if limit <= 0:
        return df.where(F.lit(False))
    sorting = [*sort_columns(order), *tie_columns(df, order)]
    if offset + limit <= NATIVE_LIMIT:
        return df.orderBy(*sorting).offset(offset).limit(limit)
    helpers = [(f"_null_{i}", f"_value_{i}", column, down) for i, (column, down) in enumerate(order)]
    rows = df.withColumns(
        {name: value for n, v, c, _ in helpers for name, value in ((n, F.col(c).isNotNull().cast("int")), (v, F.coalesce(F.col(c), F.lit(0))))}
    )
    full = [pair for n, v, _, down in helpers for pair in ((n, down), (v, down))]
    drop = [name for n, v, _, _ in helpers for name in (n, v)]
    first = row_bound(rows, full, offset + 1)
    if first is None:
        return df.where(F.lit(False))
    last = row_bound(rows, full, offset + limit)
    *first, skipped = first
    equal = lambda bound: reduce(lambda a, b: a & b, [F.col(c) == x for (c, _), x in zip(full, bound)])
    if last is not None and last[:-1] == first:
        return slice_rows(rows.where(equal(first)), sorting, skipped - 1, skipped - 1 + limit).orderBy(*sorting).drop(*drop)
    inside = rows.where(_reaches(full, first, after=True) & ~equal(first))
    parts = [slice_rows(rows.where(equal(first)), sorting, skipped - 1, None)]
    if last is not None:
        *last, taken = last
        inside = inside.where(_reaches(full, last, after=False) & ~equal(last))
        parts.append(slice_rows(rows.where(equal(last)), sorting, 0, taken))
    return reduce(DataFrame.unionByName, [inside, *parts]).orderBy(*sorting).drop(*drop)


def page_count(df: DataFrame, size: int) -> DataFrame:
    """One row: total rows and page count, at least one page."""
    pages = F.greatest(F.call_function("div", F.count("*") + (size - 1), F.lit(size).cast("bigint")), F.lit(1))
    return df.agg(F.count("*").cast("bigint").alias("total_rows"), pages.cast("bigint").alias("total_pages"))


def keep_newest(df: DataFrame, cap: int, seq: str = "ingest_seq", keys: tuple[str, ...] = ()) -> DataFrame:
    """Newest-arrived ``cap`` rows, of each key if there are any; 0 keeps everything."""
    return _keep(df, cap, seq, True, keys)


def keep_first(df: DataFrame, cap: int, seq: str = "ingest_seq", keys: tuple[str, ...] = ()) -> DataFrame:
    """First-arrived ``cap`` rows, of each key if there are any; 0 keeps everything."""
    return _keep(df, cap, seq, False, keys)


def _keep(df: DataFrame, cap: int, seq: str, descending: bool, keys: tuple[str, ...]) -> DataFrame:
    """Never more than ``cap`` rows: of rows with equal numbers the first by their other columns; null numbers come last."""
    if cap <= 0:
        return df
    if keys:
        numbered = df.withColumn("_unnumbered", F.col(seq).isNull())
        order = [("_unnumbered", False), (seq, descending)]
        named = {c for c, _ in order} | set(keys)
        return top_n_per_key(numbered, list(keys), order, cap, rank="_rank", ties=[c for c in tie_names(df, order) if c not in named]).drop("_rank", "_unnumbered")
    ties = tie_columns(df, [(seq, descending)])
    found = kth_place(df, seq, cap, descending)
    if found is None:
        numbered, without = df.where(F.col(seq).isNotNull()), df.where(F.col(seq).isNull())
        rest = cap - numbered.count()
        return df if without.count() <= rest else numbered.unionByName(slice_rows(without, ties, 0, rest))
    value, remaining, equal = found
    if remaining == equal:
        return df.where(F.col(seq) >= value if descending else F.col(seq) <= value)
    beyond = df.where(F.col(seq) > value if descending else F.col(seq) < value)
    return beyond.unionByName(slice_rows(df.where(F.col(seq) == value), ties, 0, remaining))


def evicted(df: DataFrame, cap: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """How many rows an arrival cap removes, per key."""
    over = F.greatest(F.count("*") - F.lit(cap), F.lit(0)) if cap > 0 else F.lit(0)
    return df.groupBy(*keys).agg(over.cast("bigint").alias("evicted"))


def top_n_per_key(
    df: DataFrame, keys: list[str], order: list[tuple[str, bool]], n: int, salts: int = 64, rank: str = "rank", ties: list[str] | None = None
) -> DataFrame:
    """Exact first ``n`` rows per key, with their rank; rows that are equal in ``order`` follow by the columns ``ties``.

    Up to ``NATIVE_LIMIT`` Spark cuts each group before the shuffle by itself.
    Above it a hot key is ranked in ``salts`` slices first, so the final
    ranking never sees more than ``n * salts`` rows of a key.
    """
    ties = ties or []
    ordering = [*sort_columns(order), *[F.col(c).asc() for c in ties]]
    if n > NATIVE_LIMIT:
        salt = F.pmod(F.xxhash64(*[F.col(c) for c, _ in order], *ties), F.lit(salts))
        slices = Window.partitionBy(*keys, "_salt").orderBy(*ordering)
        df = (
            df.withColumn("_salt", salt)
            .withColumn("_slice_rank", F.row_number().over(slices))
            .where(F.col("_slice_rank") <= n)
            .drop("_salt", "_slice_rank")
        )
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*ordering)))
    return ranked.where(F.col(rank) <= n)


def first_by(value: Column, *order: Column, where: Column | None = None) -> Column:
    """``value`` of the row with the smallest order tuple, as a partial aggregate."""
    return F.min_by(value, _order_struct(order, where, value))


def last_by(value: Column, *order: Column, where: Column | None = None) -> Column:
    """``value`` of the row with the largest order tuple, as a partial aggregate."""
    return F.max_by(value, _order_struct(order, where, value))


def _order_struct(order: tuple[Column, ...], where: Column | None, value: Column) -> Column:
    packed = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    return packed if where is None else F.when(where, packed)


def lag_by_chunk(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column, columns: list[str], prefix: str = "prev_"
) -> DataFrame:
    """Previous row's ``columns`` per key, computed inside order-preserving chunks.

    ``chunk`` must be non-decreasing along ``order``; a hot key is spread over
    its chunks and only one boundary row per chunk is carried across.
    """
    chunked = df.withColumn("_chunk", chunk)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    packed = F.struct(*[F.col(c).alias(c) for c in columns])
    local = chunked.withColumns(
        {"_local": F.lag(packed).over(inside), "_first": F.row_number().over(inside) == 1}
    )
    carried = (
        chunked.groupBy(*keys, "_chunk")
        .agg(last_by(packed, *[F.col(c) for c in order]).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_chunk")))
        .drop("_last")
    )
    joined = null_safe_join(local, carried, [*keys, "_chunk"], "left")
    value = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_local"))
    return joined.withColumns({prefix + c: value[c] for c in columns}).drop(
        "_chunk", "_local", "_first", "_carry"
    )


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi join in which null keys match; the right key columns are dropped."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in keys])
