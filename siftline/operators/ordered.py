"""Order-aware building blocks that stay parallel when one key holds much of the data.

A plain window over a hot key would run in a single task. Here the rows of a key are cut into blocks by
their order column, each block is windowed on its own, and one summary row per block carries totals
forward. The order column is unique inside a key, so a block never holds more than ``block_rows`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BLOCK_ROWS = 1 << 14
SPREAD = 32


def _block(seq: str, block_rows: int) -> Column:
    # Not nullable: no filter is inferred for it on one side of the join only.
    return F.coalesce(F.expr(f"{seq} div {block_rows}"), F.lit(0)).alias("_blk")


def _totals(rows: DataFrame, base: DataFrame, at: list[str], *aggs: Column) -> DataFrame:
    """One summary row per block.

    The hash reads every column of ``base``, so the summaries and the windows need the same columns and Spark
    reuses one shuffle instead of pruning the two apart and running the input twice.
    """
    whole = F.max(F.xxhash64(*base.columns)).alias("_whole")
    return rows.groupBy(*at).agg(*aggs, whole).filter(F.col("_whole").isNotNull()).drop("_whole")


def running(
    df: DataFrame,
    keys: list[str],
    seq: str,
    block_rows: int = BLOCK_ROWS,
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    lags: dict[str, Column] | None = None,
    lasts_before: dict[str, Column] | None = None,
) -> DataFrame:
    """Add running columns per key in ``seq`` order.

    ``sums``, ``maxes`` and ``lasts`` (last non-null value) include the current row; ``lags`` holds the
    value of the row before and ``lasts_before`` the last non-null value before the row. Key columns are
    never NULL. The rows are shuffled once: block totals and windows read the same exchange.
    """
    sums, maxes, lasts, lags, befores = sums or {}, maxes or {}, lasts or {}, lags or {}, lasts_before or {}
    values = {**sums, **maxes, **lasts, **lags, **befores}
    at = [*keys, "_blk"]
    base = df.select(
        "*", _block(seq, block_rows), *[v.alias(f"_v_{n}") for n, v in values.items()]
    ).repartition(*at)
    order = W.partitionBy(*at).orderBy(seq)
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)

    def local(n: str) -> Column:
        v = F.col(f"_v_{n}")
        if n in sums:
            return F.sum(v).over(upto)
        if n in maxes:
            return F.max(v).over(upto)
        if n in lasts:
            return F.last(v, ignorenulls=True).over(upto)
        if n in befores:
            return F.last(v, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
        return F.lag(v).over(order)

    def total(n: str) -> Column:
        v = F.col(f"_v_{n}")
        if n in sums:
            return F.sum(v)
        if n in maxes:
            return F.max(v)
        if n in lasts or n in befores:
            return F.max_by(v, F.when(v.isNotNull(), F.col(seq)))
        return F.max_by(v, F.col(seq))

    before = W.partitionBy(*keys).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)

    def carried(n: str) -> Column:
        t = F.col(f"_t_{n}")
        if n in sums:
            return F.sum(t).over(before)
        if n in maxes:
            return F.max(t).over(before)
        if n in lasts or n in befores:
            return F.last(t, ignorenulls=True).over(before)
        return F.last(t).over(before)

    totals = _totals(base, base, at, *[total(n).alias(f"_t_{n}") for n in values])
    carry = totals.select(*at, *[carried(n).alias(f"_c_{n}") for n in values])
    rows = base.select("*", F.row_number().over(order).alias("_rn"), *[local(n).alias(f"_l_{n}") for n in values])
    joined = rows.join(carry, at)

    def merged(n: str) -> Column:
        loc, car = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        if n in sums:
            return F.coalesce(loc, F.lit(0)) + F.coalesce(car, F.lit(0))
        if n in maxes:
            return F.greatest(loc, car)
        if n in lasts or n in befores:
            return F.coalesce(loc, car)
        return F.when(F.col("_rn") == 1, car).otherwise(loc)

    return joined.select(*df.columns, *[merged(n).alias(n) for n in values])


def as_of(rows: DataFrame, versions: DataFrame, keys: list[str], seq: str, version: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows with the last ``version`` of their key from before their ``seq``, NULL where there is none.

    Both sides have ``keys`` and ``seq``, which is unique inside a key on each side; a version at a row's own ``seq`` comes
    after the row. Rows and versions are one sequence, cut into blocks, so a hot key is spread and never compared pairwise.
    """
    kind = versions.schema[version].dataType
    row = F.struct(*rows.columns)
    both = rows.select(*keys, (2 * F.col(seq)).alias("_at"), row.alias("_row"), F.lit(None).cast(kind).alias("_version"))
    later = versions.select(*keys, (2 * F.col(seq) + 1).alias("_at"), F.lit(None).cast(both.schema["_row"].dataType).alias("_row"), F.col(version).alias("_version"))
    found = running(both.unionByName(later), keys, "_at", block_rows, lasts_before={"_known": F.col("_version")})
    return found.filter(F.col("_row").isNotNull()).select("_row.*", F.col("_known").alias(version))


def streaks(df: DataFrame, keys: list[str], seq: str, hit: str, out: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Length of the current streak of true ``hit`` values per key in ``seq`` order (0 on false ones)."""
    at = [*keys, "_blk"]
    base = df.select("*", _block(seq, block_rows)).repartition(*at)
    order = W.partitionBy(*at).orderBy(seq)
    local = base.withColumn("_n", F.row_number().over(order)).withColumn(
        "_end", F.max(F.when(~F.col(hit), F.col("_n"))).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    )
    totals = _totals(local, base, at, F.max("_n").cast("long").alias("_rows"), F.max("_end").alias("_last"))
    blocks = W.partitionBy(*keys).orderBy("_blk")
    summed = totals.withColumn("_upto", F.sum("_rows").over(blocks.rowsBetween(W.unboundedPreceding, W.currentRow)))
    # A block that holds an end of a streak leaves its own tail; the blocks after it add all their rows.
    tail = F.when(F.col("_last").isNotNull(), F.col("_rows") - F.col("_last") - F.col("_upto"))
    carried = F.coalesce(F.last(tail, ignorenulls=True).over(blocks.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    carry = summed.select(*at, (carried + F.col("_upto") - F.col("_rows")).alias("_carry"))
    length = F.when(F.col("_end").isNotNull(), F.col("_n") - F.col("_end")).otherwise(F.col("_n") + F.col("_carry"))
    return local.join(carry, at).select(*df.columns, length.cast("long").alias(out))


def top_k(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    k: int,
    spread_on: str,
    spread: int = SPREAD,
    rank: str | None = None,
) -> DataFrame:
    """First ``k`` rows of every key, exactly.

    Rows are ranked inside ``spread`` slices of each key first, so the final rank of a hot key sees at most
    ``spread * k`` rows.
    """
    out = rank or "_rank"
    cols = df.columns
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(spread_on), F.lit(spread)))
    near = sliced.withColumn("_near", F.row_number().over(W.partitionBy(*keys, "_slice").orderBy(*order)))
    near = near.filter(F.col("_near") <= k)
    final = near.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(out) <= k)
    return final.select(*cols, *([out] if rank else []))


def salted_join(
    rows: DataFrame,
    table: DataFrame,
    on: list[str],
    spread_on: str,
    how: str = "inner",
    spread: int = SPREAD,
) -> DataFrame:
    """Join rows to a table with one row per key, spreading each key over ``spread`` tasks.

    No broadcast is asked for: Spark picks one where its own size check allows it, and otherwise the
    salted shuffle keeps a hot key from landing in one task.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_on), F.lit(spread)).cast("int"))
    right = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")
