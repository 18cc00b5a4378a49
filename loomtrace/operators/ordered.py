"""Ordered group operators that keep working when one group holds a large share of all rows.

A window over `PARTITION BY group` sorts a whole group in one task. Here every group is cut into
pieces of its order column first; windows run inside a piece, and only one row per piece meets
the other pieces of its group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE = "__piece"
SALTS = 64


def with_neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: dict[str, str],
    piece: Column,
    back: bool = False,
) -> DataFrame:
    """Add columns of the next (or, with `back`, the previous) row of the group.

    `piece` must grow with `order`. `values` maps a new column name to the column read from the neighbour.
    """
    cut = df.withColumn(PIECE, piece)
    inside = Window.partitionBy(*keys, PIECE).orderBy(order)
    picked = F.struct(*[F.col(source).alias(name) for name, source in values.items()])
    step, other = (F.lag, F.lead) if back else (F.lead, F.lag)
    local = cut.withColumn("__near", step(picked).over(inside)).withColumn("__other", other(order).over(inside))
    # The outermost row of a piece has no neighbour on the far side; both uses share one shuffle of the rows.
    edges = local.where(F.col("__other").isNull()).select(*keys, PIECE, picked.alias("__edge"))
    across = Window.partitionBy(*keys).orderBy(PIECE)
    edges = edges.withColumn("__far", step("__edge").over(across)).drop("__edge")
    joined = local.join(edges, [*keys, PIECE], "left")
    near = F.coalesce("__near", "__far")
    return joined.select(*df.columns, *[near[name].alias(name) for name in values])


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    amount: Column,
    piece: Column,
    name: str,
    inclusive: bool = True,
) -> DataFrame:
    """Running sum of `amount` in group order as a two-phase prefix sum.

    Pieces must follow the order. Their totals are summed per group, then added to the sum inside the piece.
    """
    cut = df.withColumn(PIECE, piece).withColumn("__amount", amount)
    totals = cut.groupBy(*keys, PIECE).agg(F.sum("__amount").alias("__total"))
    before = Window.partitionBy(*keys).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("__offset", F.coalesce(F.sum("__total").over(before), F.lit(0))).drop("__total")
    upto = 0 if inclusive else -1
    inside = Window.partitionBy(*keys, PIECE).orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
    summed = cut.withColumn("__inside", F.coalesce(F.sum("__amount").over(inside), F.lit(0)))
    joined = summed.join(offsets, [*keys, PIECE])
    return joined.select(*df.columns, (F.col("__offset") + F.col("__inside")).cast("bigint").alias(name))


def first_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    limit: Column | int,
    rank: str | None = None,
    salt_by: Sequence[str] | None = None,
) -> DataFrame:
    """The first `limit` rows of every group.

    Rows are cut to the limit inside salted parts of the group before the group itself is ranked,
    so no task sees more than salts x limit rows of one group.
    """
    limit = F.lit(limit) if isinstance(limit, int) else limit
    salt = F.pmod(F.xxhash64(*(salt_by or df.columns)), F.lit(SALTS))
    salted = df.withColumn("__salt", salt)
    part = Window.partitionBy(*keys, "__salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    cut = salted.withColumn("__rank", F.row_number().over(part)).where(F.col("__rank") <= limit).drop("__rank", "__salt")
    ranked = cut.withColumn("__rank", F.row_number().over(whole)).where(F.col("__rank") <= limit)
    return ranked.withColumnRenamed("__rank", rank) if rank else ranked.drop("__rank")


def hash_ordinals(df: DataFrame, keys: Sequence[str], digest: str, name: str, ties: Sequence[Column] = ()) -> DataFrame:
    """Zero-based position of each row in the digest order of its group.

    The leading four hex digits of the digest cut a group into at most 65536 even pieces.
    """
    return running_sum(
        df,
        keys,
        [F.col(digest), *ties],
        F.lit(1),
        F.substring(digest, 1, 4),
        name,
        inclusive=False,
    )


def quantile_piece(value: Column) -> Column:
    """Bucket of a non-negative number that grows with it: its size class and the leading eight bits."""
    v = value.cast("double")
    exponent = F.when(v < 1.0, F.lit(0)).otherwise(F.floor(F.log2(F.greatest(v, F.lit(1.0)))).cast("int"))
    scale = F.pow(F.lit(2.0), exponent.cast("double"))
    # log2 can be one off next to a power of two; clamping keeps pieces in value order.
    detail = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v / scale - 1.0) * 256.0).cast("int")))
    low = F.floor(v * 256.0).cast("int")
    return F.when(v < 1.0, F.greatest(low - 256, F.lit(-256))).otherwise(exponent * 256 + detail)


def nearest_rank_quantiles(df: DataFrame, keys: Sequence[str], value: str, percents: dict[str, int]) -> DataFrame:
    """Exact nearest-rank quantiles per group, without bringing a group to one task.

    Equal values are counted first. The counts of coarse pieces then tell which pieces hold a wanted rank;
    only the values of those pieces are put in order.
    """
    present = df.where(F.col(value).isNotNull())
    counted = present.groupBy(*keys, value).agg(F.count("*").alias("__n")).withColumn(PIECE, quantile_piece(F.col(value)))
    pieces = counted.groupBy(*keys, PIECE).agg(F.sum("__n").alias("__size"))
    group = Window.partitionBy(*keys)
    before = group.orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("__before", F.coalesce(F.sum("__size").over(before), F.lit(0))).withColumn(
        "__all", F.sum("__size").over(group)
    )
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.call_function("div", F.col("__all") * percent + 99, F.lit(100)).alias("rank"))
            for name, percent in percents.items()
        ]
    )
    holding = F.filter(
        wanted, lambda w: (w["rank"] > F.col("__before")) & (w["rank"] <= F.col("__before") + F.col("__size"))
    )
    hits = placed.withColumn("__wanted", holding).where(F.size("__wanted") > 0)
    # `hits` has at most one row per group and percentile.
    inside = Window.partitionBy(*keys, PIECE).orderBy(value)
    located = (
        counted.join(F.broadcast(hits), [*keys, PIECE]) if not keys else counted.join(hits, [*keys, PIECE])
    ).withColumn("__seen", F.col("__before") + F.sum("__n").over(inside))
    exploded = located.select(*keys, value, "__seen", F.explode("__wanted").alias("__w")).where(
        F.col("__seen") >= F.col("__w.rank")
    )
    return exploded.groupBy(*keys).agg(
        *[F.min(F.when(F.col("__w.name") == name, F.col(value))).alias(name) for name in percents]
    )


def computed_once(df: DataFrame) -> DataFrame:
    """Keep later filters from being pushed below the costly columns of this frame, which would copy them into the filter.

    Spark does not move a filter below a projection with a non-deterministic column; the row id costs nothing.
    """
    marked = df.withColumn("__row", F.monotonically_increasing_id())
    return marked.where(F.col("__row") >= 0).drop("__row")
