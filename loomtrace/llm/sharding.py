"""Sharding by sampled splitters: size-weighted key samples give quantile boundaries, overfull ranges are cut again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import no_text, written

#: Ranges (a power of two), expected size of the key sample, and how many times the mean makes a range overfull.
RANGES, SAMPLE, OVERFULL = 512, 20_000, 2.0
OVERHEAD = 16


def _range_of(key: Column, splitters: list[int]) -> Column:
    """Number of splitters at or below the key, by binary search: one comparison per bit."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(splitters).bit_length()))])
    bounds = F.array(*map(F.lit, splitters)).cast("array<bigint>")

    def step(at: Column, width: Column) -> Column:
        fits = (at + width <= F.lit(len(splitters))) & (F.get(bounds, at + width - 1) <= key)
        return at + F.when(fits, width).otherwise(F.lit(0))

    return F.aggregate(steps, F.lit(0), step)


def weighted_splitters(keyed: DataFrame, total: int, ranges: int, sample: int) -> list[int]:
    """At most `ranges` - 1 boundaries of the key, so that ranges hold about equal bytes.

    A row is drawn with probability size * sample / total, by a hash of its id, so that a draw can be repeated; rows above
    total / sample are sure to be drawn and count with their own size. About `sample` rows are drawn, whatever the input.
    """
    every = max(total / sample, 1.0)
    chance = F.pmod(F.xxhash64("id", "crc", F.lit(11)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = keyed.where(chance < F.col("size") / every).select("key", F.greatest(F.col("size").cast("double"), F.lit(every)).alias("weight"))
    summed = drawn.groupBy("key").agg(F.sum("weight").alias("weight"))
    # One task sorts the sample, whose size is a parameter.
    upto = F.sum("weight").over(Window.orderBy("key"))
    placed = summed.select("key", "weight", upto.alias("upto"))
    all_weight = placed.agg(F.max("upto")).first()[0]
    if not all_weight:
        return []
    part = F.floor(F.col("upto") * ranges / F.lit(all_weight))
    before = F.floor((F.col("upto") - F.col("weight")) * ranges / F.lit(all_weight))
    return [row.key for row in placed.where((part > before) & (part < ranges)).select("key").orderBy("key").collect()]


def shard(
    docs: DataFrame,
    shards: int = 40,
    ranges: int = RANGES,
    sample: int = SAMPLE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Shards 0 to `shards` - 1 of near-equal bytes, each row's size, checksum and gapless place in its shard.

    Keys are hashes of the text, so equal texts lie side by side and part only where a shard is full. Ranges between sampled
    splitters are cut again by a hash of the id where they hold more than their share, as one text may be a third of all rows.
    A row's shard is that of the bytes before it, so shards differ by less than the largest row. Null texts count as empty
    (size 16); null ids, repeated rows and extra columns are kept apart and harmless; an empty table gives no rows.
    """
    text = F.col(text_col)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + OVERHEAD
    kind = docs.schema[id_col].dataType
    keyed = written(
        docs.select(
            docs[id_col].alias("id"),
            size.alias("size"),
            F.crc32(F.encode(no_text(text_col), "UTF-8")).alias("crc"),
            F.xxhash64(no_text(text_col)).alias("key"),
        ),
        "keys",
    )
    total = keyed.agg(F.sum("size")).first()[0] or 0
    splitters = weighted_splitters(keyed, total, ranges, sample)
    ranged = keyed.withColumn("range", _range_of(F.col("key"), splitters) if splitters else F.lit(0))
    fair = max(total / ranges, 1.0)
    # One row per range; at most `ranges` of them.
    loads = ranged.groupBy("range").agg(F.sum("size").alias("bytes"))
    pieces = F.when(F.col("bytes") > OVERFULL * fair, F.ceil(F.col("bytes") / F.lit(fair))).otherwise(F.lit(1)).cast("int")
    cut = ranged.join(F.broadcast(loads.select("range", pieces.alias("pieces"))), "range")
    cut = cut.withColumn("sub", F.pmod(F.xxhash64("id", F.lit(7)), F.col("pieces")).cast("int"))
    parts = cut.groupBy("range", "sub").agg(F.sum("size").alias("bytes"))
    # At most ranges + ranges / OVERFULL rows and their cuts: a few thousand, a number set by parameters.
    before = Window.orderBy("range", "sub").rowsBetween(Window.unboundedPreceding, -1)
    begins = parts.select("range", "sub", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("range", "sub").orderBy("key", "crc", "id")
    running = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = cut.join(F.broadcast(begins), ["range", "sub"]).withColumn("at", F.col("begin") + running)
    home = F.least(F.floor(F.col("at") * F.lit(shards) / F.lit(max(total, 1))), F.lit(shards - 1)).cast("int")
    placed = placed.withColumn("shard", home).withColumn("nth", F.row_number().over(inside))
    counts = placed.groupBy("shard", "range", "sub").agg(F.count("*").alias("rows"), F.min("nth").alias("least"))
    order = Window.partitionBy("shard").orderBy("range", "sub").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "range", "sub", "least", F.coalesce(F.sum("rows").over(order), F.lit(0)).alias("rows_before"))
    slotted = placed.join(F.broadcast(firsts), ["shard", "range", "sub"])
    return slotted.select(
        F.col("id").cast(kind).alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("rows_before") + F.col("nth") - F.col("least")).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
