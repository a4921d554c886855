"""Range join as an equi-join on time blocks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The smallest blocks are 2 ** 26 ms long, about 19 hours; those of the next level 8 times as long.
BASE_BITS = 26
LEVEL_BITS = 3

# A block with more ranges than this is dealt out, its points go to each part.
RANGES_PER_PART = 4096


def floor_div(value: Column, size: int) -> Column:
    return F.call_function("div", value - F.pmod(value, F.lit(size)), F.lit(size))


def covering_blocks(first: str, end: str, base_bits: int, level_bits: int = LEVEL_BITS) -> Column:
    """(level, block) pairs that cover base blocks first to end - 1, each once.

    On each level at most two runs of less than 2 ** level_bits blocks are left over by the longer
    blocks of the next level, so a range has O(log span) blocks. Columns are SQL texts.
    """
    size = 1 << level_bits
    levels = (63 - base_bits) // level_bits
    runs = []
    for level in range(levels + 1):
        low, high = f"-shiftright(-({first}), {level_bits * level})", f"shiftright({end}, {level_bits * level})"
        above = level_bits * (level + 1)
        next_low, next_high = f"-shiftright(-({first}), {above})", f"shiftright({end}, {above})"
        if level == levels:
            next_low = next_high = "0"
        for start, stop in (
            (low, f"if({next_low} < {next_high}, {next_low} * {size}, {high})"),
            (f"if({next_low} < {next_high}, {next_high} * {size}, {high})", high),
        ):
            blocks = f"transform(sequence({start}, {stop} - 1), b -> struct({level} as level, b as block))"
            runs.append(f"if({start} < {stop}, {blocks}, array())")
    return F.expr(f"flatten(array({', '.join(runs)}))")


def within_ranges(
    points: DataFrame,
    at: str,
    ranges: DataFrame,
    range_id: str = "range_id",
    base_bits: int = BASE_BITS,
    ranges_per_part: int = RANGES_PER_PART,
) -> DataFrame:
    """Pairs of points and half-open ranges [from_ms, to_ms) that hold them; null bounds are open.

    A range is written as the blocks that cover it, a point as its block on each level that some
    range uses, so each pair meets in exactly one block. Open bounds end where the points do; how
    far that is matters little.
    """
    span = points.agg(F.struct(F.min(at).alias("low"), F.max(at).alias("high"))).scalar()
    low, high = F.col("_low"), F.col("_high")
    closed = (
        ranges.withColumns({"_low": span.getField("low"), "_high": span.getField("high")})
        .where(F.col("to_ms").isNull() | (F.col("to_ms") > low))
        .withColumn("_from", F.greatest(F.coalesce("from_ms", low), low))
        .withColumn("_last", F.when(F.col("to_ms") <= high, F.col("to_ms") - 1).otherwise(high))
        .where("_from <= _last")
        .withColumn("_first_block", F.shiftright("_from", base_bits))
        .withColumn("_end_block", F.shiftright("_last", base_bits) + 1)
    )
    blocks = covering_blocks("_first_block", "_end_block", base_bits)
    covered = closed.select(*ranges.columns, "_from", "_last", F.inline(blocks))
    parts = covered.groupBy("level", "block").agg(
        F.ceil(F.count(F.lit(1)) / ranges_per_part).cast("int").alias("_parts")
    )
    # at most one level per LEVEL_BITS bits of a long
    levels = parts.agg(F.sort_array(F.collect_set("level"))).scalar()
    own = "transform(_levels, l -> struct(l as level, shiftright({at}, {base} + {bits} * l) as block))"
    placed = points.withColumn("_levels", levels).select(
        *points.columns, F.inline(F.expr(own.format(at=at, base=base_bits, bits=LEVEL_BITS)))
    )
    dealt_points = placed.join(parts, ["level", "block"]).withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    )
    dealt_ranges = covered.join(parts, ["level", "block"]).withColumn(
        "_part", F.pmod(F.xxhash64(range_id), F.col("_parts"))
    )
    pairs = dealt_points.drop("_parts").join(dealt_ranges.drop("_parts"), ["level", "block", "_part"])
    inside = (F.col(at) >= F.col("_from")) & (F.col(at) <= F.col("_last"))
    return pairs.where(inside).drop("level", "block", "_part", "_from", "_last")
