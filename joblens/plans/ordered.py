"""Ordered per-key logic for keys that are too big for one task.

A window over a key puts all rows of the key into one task. Here the rows of hot keys are cut, in
order, at points taken from the whole table, so that between two points there are only so many rows
whatever their keys. Windows run per chunk, and what a chunk needs to know about its neighbours
comes from a summary with one row per chunk.

The input is read twice: once for a sketch of its keys and order values, once for its rows. The
summary is made from the rows as they were shuffled. They travel as whole structs, opened by a
generator, which the optimizer takes no columns out of: both sides of the join then ask for the same
columns and Spark reads one exchange. Select the columns needed before.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T


KEY = "_key"
CHUNK = "_chunk"
ROW = "_row"

# A key with at least this many rows is cut.
HOT_ROWS = 4_000_000

# An order column is cut at so many points less one.
CUTS = 1024

# Hot keys that can be told apart: one has at least this share of the rows, or it needs no cutting.
TRACKED_KEYS = 4096
HOT_KEYS = 256

# Size of the quantile sketch; its rank error is about 0.07 % of the rows.
SKETCH = 8192

# The sketches of all tasks are merged in so many groups first.
MERGE_GROUPS = 64

# Places among the points of so many order values fit one chunk number.
MOST_VALUES = 5

# A text is ordered by this many times seven bytes from its start.
TEXT_PARTS = 3
LEAST = -(2**63)


def order_values(df: DataFrame, column: str) -> list[Column]:
    """Long columns that together rise with `column`; nulls come first, as in a window's order.

    Equal values have equal images. Where different values have equal images, too, their order in a
    chunk decides, so images only need to be good enough to cut by.
    """
    kind, value = df.schema[column].dataType, F.col(column)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        raw = value.cast("binary")
        images = [
            F.conv(F.rpad(F.hex(F.substring(raw, 7 * n + 1, 7)), 14, "0"), 16, 10).cast("bigint")
            for n in range(TEXT_PARTS)
        ]
    elif isinstance(kind, T.TimestampType):
        images = [F.unix_micros(value)]
    elif isinstance(kind, T.TimestampNTZType):
        seconds = (F.hour(value) * 60 + F.minute(value)) * 60 + F.second(value)
        micros = F.date_format(value, "SSSSSS").cast("bigint")
        images = [(F.unix_date(value.cast("date")).cast("bigint") * 86400 + seconds) * 1000000 + micros]
    elif isinstance(kind, T.DateType):
        images = [F.unix_date(value).cast("bigint")]
    elif isinstance(kind, T.BooleanType):
        images = [value.cast("int").cast("bigint")]
    elif isinstance(kind, T.IntegralType):
        images = [value.cast("bigint")]
    else:
        raise TypeError(f"cannot cut a key in the order of {column} ({kind.simpleString()})")
    return [F.coalesce(image, F.lit(LEAST)) for image in images]


def sketch(
    rows: DataFrame, key_hash: Column, images: list[Column], hot_rows: int, cuts: int
) -> Column:
    """One value: `hot` (hashes of the keys to cut) and `points0`, `points1`, ... (where to cut).

    Merged from a sketch per task; its size does not depend on the number of rows.
    """
    # one literal instead of one per rank
    shares = ",".join(str(at / cuts) for at in range(1, cuts))
    ranks = F.split(F.lit(shares), ",").cast("array<double>")
    sketched = {f"s{n}": F.kll_sketch_agg_bigint(F.col(f"o{n}"), SKETCH) for n in range(len(images))}
    merged = {f"s{n}": F.kll_merge_agg_bigint(F.col(f"s{n}")) for n in range(len(images))}
    narrow = rows.select(
        F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)).alias("group"),
        key_hash.alias("k"),
        *[image.alias(f"o{n}") for n, image in enumerate(images)],
    )
    groups = narrow.groupBy("group").agg(
        F.expr(f"approx_top_k_accumulate(k, {TRACKED_KEYS})").alias("keys"),
        *[column.alias(name) for name, column in sketched.items()],
    )
    # grouped, so that an empty input gives no row and no keys to cut
    whole = groups.groupBy(F.lit(1).alias("all")).agg(
        F.expr(f"approx_top_k_combine(keys, {TRACKED_KEYS})").alias("keys"),
        *[column.alias(name) for name, column in merged.items()],
    )
    counted = F.expr(f"approx_top_k_estimate(keys, {HOT_KEYS})")
    hot = F.transform(F.filter(counted, lambda k: k["count"] >= hot_rows), lambda k: k["item"])
    points = {
        f"points{n}": F.array_sort(F.array_distinct(F.kll_sketch_get_quantile_bigint(f"s{n}", ranks)))
        for n in range(len(images))
    }
    return whole.select(
        F.struct(hot.alias("hot"), *[column.alias(name) for name, column in points.items()])
    ).scalar()


def search(values: int, cuts: int) -> str:
    """SQL from {rows} to (KEY, ROW, CHUNK): the place of each value among its points, in halving steps.

    A place is twice how many points are at or before the value, less one if it is a point itself.
    Rows at a point may be many: they are cut by the next value, too.

    One projection per step keeps the search in generated code, where the points are one shared
    object; they are dropped before the rows go anywhere. A step has one comparison a value so that
    the generated method stays small enough to be compiled.
    """
    at = range(values)
    kept = f"{KEY}, {ROW}, _is_hot, " + ", ".join(f"_value{n}, _points{n}" for n in at)
    text = f"select {kept}, {', '.join(f'0 as _passed{n}' for n in at)} from {{rows}}"
    for bit in range(cuts.bit_length() - 1, -1, -1):
        ahead = [f"_passed{n} + {1 << bit}" for n in at]
        passed = [
            f"case when try_element_at(_points{n}, {ahead[n]}) <= _value{n} then {ahead[n]}"
            f" else _passed{n} end as _passed{n}"
            for n in at
        ]
        text = f"select {kept}, {', '.join(passed)} from ({text})"
    places = [
        f"2 * _passed{n} - if(try_element_at(_points{n}, greatest(_passed{n}, 1)) = _value{n}, 1, 0) as _place{n}"
        for n in at
    ]
    text = f"select {KEY}, {ROW}, _is_hot, {', '.join(places)} from ({text})"
    number = ""
    for n in reversed(at):
        number = f"_place{n} * {(2 * cuts + 1) ** (values - 1 - n)}L" + (
            f" + if(_place{n} % 2 = 1, {number}, 0L)" if number else ""
        )
    # a generator keeps the optimizer from looking for constraints in all of this
    chunk = f"named_struct('{CHUNK}', if(_is_hot, 1L + {number}, 0L))"
    return f"select {KEY}, {ROW}, inline(array({chunk})) from ({text})"


class Chunks:
    """Rows of `df` with a chunk number that grows with `order` within each `key`.

    `order` must tell the rows of a key apart. Keys of fewer than `hot_rows` rows are one chunk,
    number 0. Null is a key like any other. `rows` has two more columns than `df`, KEY and CHUNK,
    which the windows are over.
    """

    def __init__(
        self, df: DataFrame, key: list[str], order: list[str], hot_rows: int = HOT_ROWS, cuts: int = CUTS
    ):
        self.order = order
        key_hash = F.xxhash64(*key)
        images = [image for name in order for image in order_values(df, name)]
        if len(images) > MOST_VALUES:
            raise ValueError(f"cannot cut a key by {len(images)} order values")
        found = sketch(df, key_hash, images, hot_rows, cuts)
        hot = F.coalesce(F.array_contains(found.getField("hot"), key_hash), F.lit(False))
        rows = df.select(
            F.struct(*key).alias(KEY),
            F.struct(*[F.col(f"`{name}`") for name in df.columns]).alias(ROW),
            hot.alias("_is_hot"),
            *[F.when(hot, image).alias(f"_value{n}") for n, image in enumerate(images)],
            *[found[f"points{n}"].alias(f"_points{n}") for n in range(len(images))],
        )
        cut = df.sparkSession.sql(search(len(images), cuts), rows=rows)
        self.rows = cut.repartition(KEY, CHUNK).select(KEY, CHUNK, F.inline(F.array(ROW)))

    def whole(self) -> WindowSpec:
        """All rows of a chunk."""
        return Window.partitionBy(KEY, CHUNK)

    def ordered(self) -> WindowSpec:
        """The rows of a chunk in order."""
        return self.whole().orderBy(*self.order)

    def at(self) -> Column:
        """Position of a row, for picking the first or last row of a chunk with min_by / max_by."""
        return F.struct(*self.order)

    def with_neighbours(
        self,
        rows: DataFrame,
        summary: dict[str, Column],
        carried: Callable[[WindowSpec], dict[str, Column]],
        before: Callable[[WindowSpec], dict[str, Column]] = lambda over: {},
    ) -> DataFrame:
        """Attach to each row what other chunks of its key tell it.

        `summary` aggregates one chunk; `carried` looks over the chunks of one key in order, and may
        use columns that `before` has added to them in the same way. Rows of other keys get nulls. The join is on what the windows partition by, so the rows are not
        shuffled again. A filter before the aggregate would move below the shuffle.
        """
        summed = rows.groupBy(KEY, CHUNK).agg(
            F.max(CHUNK).alias("_number"),
            *[column.alias(name) for name, column in summary.items()],
        )
        chunks = summed.where(F.col("_number") > 0)
        over_chunks = Window.partitionBy(KEY).orderBy(CHUNK)
        outlook = chunks.withColumns(before(over_chunks)).select(
            F.col(KEY).alias("_of"),
            F.col(CHUNK).alias("_in"),
            *[column.alias(name) for name, column in carried(over_chunks).items()],
        )
        here = (F.col(KEY) == F.col("_of")) & (F.col(CHUNK) == F.col("_in"))
        return rows.join(outlook, here, "left").drop("_of", "_in")

    def done(self, rows: DataFrame) -> DataFrame:
        return rows.drop(KEY, CHUNK)


def running_sums(chunks: Chunks, rows: DataFrame, sums: dict[str, str]) -> DataFrame:
    """Adds for each (name, column) the sum of the column over the rows of the key before a row."""
    before = chunks.ordered().rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns({f"_so_far_{name}": F.sum(column).over(before) for name, column in sums.items()})
    seen = chunks.with_neighbours(
        local,
        {f"_total_{name}": F.sum(column) for name, column in sums.items()},
        lambda over: {
            f"_before_{name}": F.sum(f"_total_{name}").over(
                over.rowsBetween(Window.unboundedPreceding, -1)
            )
            for name in sums
        },
    )
    totals = {
        name: (
            F.coalesce(f"_so_far_{name}", F.lit(0)) + F.coalesce(f"_before_{name}", F.lit(0))
        ).cast("bigint")
        for name in sums
    }
    return seen.withColumns(totals).drop(*[f"_{part}_{name}" for part in ("so_far", "before") for name in sums])


def with_segment(
    df: DataFrame, key: list[str], order: list[str], size: Column, segment_size: int, name: str, **sizes
) -> DataFrame:
    """Adds a number that grows with the order of a key's rows, so that the rows of a number are
    together smaller than `segment_size` and one row more. A row that is larger leaves numbers out."""
    chunks = Chunks(df.withColumn("_size", size), key, order, **sizes)
    rows = running_sums(chunks, chunks.rows, {"_before": "_size"})
    segment = F.call_function("div", F.col("_before"), F.lit(segment_size))
    return chunks.done(rows.withColumn(name, segment)).drop("_size", "_before")


def numbered(df: DataFrame, key: list[str], order: list[str], name: str, **sizes) -> DataFrame:
    """Dense numbers from 0 within each key."""
    chunks = Chunks(df, key, order, **sizes)
    rows = chunks.rows.withColumn("_position", F.row_number().over(chunks.ordered()))
    rows = chunks.with_neighbours(
        rows,
        {"_rows": F.count(F.lit(1))},
        lambda over: {
            "_before": F.sum("_rows").over(over.rowsBetween(Window.unboundedPreceding, -1))
        },
    )
    number = F.col("_position").cast("bigint") - 1 + F.coalesce(F.col("_before"), F.lit(0))
    return chunks.done(rows.withColumn(name, number)).drop("_position", "_before")


def with_previous(chunks: Chunks, rows: DataFrame, column: str, name: str) -> DataFrame:
    """Value of `column` in the row before, null for the first row of a key."""
    local = rows.withColumns(
        {
            name: F.lag(column).over(chunks.ordered()),
            "_first": F.lag(F.lit(1)).over(chunks.ordered()).isNull(),
        }
    )
    seen = chunks.with_neighbours(
        local,
        {"_edge": F.max_by(column, chunks.at())},
        lambda over: {"_carried": F.lag("_edge").over(over)},
    )
    value = F.when(F.col("_first"), F.col("_carried")).otherwise(F.col(name))
    return seen.withColumn(name, value).drop("_first", "_carried")
