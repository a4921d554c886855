"""Near-duplicate line removal by an exact set-similarity join.

A line is the set of its tokens, which are separated by spaces. Of two lines whose Jaccard similarity is at
least `SIMILAR` (a ratio), the later one goes; later is by doc_id, then the stored order of rows,
then the place in the text. Equal token sets form a class, whose first line stands for it.

The join orders the tokens of a line by rarity. Similar lines share one of their first tokens
(prefix filter), their lengths are near (length filter) and enough tokens follow the first shared
one (positional filter). A line also carries a 128-bit sketch, the parity of its tokens per hash
value: two sketches differ in no more bits than the sets do in tokens, which rules out most other
pairs. The remaining ones are verified on the lines themselves. Where a prefix is frequent, the key is that token with a second one from a prefix longer by one, which
similar lines share too; so frequent tokens do not bring unrelated lines together.

Rarity comes from the counts of all tokens, kept per hash bucket on a scale of powers: a table of
fixed size. Any fixed order gives the same result; a better one brings fewer candidates.
Everything is built-in column functions.

Defined results: null text is empty and stays null; lines without tokens always stay; a text whose
lines all go is empty; repeated rows lose the lines that their first copy keeps; null doc_ids come
last; an empty table gives an empty result; other columns, whatever their names, are kept as they
are; texts and lines of any length are read whole.
"""

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblens.llm.common import numbered, saved, table

SIMILAR = (4, 5)
BUCKETS = 1 << 18
HASH_BITS = 54
#: Ranks per doubling of a bucket's count.
RANKS_PER_DOUBLING = 4
#: A bucket with this many times the mean count is frequent.
FREQUENT = 4
#: So many tokens of a line, and so many of its sketch's chunks of so many bits, look for the earliest
#: lines that share them, one of each of DEALT parts.
RAREST = 2
CHUNKS = 3
CHUNK_BITS = 24
DEALT = 4
#: Chunks with fewer bits set are those of short lines and shared by unrelated ones.
CHUNK_SET = 3
#: Words of the bit table of asked-for lines, and of the wide sketch of a line.
WORDS = 1 << 16
WIDE = 16


def tokens_of(line: Column) -> Column:
    return F.array_remove(F.split(line, " "), "")


def lines_of(docs: DataFrame) -> DataFrame:
    """(ord, uid, line_no, line), a row per line."""
    ordinal = F.coalesce(F.col("row.doc_id").cast("long"), F.lit(2**63 - 1))
    return numbered(docs).select(
        ordinal.alias("ord"), "uid", F.posexplode(F.split("row.text", "\n", -1)).alias("line_no", "line")
    )


def bucket_ranks(lines: DataFrame) -> tuple[list[int], int]:
    """(rank of each hash bucket by the count of its tokens, the first rank that is frequent).
    BUCKETS rows come to the driver, whatever the size of the table."""
    counted = (
        lines.select(F.explode(F.split("line", " ")).alias("token"))
        .groupBy(F.xxhash64("token").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("bucket"))
        .agg(F.count("*").alias("n"))
        .collect()
    )
    ranks, total = [0] * BUCKETS, 0
    for bucket, n in counted:
        ranks[bucket] = math.floor(RANKS_PER_DOUBLING * math.log2(n))
        total += n
    limit = FREQUENT * max(1, total / BUCKETS)
    return ranks, math.ceil(RANKS_PER_DOUBLING * math.log2(limit))


def ordered_tokens(line: Column, ranks: list[int]) -> Column:
    """The distinct tokens as numbers, rarest first: the bucket's rank, then hash bits."""
    table_ = F.split(F.lit(",".join(map(str, ranks))), ",").cast("array<bigint>")

    def number(hashed: Column) -> Column:
        # never null, which lets Spark sort plain longs
        rank = F.coalesce(table_[hashed.bitwiseAND(F.lit(BUCKETS - 1))], F.lit(0))
        return F.shiftleft(rank, HASH_BITS) + F.shiftrightunsigned(hashed, 64 - HASH_BITS)

    hashes = F.transform(F.split(line, " "), lambda token: F.xxhash64(token))
    numbers = F.array_distinct(F.transform(hashes, number))
    return F.sort_array(F.array_remove(numbers, number(F.xxhash64(F.lit("")))))


def ceil_ratio(column: Column, numerator: int, denominator: int) -> Column:
    return F.floor((column * numerator + (denominator - 1)) / denominator).cast("int")


def probe_prefix(size: Column, similar: tuple[int, int]) -> Column:
    """Tokens among which a line shares one with any similar line."""
    return size - ceil_ratio(size, similar[0], similar[1]) + 1


def classes(
    lines: DataFrame, ranks: list[int], frequent: int, similar: tuple[int, int]
) -> DataFrame:
    """(id, first, size, prefix, sketch, sketch2), stored: a row per distinct token set, with the place of
    its first line. prefix has 31 hash bits for each token of the probe prefix and one more, negative
    for a frequent token."""
    # generators keep the optimizer from copying the token array into every use of it
    held = lines.select(
        F.struct("ord", "uid", "line_no").alias("at"),
        F.explode(F.array(ordered_tokens(F.col("line"), ranks))).alias("tokens"),
    ).where(F.size("tokens") > 0)
    size = F.size("tokens")
    most = (1 << 31) - 1

    def key(token: Column) -> Column:
        bits = token.bitwiseAND(F.lit(most)).cast("int")
        return F.when(token >= F.lit(frequent << HASH_BITS), -1 - bits).otherwise(bits)

    prefix = F.transform(F.slice("tokens", F.lit(1), probe_prefix(size, similar) + 1), key)

    def sketch(bit: Callable[[Column], Column]) -> Column:
        def toggled(bits: Column, token: Column) -> Column:
            place = token.bitwiseAND(F.lit(63)).cast("int")
            return bits.bitwiseXOR(F.call_function("shiftleft", bit(token), place))

        return F.aggregate("tokens", F.lit(0).cast("long"), toggled)

    # one half of the 128 bits, and both halves laid over each other
    half = sketch(lambda token: F.shiftright(token, 6).bitwiseAND(F.lit(1).cast("long")))
    both = sketch(lambda token: F.lit(1).cast("long"))
    found = (
        held.select(
            "at",
            size.alias("size"),
            prefix.alias("prefix"),
            both.alias("both"),
            half.alias("sketch2"),
            F.xxhash64("tokens").alias("a"),
            F.xxhash64(F.lit(1), "tokens").alias("b"),
        )
        .groupBy("a", "b")
        .agg(
            F.min("at").alias("first"),
            F.first("size").alias("size"),
            F.first("prefix").alias("prefix"),
            F.first("both").alias("both"),
            F.first("sketch2").alias("sketch2"),
        )
        .select(
            F.monotonically_increasing_id().alias("id"),
            "first",
            "size",
            "prefix",
            F.col("both").bitwiseXOR(F.col("sketch2")).alias("sketch"),
            "sketch2",
        )
    )
    return saved(found, "line-classes")


def postings(found: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """(key, shape, id, ord, sketch, sketch2) for the prefix tokens of classes. shape is the size, in
    the upper half, then rest, how many tokens two lines can share at most if those of the key are
    the first that they share, then a bit that tells if the class is open."""
    num, den = similar
    # a shorter set than this has no similar set but itself
    able = found.where(F.col("size") * den >= num * (F.col("size") + 1))
    able = able.withColumn("p", probe_prefix(F.col("size"), similar))
    each = able.select(
        "id",
        F.col("first.ord").alias("ord"),
        "open",
        "sketch",
        "sketch2",
        "size",
        "p",
        "prefix",
        F.posexplode(F.slice("prefix", F.lit(1), F.col("p"))).alias("i", "token"),
    )
    pairs = F.transform(
        F.sequence(F.col("i") + 1, F.col("p")),
        lambda j: F.struct(
            F.hash("token", F.element_at("prefix", j + 1)).alias("key"),
            (F.col("size") - j + 1).alias("rest"),
        ),
    )
    single = F.array(F.struct(F.col("token").alias("key"), (F.col("size") - F.col("i")).alias("rest")))
    keys = F.inline(F.when(F.col("token") < 0, pairs).otherwise(single)).alias("key", "rest")
    rows = each.select("id", "ord", "open", "sketch", "sketch2", "size", keys)
    low = F.shiftleft(F.col("rest").cast("long"), 1) + F.col("open").cast("long")
    shape = F.shiftleft(F.col("size").cast("long"), 32) + low
    return rows.select("key", shape.alias("shape"), "id", "ord", "sketch", "sketch2")


def near_enough(
    x: str, y: str, size_x: Column, size_y: Column, similar: tuple[int, int]
) -> Column:
    """The length and the sketch filter."""
    num, den = similar
    least = F.least(size_x, size_y) * den >= F.greatest(size_x, size_y) * num
    apart = sum(
        F.bit_count(F.col(f"{x}.{word}").bitwiseXOR(F.col(f"{y}.{word}")))
        for word in ("sketch", "sketch2")
    )
    return least & (apart * (num + den) <= (size_x + size_y) * (den - num))


def star_pairs(found: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """(a, b), ids: a class and the earliest of those that share one of its rarest tokens or chunks of
    its sketch. Those that share one are dealt to DEALT parts by hash, and each part has an earliest
    one, so a class is in (RAREST + CHUNKS) * DEALT pairs at most. The rarest tokens of a line of a
    large group of near copies may be its own, but a chunk is equal in many lines of the group; so
    most copies are settled by pairs whose number grows with the group, not with its square."""

    def chunk(number: int) -> Column:
        word, place = ("sketch", "sketch2")[number % 2], number // 2 * CHUNK_BITS
        bits = F.shiftrightunsigned(word, place).bitwiseAND(F.lit((1 << CHUNK_BITS) - 1))
        return F.when(F.bit_count(bits) >= CHUNK_SET, F.hash(F.lit(number), bits))

    chunks = F.array_compact(F.array(*[chunk(number) for number in range(CHUNKS)]))
    rare = found.select(
        F.explode(F.concat(F.slice("prefix", 1, RAREST), chunks)).alias("key"),
        F.struct(F.col("first.ord").alias("ord"), "id", "size", "sketch", "sketch2").alias("x"),
    )
    part = F.pmod(F.xxhash64("x.id"), F.lit(DEALT)).alias("part")
    stars = rare.groupBy("key", part).agg(F.min("x").alias("y"))
    met = rare.join(stars, "key")
    # lines of one document have one ord, which the id tells apart
    earlier = F.struct("y.ord", "y.id") < F.struct("x.ord", "x.id")
    return (
        met.where(earlier & near_enough("x", "y", F.col("x.size"), F.col("y.size"), similar))
        .select(F.col("y.id").alias("a"), F.col("x.id").alias("b"))
        .distinct()
    )


def candidate_pairs(found: DataFrame, settled: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """(a, b), ids of classes that pass the prefix, length, positional and sketch filters, where
    the later one, b by the order of documents, is not settled."""
    num, den = similar
    marked = found.join(settled.withColumn("settled", F.lit(True)), "id", "left")
    rows = postings(marked.withColumn("open", F.col("settled").isNull()), similar)
    x, y = rows.alias("x"), rows.alias("y")
    size_x, size_y = F.shiftright("x.shape", 32), F.shiftright("y.shape", 32)
    rest_x, rest_y = (
        F.shiftright(shape, 1).bitwiseAND(F.lit((1 << 31) - 1)) for shape in ("x.shape", "y.shape")
    )
    # the second part is never true, and not known before the join: so both sides, which need the
    # same columns, are read from one exchange
    probing = (F.col("x.shape").bitwiseAND(F.lit(1)) == 1) | (F.col("y.shape") < 0)
    # holds for the first tokens that similar lines share, so no pair is lost
    enough = F.least(rest_x, rest_y) * (num + den) >= (size_x + size_y) * num
    earlier = (F.col("y.ord") <= F.col("x.ord")) & (F.col("y.id") != F.col("x.id"))
    near = near_enough("x", "y", size_x, size_y, similar)
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & enough & earlier & probing & near)
    return met.select(F.col("y.id").alias("a"), F.col("x.id").alias("b")).distinct()


def placed(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """(early, late, id), stored: the places of the first lines of both classes and the id of the
    later one."""
    own = [F.col(c) for c in ("first", "id")]
    one = found.select(F.col("id").alias("a"), F.struct(*own).alias("one"))
    two = found.select(F.col("id").alias("b"), F.struct(*own).alias("two"))
    met = pairs.join(one, "a").join(two, "b")
    early = F.col("one.first") < F.col("two.first")
    turned = met.select(
        F.least("one.first", "two.first").alias("early"),
        F.greatest("one.first", "two.first").alias("late"),
        F.when(early, F.col("two.id")).otherwise(F.col("one.id")).alias("id"),
    )
    return saved(turned.distinct(), "line-places")


def verified(pairs: DataFrame, lines: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """(id) of the classes whose first line is similar indeed to an earlier line."""
    num, den = similar
    wanted = pairs.select(F.explode(F.array("early", "late")).alias("at")).distinct()
    wanted = wanted.select("at.uid", "at.line_no")
    # a bit table of fixed size tells most lines that no pair asks for, before they are shuffled
    place = F.xxhash64("uid", "line_no")
    word = F.pmod(place, F.lit(WORDS)).alias("word")
    bit = F.shiftrightunsigned(place, 58).cast("int")
    bits = wanted.groupBy(word).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    marked = lines.withColumn("word", word).join(F.broadcast(bits), "word")
    likely = marked.where(F.call_function("bit_get", F.col("bits"), bit) == 1)
    texts = saved(likely.select("uid", "line_no", "line").join(wanted, ["uid", "line_no"]), "line-texts")

    def side(name: str) -> DataFrame:
        return texts.select(
            F.struct("uid", "line_no").alias(name), F.col("line").alias(f"{name}_line")
        )

    def similar_late(some: DataFrame) -> DataFrame:
        flat = some.select(
            "id",
            F.struct("early.uid", "early.line_no").alias("one"),
            F.struct("late.uid", "late.line_no").alias("two"),
        )
        met = flat.join(side("one"), "one").join(side("two"), "two")
        sets = met.select(
            "id",
            F.explode(
                F.array(
                    F.struct(
                        F.array_distinct(tokens_of(F.col("one_line"))).alias("one"),
                        F.array_distinct(tokens_of(F.col("two_line"))).alias("two"),
                    )
                )
            ).alias("of"),
        )
        shared = F.size(F.array_intersect("of.one", "of.two"))
        good = sets.where(shared * (num + den) >= num * (F.size("of.one") + F.size("of.two")))
        return saved(good.select("id").distinct(), "lines-similar")

    def possible(some: DataFrame) -> DataFrame:
        """Pairs that a wide sketch of the lines leaves possible: the long ones need it."""
        words = texts.select(
            F.struct("uid", "line_no").alias("key"),
            F.explode(F.array_distinct(tokens_of(F.col("line")))).alias("token"),
        ).select("key", F.xxhash64("token").alias("h"))
        bit = F.call_function(
            "shiftleft", F.lit(1).cast("long"), F.shiftright("h", 8).bitwiseAND(F.lit(63)).cast("int")
        )
        word = F.col("h").bitwiseAND(F.lit(WIDE - 1))
        wide = [F.bit_xor(F.when(word == w, bit)).alias(f"w{w}") for w in range(WIDE)]
        marks = words.groupBy("key").agg(F.count("*").alias("size"), *wide)

        def side(name: str) -> DataFrame:
            bits = [F.coalesce(f"w{w}", F.lit(0)).alias(f"w{w}") for w in range(WIDE)]
            return marks.select(F.col("key").alias(name), F.struct("size", *bits).alias(f"{name}_bits"))

        keyed = some.withColumns(
            {
                "one": F.struct("early.uid", "early.line_no"),
                "two": F.struct("late.uid", "late.line_no"),
            }
        )
        met = keyed.join(side("one"), "one").join(side("two"), "two")
        apart = sum(
            (F.bit_count(F.col(f"one_bits.w{w}").bitwiseXOR(F.col(f"two_bits.w{w}"))) for w in range(WIDE)),
            F.lit(0),
        )
        both = F.col("one_bits.size") + F.col("two_bits.size")
        close = met.where(apart * (num + den) <= both * (den - num))
        return saved(close.select("id", "early", "late"), "line-open-pairs")

    # one similar line is enough to drop the later one, and the earliest candidate mostly is; the
    # other pairs are only read for lines that are still open
    first = saved(pairs.groupBy("id", "late").agg(F.min("early").alias("early")), "line-first-pairs")
    dropped = similar_late(first)
    still = pairs.join(dropped, "id", "left_anti").join(first, ["id", "early"], "left_anti")
    return dropped.union(similar_late(possible(still)))


def kept_lines(docs: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """(uid, line_no) of the lines with tokens that stay."""
    if 2 * similar[0] <= similar[1]:
        raise ValueError("similar lines must share two tokens: the ratio must exceed 1/2")
    lines = lines_of(docs)
    found = classes(lines, *bucket_ranks(lines), similar)
    stars = placed(saved(star_pairs(found, similar), "line-stars"), found)
    settled = verified(stars, lines, similar)
    pairs = saved(candidate_pairs(found, settled, similar), "line-pairs")
    similar_ones = settled.union(verified(placed(pairs, found), lines, similar))
    return found.join(similar_ones, "id", "left_anti").select("first.uid", "first.line_no")


def dedup_lines(docs: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """(row, text, n_lines, n_dropped): each row without its text, the text after the removal,
    the number of its lines and of those that went."""
    stays = kept_lines(docs, similar).groupBy("uid").agg(F.collect_list("line_no").alias("stays"))
    lines = F.split("row.text", "\n", -1)
    blank = F.filter(
        F.transform("lines", lambda line, i: F.when(F.trim(line) == "", i)), lambda i: i.isNotNull()
    )
    others = [F.col("row").getField(c).alias(c) for c in docs.columns if c != "text"]
    cut = numbered(docs).select(
        "uid", F.struct(*others).alias("row"), lines.alias("lines")
    )
    met = cut.join(stays, "uid", "left")
    none = F.array().cast("array<int>")
    places = F.sort_array(F.concat(F.coalesce(blank, none), F.coalesce("stays", none)))
    left = met.select("row", "lines", F.explode(F.array(places)).alias("places"))
    text = F.array_join(F.transform("places", lambda i: F.element_at("lines", i + 1)), "\n")
    known = F.col("lines").isNotNull()
    return left.select(
        "row",
        F.when(known, text).alias("text"),
        F.when(known, F.size("lines")).otherwise(0).alias("n_lines"),
        F.when(known, F.size("lines") - F.size("places")).otherwise(0).alias("n_dropped"),
    )


def op8_line_similarity_join(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", "text"
    )
