"""Secret scans over a trigram inverted index.

Each rule's regular expression gives a Boolean query over trigrams that any match must hold. The
index has a posting (trigram, document) for every trigram that some rule asks for and every text
that contains it, upper and lower case taken as one. Postings are intersected per document, and
only candidates are verified with the expression; a rule without mandatory trigrams scans all
texts. Everything is built-in column functions.

Spans count code points, the end exclusive. Matches are leftmost and do not overlap within a kind;
a match whose group is shorter than the rule asks is dropped after it has been consumed.

Defined results: null text is empty; a text without secrets has no spans and the checksum of the
empty string; repeated rows and equal or null doc_ids are scanned row by row; an empty table gives
an empty result; extra columns are ignored; texts of any length are scanned whole.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblens.llm.common import numbered, table, text_of
from joblens.llm.trigrams import Query, trigram_query, trigrams_in


class Rule(NamedTuple):
    """A span stays if its group has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: In the order in which spans with the same start are listed. Runs of a character class with a
#: least length are maximal, so asking for the length in the expression finds the same matches.
RULES = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)

SPANS = "array<struct<start:int,kind:int,stop:int>>"


def vocabulary(rules: tuple[Rule, ...]) -> list[str]:
    return sorted(set().union(*[trigrams_in(trigram_query(rule.pattern)) for rule in rules]))


def postings(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """The index (trigram, uid) over rows (uid, text), for the trigrams that rules ask for."""
    low = rows.select("uid", F.explode(F.array(F.lower("text"))).alias("low"))  # lowered once
    present = F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)])
    return low.select("uid", F.explode(F.array_compact(present)).alias("trigram"))


def satisfied(query: Query, numbers: dict[str, int], held: Column) -> Column:
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        return F.array_contains(held, numbers[query])
    kind, parts = query
    each = sorted(parts, key=str)
    column = satisfied(each[0], numbers, held)
    for part in each[1:]:
        other = satisfied(part, numbers, held)
        column = column & other if kind == "and" else column | other
    return column


def candidates(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(uid, rules): the indexed rules whose trigram query a text satisfies."""
    trigrams = vocabulary(rules)
    numbers = {t: i for i, t in enumerate(trigrams)}
    held = postings(rows, trigrams).groupBy("uid").agg(F.collect_set("trigram").alias("held"))
    checks = [
        F.when(satisfied(trigram_query(rule.pattern), numbers, F.col("held")), F.lit(i))
        for i, rule in enumerate(rules)
        if trigram_query(rule.pattern) is not True
    ]
    met = held.select("uid", F.array_compact(F.array(*checks)).alias("rules"))
    return met.where(F.size("rules") > 0)


def spans(text: str, rule: Rule, number: int) -> Column:
    """The spans of a rule in a text column, from the pieces between matches and the matches."""
    pattern = rule.pattern.replace("\\", "\\\\").replace("'", "\\'")
    parts = (
        f"zip_with(split({text}, '{pattern}', -1),"
        f" arrays_zip(regexp_extract_all({text}, '{pattern}', 0),"
        f" regexp_extract_all({text}, '{pattern}', {rule.group})),"
        " (piece, hit) -> struct(char_length(piece) as gap, char_length(hit['0']) as size,"
        " char_length(hit['1']) as part))"
    )
    return F.expr(
        f"""
        aggregate(
          {parts},
          struct(0 as at, cast(array() as {SPANS}) as found),
          (done, next) -> struct(
            cast(done.at + next.gap + coalesce(next.size, 0) as int) as at,
            case when next.part >= {rule.least} then cast(concat(done.found, array(struct(
                done.at + next.gap as start, {number} as kind, done.at + next.gap + next.size as stop
              ))) as {SPANS})
              else done.found end as found),
          done -> done.found)
        """
    )


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(uid, doc_id, found): all spans (start, kind, stop) of a text, sorted; kind is the rule's
    number."""
    rows = numbered(docs).select(
        "uid", F.col("row.doc_id").alias("doc_id"), text_of(F.col("row.text")).alias("text")
    )
    met = rows.join(candidates(rows.select("uid", "text"), rules), "uid", "left")
    none = F.expr(f"cast(array() as {SPANS})")
    found = []
    for number, rule in enumerate(rules):
        indexed = trigram_query(rule.pattern) is not True
        likely = F.array_contains("rules", number) if indexed else F.lit(True)
        # the match test is one pass; the positions cost more and are for matching texts only
        match = likely & F.rlike("text", F.lit(rule.pattern))
        found.append(F.when(match, spans("text", rule, number)).otherwise(none))
    together = met.select("uid", "doc_id", F.concat(*found).alias("found"))
    return together.select("uid", "doc_id", F.sort_array("found").alias("found"))


def of_kind(number: int):
    return lambda span: span["kind"] == number


def digested(found: DataFrame) -> DataFrame:
    """Counts per kind, the spans written out, and their checksum."""
    kinds = F.lit([rule.kind for rule in RULES])
    listed = F.array_join(
        F.transform(
            "found",
            lambda s: F.concat_ws(
                ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string")
            ),
        ),
        ",",
    )
    counts = [
        F.size(F.filter("found", of_kind(n))).cast("long").alias(f"n_{rule.kind}")
        for n, rule in enumerate(RULES)
    ]
    return found.select(
        "doc_id", *counts, F.sha2(listed.cast("binary"), 256).alias("base_sha256"), listed.alias("spans")
    )


def op3_trigram_index(spark, sf_dir: str) -> DataFrame:
    return digested(scan(table(spark, sf_dir, "documents")))
