"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is stored and read again as
the next one's docs. All but the last return the columns of documents.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblens.llm import language, line_dedup, mixing, ngram_join, packing
from joblens.llm.common import numbered, saved, table


def with_text(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (row, text) as rows of docs with the new text; n_chars, if there is one, follows it."""
    fresh = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return rows.select(
        *[fresh.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns]
    )


def identify_language(spark, docs, sf_dir):
    """A null lang becomes the predicted one. Texts without a letter have no language and go."""
    model = language.train(docs, ~language.held_out())
    # the text waits once beside Python, not once more as a column of its own
    rows = docs.select(F.struct("*").alias("row"))
    known = language.predict(rows, model, "row.text").where("lang_pred <> 'und'")
    found = {"lang": F.coalesce(F.col("row.lang").cast("string"), "lang_pred")}
    return known.select(*[found.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def drop_repeated_lines(spark, docs, sf_dir):
    """Every document stays, without the lines that an earlier one has."""
    return with_text(docs, line_dedup.dedup_lines(docs))


def keep_one_of_near_copies(spark, docs, sf_dir):
    kept = ngram_join.join_near(docs).where("kept").select("uid")
    return numbered(docs).join(kept, "uid", "left_semi").select("row.*")


def mix_sources(spark, docs, sf_dir):
    return mixing.mixed_documents(docs)


def pack_sequences(spark, docs, sf_dir):
    return packing.pack_documents(docs, packing.tokenizer_path()).drop("pid")


STAGES = [
    ("language", identify_language),
    ("lines", drop_repeated_lines),
    ("near copies", keep_one_of_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models, hash draws and tokenizers have no SQL form; tests hold each stage against a
#: plain version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        rows = saved(stage(spark, rows, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, rows, sf_dir)
