"""What several operators share: row numbers, saved intermediate tables, reading of tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joblens.session import scratch_dir

#: Bits of a row's place in its file; the bits above hold the file's number.
ROW_BITS = 33


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(rows: DataFrame, name: str) -> DataFrame:
    """Writes rows to the folder that all executors share and reads them back; cuts the lineage.

    The shuffle files behind the rows are no longer needed then. Spark drops them when the driver
    collects its garbage, which is asked for here, so that a long query does not pile them up."""
    spark = rows.sparkSession
    path = scratch_dir(spark, name)
    rows.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(rows.schema).parquet(path)


def is_stored(docs: DataFrame) -> bool:
    """Whether docs is columns and rows of one Parquet table, whose files number their rows."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation" or "HadoopFsRelation" not in plan.relation().getClass().getName():
        return False
    return plan.relation().fileFormat().toString() == "Parquet"


def numbered(docs: DataFrame) -> DataFrame:
    """(uid, row): a number for each row, and the row as one struct, so that no column name can clash.

    The number is the file's place among the sorted names of the table's files and the row's place
    in that file, so every later read finds it again, however the files are split among tasks.
    What is not a stored table is stored first; the numbers then belong to the returned rows only.
    """
    if not is_stored(docs):
        docs = saved(docs, "numbered-rows")
    place = docs.metadataColumn("_metadata")
    # one name per file comes to the driver
    files = sorted(row.file for row in docs.select(place["file_path"].alias("file")).distinct().collect())
    names = F.lit(files) if files else F.array().cast("array<string>")
    file = F.array_position(names, place["file_path"]) - 1
    uid = F.shiftleft(file, ROW_BITS) + place["row_index"]
    return docs.select(uid.alias("uid"), F.struct("*").alias("row"))


def text_of(column: Column) -> Column:
    """Null text counts as empty."""
    return F.coalesce(column.cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
