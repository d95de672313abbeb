"""Line-delimited JSON logs: a last line without an end is a write that was cut off and is left out; other lines that are not
what they should be are reported.

Logs are read in splits, by line. Whether a file's last line ended is told by numbers alone: its lines with one byte more each are as
long as the file, or one byte longer if the last has no end. That holds for plain files, not for compressed ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

BAD = "_bad"


def whole_lines(spark: SparkSession, path: str) -> DataFrame:
    """(_file, line) of all lines that ended; empty ones are none."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n")).alias("_place"), F.col("_metadata.file_size").alias("_size"), F.col("value").alias("line")
    )
    ends = lines.groupBy("_file").agg((F.sum(F.octet_length("line") + 1) - F.first("_size")).alias("_over"), F.max("_place").alias("_place"))
    torn = ends.where("_over = 1").select("_file", "_place")
    return lines.join(torn, ["_file", "_place"], "left_anti").where(F.trim("line") != "").select("_file", "line")


def checked(lines: DataFrame, schema: str) -> DataFrame:
    """(_file, line, r, good): good lines are objects of which no field of the schema is lost."""
    r = F.from_json("line", f"{schema}, {BAD} string", {"columnNameOfCorruptRecord": BAD})
    at = lines.withColumn("r", r)
    one = F.coalesce(F.json_array_length(F.concat(F.lit("["), "line", F.lit("]"))) == 1, F.lit(False))  # nothing behind the object
    good = F.startswith(F.ltrim("line"), F.lit("{")) & one & F.col("r").isNotNull() & F.col(f"r.{BAD}").isNull()
    return at.withColumn("good", good)


def fields(spark: SparkSession, schema: str) -> list[str]:
    return [f"r.`{c.name}`" for c in spark.createDataFrame([], schema).schema]


def read(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their ``_file``, and damaged lines (_file, line)."""
    at = checked(whole_lines(spark, path), schema)
    return at.where("good").select("_file", *fields(spark, schema)), at.where("not good").select("_file", "line")


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows; a line that ends and is damaged fails the job that reads it. A torn last line is left out, as in ``read``."""
    at = checked(whole_lines(spark, path), schema)
    bad = F.raise_error(F.concat(F.lit("damaged line in "), "_file", F.lit(": "), F.substring("line", 1, 80)))
    return at.withColumn("r", F.when(F.col("good"), F.col("r")).otherwise(bad.cast(at.schema["r"].dataType))).select("_file", *fields(spark, schema))


def read_index(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows and damaged lines of files that may begin with a header, a line with a ``_schema`` of its own."""
    rows, damaged = read(spark, path, f"_schema string, {schema}")
    return rows.where("_schema is null").drop("_schema"), damaged


def repaired(spark: SparkSession, path: str) -> DataFrame:
    """The whole lines of a log, to be written as its next generation: torn tails are gone, nothing else is."""
    return whole_lines(spark, path).select(F.col("line").alias("value"))


def append(df: DataFrame, path: str) -> None:
    """New files beside the old; a task's file appears as a whole or not at all, so no later write meets a torn tail."""
    df.write.mode("append").json(path)


def in_name_order(x: Column, kind: DataType) -> Column:
    """``x`` with the fields of its structs and the keys of its maps in order, at all depths; a number that JSON cannot write fails."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(x.isNotNull(), F.struct(*[in_name_order(x[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, ArrayType):
        return F.transform(x, lambda e: in_name_order(e, kind.elementType))
    if isinstance(kind, MapType):
        at = F.map_from_entries(F.array_sort(F.map_entries(x)))
        return F.transform_values(at, lambda _, v: in_name_order(v, kind.valueType))
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.raise_error(F.lit("not a JSON number")).cast(kind)).otherwise(x)
    return x


def canonical(df: DataFrame) -> DataFrame:
    """Each row as JSON with its fields in order of name, those of nested structs and maps too; nulls are written."""
    row = F.struct(*[in_name_order(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)])
    return df.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("value"))
