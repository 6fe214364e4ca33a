"""Readers and writers: delimited text and Parquet in, Parquet or bucketed tables out."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder, stored
from . import schema as S


def _headers(spark: SparkSession, path: str) -> DataFrame:
    """file, head: the first line of every file. Of each split one line is read, not its text."""
    probe = spark.newSession()  # its settings are its own
    probe.conf.set("spark.sql.files.openCostInBytes", spark.conf.get("spark.sql.files.maxPartitionBytes"))
    probe.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")

    def first(batches):
        for batch in batches:
            yield batch
            return

    lines = probe.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    found = lines.mapInArrow(first, "value string, file string, at bigint").where("at = 0").select("file", F.col("value").alias("head"))
    return spark.read.parquet(_written(found))


def _written(df: DataFrame) -> str:
    path = f"{shared_folder(df.sparkSession)}/{df.sparkSession.sparkContext.applicationId}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def _parsed(spark: SparkSession, path: str, schema: T.StructType, names: Mapping[str, str], sep: str) -> DataFrame:
    """Columns of the schema, and of rows that cannot be read ``_line`` and ``_reason``; ``_file`` of all."""
    heads = _headers(spark, path)
    kinds = [r[0] for r in heads.select("head").distinct().orderBy("head").collect()]  # as many as there are different headers
    lines = spark.read.text(path).select(F.col("value").alias("_line"), F.col("_metadata.file_path").alias("_file"))
    if len(kinds) > 1:
        lines = lines.join(heads.withColumnRenamed("file", "_file"), "_file")
    headers = {head: [h.strip().strip('"') for h in head.lstrip("\ufeff").split(sep)] for head in kinds}
    held = {names.get(h, h) for header in headers.values() for h in header}
    schema = T.StructType([f for f in schema.fields if f.name in held or not held])
    parts = []
    for head, header in headers.items():
        raw = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))] + [T.StructField("bad", T.StringType())])
        options = {"sep": sep, "nullValue": "NA", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}
        own = (F.col("_line") != head) & (F.trim("_line") != "")
        if len(kinds) > 1:
            own &= F.col("head") == head
        mine = lines.where(own).withColumn("_row", F.from_csv("_line", raw.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options))
        fields = {names.get(h, h): i for i, h in enumerate(header)}
        texts = {f.name: F.col(f"_row.c{fields[f.name]}") for f in schema.fields if f.name in fields}
        values = {f.name: texts[f.name].try_cast(f.dataType) if f.name in texts else F.lit(None).cast(f.dataType) for f in schema.fields}
        wrong = [F.when(texts[n].isNotNull() & values[n].isNull(), F.concat(F.lit(f"{n}: "), texts[n])) for n in texts]
        # Said again, because a filter on the reason may run before the one above.
        reason = F.when(own, F.coalesce(F.when(F.col("_row.bad").isNotNull(), F.lit("number of fields")), *wrong))
        parts.append(S.clean(mine.select(*[v.alias(n) for n, v in values.items()], "_file", "_line", reason.alias("_reason"))))
    if not parts:
        return spark.createDataFrame([], T.StructType([*schema.fields, *(T.StructField(n, T.StringType()) for n in ("_file", "_line", "_reason"))]))
    return reduce(lambda a, b: a.unionByName(b), parts)


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    names: Mapping[str, str] | None = None,
    sep: str = "\t",
) -> DataFrame:
    """Delimited text with a header line, one file or a folder of them.

    ``schema`` holds canonical names; ``names`` maps the headers of the files to them. Every file's own
    header decides which column is which: files are read by header and put together by name, and a column that
    a file lacks is missing there. A number or date that cannot be read is an error, NA is a missing value; see
    ``read_with_rejects`` for files where some rows are bad.
    """
    rows = _parsed(spark, path, schema, dict(names or {}), sep)
    bad = F.raise_error(F.concat_ws(" ", F.lit("row not readable:"), "_reason", F.lit("in"), "_file", F.lit("line:"), "_line"))
    return rows.where(F.when(F.col("_reason").isNotNull(), bad.cast("boolean")).otherwise(True)).drop("_file", "_line", "_reason")


def read_with_rejects(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    names: Mapping[str, str] | None = None,
    sep: str = "\t",
) -> tuple[DataFrame, DataFrame]:
    """The rows that can be read, and those that cannot: file, line, reason.

    The reason is "number of fields" or the first column whose text is no value of its type, and that text. The text is
    read once: both tables come from one stored table of parsed rows.
    """
    rows = stored(_parsed(spark, path, schema, dict(names or {}), sep))
    good = rows.where(F.col("_reason").isNull()).drop("_file", "_line", "_reason")
    rejected = rows.where(F.col("_reason").isNotNull()).select(F.col("_file").alias("file"), F.col("_line").alias("line"), F.col("_reason").alias("reason"))
    return good, rejected


def read_table(
    spark: SparkSession, path: str, names: Mapping[str, str] | None = None
) -> DataFrame:
    """A stored Parquet table under canonical names."""
    return S.clean(S.canonical(spark.read.parquet(path), dict(names or {})))


def read_site(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """The plot attributes, exported from the workbook as delimited text."""
    return read_delimited(spark, path, S.SITE, S.NAMES_SITE, sep)


def read_region(spark: SparkSession, path: str, region: str) -> DataFrame:
    """Rings of one region of the polygon table."""
    return spark.read.schema(S.POLYGON).parquet(path).where(F.col("region") == region)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Parquet result; partition by scenario so that a scenario filter prunes files.

    A partitioned table keeps the partitions that ``df`` has no rows of: results of one scenario replace those of that
    scenario and no others.
    """
    mode = "dynamic" if partition_by else "static"
    df.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(*partition_by).parquet(path)


def write_bucketed(df: DataFrame, table: str, buckets: int, key: str = "plot") -> None:
    """Catalog table bucketed by plot: every plot-wise operator then reads it without a shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def inspect(df: DataFrame, rows: int = 6, order: Sequence[str] = ()) -> DataFrame:
    """First rows for a look at a table, in a stated order if one is given; pair with printSchema()."""
    return (df.orderBy(*order) if order else df).limit(rows)
