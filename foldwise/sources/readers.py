"""Readers and writers for the text formats that studies use, all with a given schema and no inference pass."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def csv(spark: SparkSession, path, schema: str, rename: dict[str, str] | None = None, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header; column names are trimmed and renamed."""
    raw = spark.read.csv(path, header=True, sep=sep, encoding=encoding, schema=schema, enforceSchema=True, escape='"')
    return raw.withColumnsRenamed({c: (rename or {}).get(c.strip(), c.strip()) for c in raw.columns})


def decimal_comma(c: Column) -> Column:
    return F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")


def whitespace_table(spark: SparkSession, path, names: list[str]) -> DataFrame:
    """Numbers separated by white space, without a header."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(*[parts[i].try_cast("double").alias(n) for i, n in enumerate(names)])


def mixed_date(c: Column, formats: list[str]) -> Column:
    """The first format that reads; else null."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def parsed_records(lines: DataFrame) -> DataFrame:
    """(source, minute, parameter, value) of (source, value) lines of Time, Parameter and Value; malformed ones are left out."""
    raw = lines.select("source", F.split("value", ",").alias("x"))
    good = raw.where((F.size("x") == 3) & F.element_at("x", 1).rlike(r"^\d+:\d\d$"))
    minutes = F.split(F.col("x")[0], ":")[0].cast("int") * 60 + F.split(F.col("x")[0], ":")[1].cast("int")
    return good.select("source", minutes.alias("minute"), F.col("x")[1].alias("parameter"), F.col("x")[2].try_cast("double").alias("value")).where("value IS NOT NULL")


def long_records(spark: SparkSession, path) -> DataFrame:
    """Such records of text files with a header."""
    return parsed_records(spark.read.text(path).select(F.col("_metadata.file_name").alias("source"), "value"))


def archive_lines(spark: SparkSession, path) -> DataFrame:
    """(archive, source, value): the lines of the files in tar archives, plain or compressed. One archive is read by one
    task, member by member; a damaged one is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                with tarfile.open(fileobj=io.BytesIO(content.as_buffer())) as archive:
                    for member in archive:
                        if member.isfile():
                            lines = archive.extractfile(member).read().decode("utf-8", "replace").splitlines()
                            source = member.name.rsplit("/", 1)[-1]
                            yield pa.RecordBatch.from_arrays([pa.array([name] * len(lines), pa.string()), pa.array([source] * len(lines), pa.string()), pa.array(lines, pa.string())], ["archive", "source", "value"])

    files = spark.read.format("binaryFile").load(path).select(F.col("path"), "content")
    return files.mapInArrow(run, "archive string, source string, value string")


def archive_records(spark: SparkSession, path) -> DataFrame:
    """``long_records`` of the files in tar archives."""
    return parsed_records(archive_lines(spark, path))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", sep: str = ",") -> None:
    """CSV files with a header each, that ``csv`` reads back: times in ISO form to the microsecond, nulls as nothing, empty
    texts quoted."""
    own = [F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(f.name) if f.dataType.typeName() in ("timestamp", "timestamp_ntz") else F.col(f"`{f.name}`") for f in df.schema]
    df.select(*own).write.mode(mode).csv(path, header=True, sep=sep, emptyValue='""', nullValue="", escape='"')
