"""Result sinks."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.schema import PLACE_FIELDS

_COORDINATES = ("latitude", "longitude")


def as_json(results: DataFrame) -> DataFrame:
    """One JSON record per result in a column ``json``.

    Absent parts of the key and an unknown elevation are left out; coordinates that are no finite number
    are written as ``null``, which takes a variant null, since a SQL null would be left out as well.
    """
    fields = [F.col("key")] if "reference" not in results.columns else [F.col("reference"), F.col("key")]
    fields.append(F.struct(*[_entry_field(name) for name in PLACE_FIELDS]).alias("entry"))
    if "distance" in results.columns:
        fields.append(F.col("distance"))
    return results.select(F.to_json(F.struct(*fields)).alias("json"))


def _entry_field(name: str) -> Column:
    value = F.col(f"entry.{name}")
    if name not in _COORDINATES:
        return value.alias(name)
    json_null = F.parse_json(F.lit("null"))
    no_number = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(no_number, json_null).otherwise(value.cast("variant")).alias(name)


def write_results(results: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists"):
    """Write results as Parquet, or as JSON lines in the form of :func:`as_json`."""
    if format == "json":
        as_json(results).write.mode(mode).text(path)
    else:
        results.write.mode(mode).format(format).save(path)


@dataclass
class Response:
    """Results, and the one row that says by what tool and from which data they were made."""

    results: DataFrame
    provenance: DataFrame


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def write_response(results: DataFrame, provenance: DataFrame, path: str) -> Response:
    """Write results and their provenance as one folder ``path``, which appears when both are complete.

    Both are written beside it, under a hidden name that readers pass over, and then renamed at once. A write that
    fails leaves nothing, and one that finds ``path`` taken leaves that as it is.
    """
    spark = results.sparkSession
    final, system = _file_system(spark, path)
    if system.exists(final):
        raise FileExistsError(path)
    parent = path.rstrip("/").rpartition("/")[0]
    name = f"{parent}/_response-{uuid.uuid4().hex}"
    staging, _ = _file_system(spark, name)
    try:
        write_results(results, f"{name}/results")
        provenance.coalesce(1).write.parquet(f"{name}/provenance")
        if system.exists(final) or not system.rename(staging, final):
            raise FileExistsError(path)
    except BaseException:
        system.delete(staging, True)
        raise
    return read_response(spark, path)


def read_response(spark: SparkSession, path: str) -> Response:
    """A response that was written as a whole; there are no others."""
    at, system = _file_system(spark, path)
    if not system.exists(at):
        raise FileNotFoundError(path)
    return Response(spark.read.parquet(f"{path}/results"), spark.read.parquet(f"{path}/provenance"))
