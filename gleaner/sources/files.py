"""CSV and JSON files: datasets by name, shard outputs, and metric reports."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.tables import union_rows

#: Missing values of the tables we write as CSV.
MISSING = "None"
#: Keys under which a report wraps a number, in order of preference.
WRAPPERS = ("sum", "total", "value", "avg", "mean")


def filled(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those paths that exist and are not empty, on any file system that Spark can read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def size(path: str) -> int:
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(conf)
        return fs.getContentSummary(at).getLength() if fs.exists(at) else 0

    return [p for p in paths if size(p) > 0]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """One table with a header; all columns are text, and the text None and empty fields are null."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.select(*[F.nullif(F.col(f"`{c}`"), F.lit(MISSING)).alias(c) for c in df.columns])


def read_shards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The rows of all shards by column name; missing and empty ones are passed over. ValueError if none is left."""
    left = filled(spark, paths)
    if not left:
        raise ValueError("no shard has rows")
    return union_rows([read_csv(spark, p) for p in left])


def read_datasets(spark: SparkSession, registry: dict[str, str], date: str, label: str, numbers: list[str] | None = None) -> DataFrame:
    """All datasets of a registry (name: path) with the column `dataset`.

    Dates become UTC timestamps and labels integers; numbers (none: all other columns that every dataset has) become
    doubles. What cannot be read as such is null, which ``tables.validate`` reports. A path that is missing is an error.
    """
    if not registry:
        raise ValueError("the registry names no dataset")
    frames = {name: read_csv(spark, path) for name, path in registry.items()}
    for name, df in frames.items():
        lacking = [c for c in (date, label, *(numbers or [])) if c not in df.columns]
        if lacking:
            raise ValueError(f"{name} has no columns {lacking}")
    common = [c for c in next(iter(frames.values())).columns if all(c in df.columns for df in frames.values())]
    numbers = [c for c in common if c not in (date, label, "dataset")] if numbers is None else numbers
    columns = [F.try_to_timestamp(F.col(f"`{date}`")).alias(date), F.col(f"`{label}`").try_cast("double").try_cast("int").alias(label), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in numbers]]
    return union_rows([df.select(F.lit(name).alias("dataset"), *columns) for name, df in frames.items()])


def _walk(value: object, nodes: list[list], listed: bool = False) -> float | None:
    """Appends an entry for each key below value, parents first, and returns the number that value stands for."""
    if isinstance(value, (int, float)):
        return float(value)
    if isinstance(value, list):
        below = [_walk(x, nodes, True) for x in value]
        return next((x for x in below if x is not None), None)
    if not isinstance(value, dict):
        return None
    below = {}
    for key, x in value.items():
        entry = [key.lower(), None, x if type(x) is int and not listed and abs(x) < 1 << 63 else None]
        nodes.append(entry)
        entry[1] = below[key] = _walk(x, nodes, listed)
    plain = (below[k] for k in WRAPPERS if isinstance(value.get(k), (int, float)))
    return next((x for x in (*plain, *below.values()) if x is not None), None)


def entries(text: str | None) -> list[list]:
    """(key, number, line) of each key of a JSON text in reading order; none where the text is empty or no JSON."""
    nodes: list[list] = []
    try:
        _walk(json.loads(text or "{}"), nodes)
    except (ValueError, RecursionError, OverflowError):
        return []
    return nodes


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(path, entries) of every JSON file under a path or pattern; texts that are no JSON have no entries, and empty files have no row."""
    return with_entries(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("report")), "report").drop("report")


def with_entries(df: DataFrame, report: str) -> DataFrame:
    """df with `entries`: array of (key, number, line), each key of the report in reading order and in lower case.

    A number is plain, or wrapped (sum, total, value, avg, mean), or else the first one below; true and false count as 1
    and 0. A line is a whole number that stands under no list.
    """
    kind = pa.list_(pa.struct([("key", pa.string()), ("number", pa.float64()), ("line", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("key", "number", "line"), x, strict=True)) for x in entries(t)] for t in batch.column(report).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, "entries"])

    schema = df.schema.simpleString().removeprefix("struct<").removesuffix(">")
    return df.mapInArrow(run, f"{schema},entries:array<struct<key:string,number:double,line:bigint>>")


def _first(entries: Column, aliases: list[str], field: str, exact: bool) -> Column:
    names = [a.lower() for a in aliases]

    def named(key: Column) -> Column:
        if exact:
            return key.isin(*names)
        return F.exists(F.array(*map(F.lit, names)), lambda a: F.contains(key, a))

    return F.get(F.filter(entries, lambda x: named(x["key"]) & x[field].isNotNull()), F.lit(0))[field]


def number_by_alias(entries: Column, aliases: list[str], exact: bool = False) -> Column:
    """The number of the first key that holds (exact: is) an alias and has one; case does not matter."""
    return _first(entries, aliases, "number", exact)


def line_by_alias(entries: Column, aliases: list[str]) -> Column:
    """The first line number whose key holds an alias."""
    return _first(entries, aliases, "line", False)


def truth(text: str) -> bool:
    """Reads an option's yes or no."""
    known = {"true": True, "1": True, "yes": True, "y": True, "false": False, "0": False, "no": False, "n": False}
    if text.strip().lower() not in known:
        raise ValueError(f"neither yes nor no: {text}")
    return known[text.strip().lower()]
