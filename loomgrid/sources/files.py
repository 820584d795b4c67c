"""Files with manifests: what is read is checked before it is used, what is written appears whole.

A manifest has a row for each file with its bytes, rows and SHA-256. Digests of files are computed by the executors from binary reads.
"""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SourceError(ValueError):
    """A file is not what its manifest says."""


def digests(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """(name, bytes, sha256) of files."""
    files = spark.read.format("binaryFile").load(list(paths))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify(spark: SparkSession, folder: str, manifest: DataFrame) -> None:
    """Refuses a folder of which a file of the manifest (name, bytes, sha256) is missing or differs."""
    names = [r["name"] for r in manifest.select("name").collect()]
    try:
        found = digests(spark, [f"{folder}/{n}" for n in names])
        wrong = manifest.select("name", "bytes", "sha256").join(found, ["name", "bytes", "sha256"], "left_anti").limit(5).collect()
    except Exception as missing:
        raise SourceError(f"{folder}: files of the manifest can't be read") from missing
    if wrong:
        raise SourceError(f"files differ from the manifest: {[r['name'] for r in wrong]}")


def require_columns(frame: DataFrame, required: Iterable[str], name: str = "table") -> DataFrame:
    absent = sorted(set(required) - set(frame.columns))
    if absent:
        raise SourceError(f"{name}: columns {absent} are missing")
    return frame


def scan_parquet(spark: SparkSession, paths: Iterable[str], required: Iterable[str] = ()) -> DataFrame:
    """Many files as one frame; columns that are required have to be there."""
    return require_columns(spark.read.parquet(*paths), required)


def scan_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file whose header is exactly the schema's columns. Empty cells are null, other cells that don't parse stop the read."""
    names = [c.strip().split()[0] for c in schema.split(",")]
    header = next(csv.reader(io.StringIO(spark.read.text(path).first()[0])))
    if header != names:
        raise SourceError(f"{path}: columns are {header}, {names} are expected")
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST")


def scan_zip_tables(spark: SparkSession, archive: bytes, required: Iterable[str], known: Iterable[str], limit: int = 64 << 20) -> dict[str, DataFrame]:
    """The text tables of a schedule archive as frames of strings with `line`, the line of the file. An archive is of a bounded size, as given.
    Members are named once, unknown ones are passed over; headers name columns once; cells lose outer blanks; rows have as many cells as the header."""
    try:
        z = zipfile.ZipFile(io.BytesIO(archive))
    except zipfile.BadZipFile as wrong:
        raise SourceError("a ZIP archive is expected") from wrong
    with z:
        infos = z.infolist()
        if sum(i.file_size for i in infos) > limit:
            raise SourceError(f"the archive holds more than {limit} bytes")
        names = [i.filename for i in infos]
        if len(set(names)) != len(names):
            raise SourceError("a member is named twice")
        absent = sorted(f"{t}.txt" for t in required if f"{t}.txt" not in names)
        if absent:
            raise SourceError(f"members are missing: {absent}")
        out = {}
        for table in known:
            if f"{table}.txt" not in names:
                continue
            rows = list(csv.reader(io.StringIO(z.read(f"{table}.txt").decode("utf-8-sig"), newline="")))
            header = [c.strip() for c in rows[0]] if rows else []
            if not header or len(set(header)) != len(header) or not all(header):
                raise SourceError(f"{table}.txt: columns are named once each")
            body = [(i, r) for i, r in enumerate(rows[1:], 2) if r]
            short = [i for i, r in body if len(r) != len(header)]
            if short:
                raise SourceError(f"{table}.txt: line {short[0]} has another number of cells")
            out[table] = spark.createDataFrame([(i, *(c.strip() for c in r)) for i, r in body], "line long, " + ", ".join(f"`{c}` string" for c in header)) if body else spark.createDataFrame([], "line long, " + ", ".join(f"`{c}` string" for c in header))
    return out


def plan_days(index: DataFrame, start: str, end: str, today: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """(selected, violations) of an index of daily files (service_date 'YYYY-MM-DD', path, bytes): every day from start to end once, none in the future, in all no more than `limit` bytes."""
    days = index.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("day"))
    inside = index.withColumn("day", F.try_to_date("service_date", "yyyy-MM-dd")).filter(F.col("day").between(F.lit(start), F.lit(end)))
    rule = lambda f, name: f.select(F.lit(name).alias("rule"), F.col("day").cast("string").alias("key"))
    bad = rule(days.join(inside, "day", "left_anti"), "day missing").unionByName(rule(inside.groupBy("day").count().filter("count > 1"), "day repeated")).unionByName(rule(days.filter(F.col("day") >= F.to_date(F.lit(today))), "day not complete"))
    bad = bad.unionByName(inside.agg(F.sum("bytes").alias("b")).filter(F.col("b") > limit).select(F.lit("too many bytes").alias("rule"), F.col("b").cast("string").alias("key")))
    return inside.select("service_date", "path", "bytes"), bad


def _rename(spark: SparkSession, source: str, target: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    fs = path(target).getFileSystem(conf)
    if fs.exists(path(target)):
        raise SourceError(f"{target} is there already")
    if not fs.rename(path(source), path(target)):
        raise SourceError(f"{target} can't be put in place")


def publish(frame: DataFrame, folder: str, form: str = "csv", order: Iterable[str] = ()) -> DataFrame:
    """Writes a frame to a folder that appears only when it is whole, and gives its manifest (name, bytes, sha256, rows). Parts are as many as the frame has, sorted if an order is given."""
    spark, staged = frame.sparkSession, folder.rstrip("/") + ".part"
    out = frame.orderBy(*order) if order else frame
    writer = out.write.mode("overwrite").option("header", True)
    {"csv": writer.csv, "json": writer.json, "parquet": writer.parquet}[form](staged)
    rows = {"csv": lambda: spark.read.csv(staged, header=True), "json": lambda: spark.read.json(staged), "parquet": lambda: spark.read.parquet(staged)}[form]().count()
    _rename(spark, staged, folder)
    return digests(spark, [f"{folder}/*.{form}"]).withColumn("rows", F.lit(rows))


def observation(frame: DataFrame, settings: Mapping[str, object] | None = None) -> str:
    """A result of one row as one JSON object, with the settings that led to it."""
    rows = frame.limit(2).select(F.to_json(F.struct("*"))).collect()
    if len(rows) != 1:
        raise SourceError("an observation is one row")
    return json.dumps({"settings": dict(settings or {}), "observation": json.loads(rows[0][0])}, sort_keys=True)
