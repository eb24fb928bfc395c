"""Sources and sinks: raw track files, event lists, sidecar records, arrays, sharded tables, hashes of artifacts."""

from __future__ import annotations

import io
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import types as T

from . import clean

# Names under which track files carry a column, in order of preference.
TRACK_COLUMNS = {
    "sid": ("SID", "sid", "storm_id"), "name": ("NAME", "name", "storm_name"), "basin": ("BASIN", "basin"), "time": ("ISO_TIME", "iso_time", "time"),
    "lat": ("LAT", "USA_LAT", "lat"), "lon": ("LON", "USA_LON", "lon"), "wind": ("USA_WIND", "WMO_WIND", "wind_kt"), "pressure": ("USA_PRES", "WMO_PRES", "pressure_mb"),
}
SIDECAR = "event_id string, sid string, ri_label int, timestamps array<string>, channels array<string>, qc_flags struct<ok: boolean, missing: int>"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: ``spark.checkpoint.dir``.

    Without it a local master gets a folder of this machine and a cluster its warehouse, unless that is a path of one machine.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        local = spark.sparkContext.master.split("[")[0] == "local"
        found = _local_dir(spark.sparkContext.applicationId) if local else _shared(spark.conf.get("spark.sql.warehouse.dir").rstrip("/"))
    return f"{found}/{name}-{uuid.uuid4().hex}"


def _shared(path: str) -> str:
    if path.startswith(("file:", "/")):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all machines share; the warehouse {path} is one machine's")
    return path


def saved(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back; ``rows`` of a group at most, where a row is large: writers and readers hold a group at once."""
    path = scratch(df.sparkSession, name)
    df.write.options(**({"parquet.block.row.count.limit": rows} if rows else {})).parquet(path)
    return df.sparkSession.read.parquet(path)


@lru_cache(4)
def _local_dir(application: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix='spark-')}"


def write_csv(df: DataFrame, path: str) -> None:
    """Cells as they are: a cell of one blank stays one."""
    df.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", "").csv(path)


def raw_tracks(spark: SparkSession, path: str) -> DataFrame:
    """A track file as texts: ``NA`` stays, a cell of one blank is null."""
    return spark.read.option("header", True).option("nullValue", " ").csv(path)


def best_track(raw: DataFrame) -> DataFrame:
    """sid, name, basin, ts, lat, lon, wind_kt, pressure_mb; rows whose time does not parse (the units row) are dropped."""
    d = clean.resolve(raw, TRACK_COLUMNS)
    ts = F.try_to_timestamp(F.col("time"), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    d = d.select("sid", clean.clean_text(F.col("name"), "UNNAMED").alias("name"), clean.clean_text(F.col("basin"), "").alias("basin"), ts.alias("ts"), *[clean.number(F.col(a)).alias(b) for a, b in (("lat", "lat"), ("lon", "lon"), ("wind", "wind_kt"), ("pressure", "pressure_mb"))])
    return d.where("ts is not null").withColumn("lon", clean.longitude_180(F.col("lon")))


def event_list(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """An event list with ``ts``, from ``timestamp`` or else ``datetime`` (yyyyMMdd HHmm). Only empty cells are null."""
    d = spark.read.schema(columns).option("header", True).csv(path)
    first = F.try_to_timestamp(F.col("timestamp"), F.lit("yyyy-MM-dd HH:mm:ss"))
    return d.withColumn("ts", F.coalesce(first, F.try_to_timestamp(F.col("datetime"), F.lit("yyyyMMdd HHmm"))).cast("timestamp_ntz")).drop("timestamp", "datetime")


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Records, one per file or per line, as one table; keys that they lack are null."""
    return spark.read.schema(SIDECAR).json(path)


def npy_bytes(values: Column) -> Column:
    """Arrays of numbers as the content of .npy files (float32)."""

    def pack(s: pd.Series) -> pd.Series:
        def one(x):
            out = io.BytesIO()
            np.save(out, np.asarray(x, np.float32), allow_pickle=False)
            return out.getvalue()

        return s.map(lambda x: None if x is None else one(x))

    return F.pandas_udf(pack, T.BinaryType())(values)


def npy_rows(files: DataFrame, content: str = "content") -> DataFrame:
    """A row per cell of each file's array: the other columns, ``cell`` (in C order) and ``value``. Files: the ``binaryFile`` source."""
    rest = [f for f in files.schema.fields if f.name != content]
    schema = T.StructType([*rest, T.StructField("values", T.ArrayType(T.FloatType()))])

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            values = [None if x is None else np.load(io.BytesIO(x), allow_pickle=False).astype(np.float32).ravel() for x in rows[content]]
            yield rows.drop(columns=content).assign(values=values)

    return files.mapInPandas(unpack, schema).select(*[f.name for f in rest], F.posexplode("values").alias("cell", "value"))


def append_audit(df: DataFrame, path: str) -> None:
    """Rows as JSON lines after those already there."""
    df.write.mode("append").json(path)


def strict(c: Column) -> Column:
    """A number that JSON can hold: NaN and infinities become null."""
    return clean.finite(c)


def strict_json(df: DataFrame, *numbers: str) -> Column:
    """All columns as a JSON object with null where a number is not finite."""
    return F.to_json(F.struct(*[strict(F.col(c)).alias(c) if c in numbers else F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})


def write_texts(df: DataFrame, group: str, order: str, text: str, path: str) -> None:
    """One text file per value of ``group`` in folders group=value, a line per row in order."""
    df.repartition(group).sortWithinPartitions(group, order).select(group, F.col(text).alias("value")).write.partitionBy(group).text(path)


def files(spark: SparkSession, path: str, pattern: str = "*", least: int = 0) -> DataFrame:
    """(path, below ``path``; length; content) of the files of a folder and those in it that match a pattern and have so many bytes."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return d.where(F.col("length") >= least).select(F.substring_index("path", f"{path.rstrip('/').rpartition('/')[2]}/", -1).alias("path"), "length", "content")


def artifacts(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, size, sha256) of contents, such as those of the ``binaryFile`` source."""
    return files.select(F.col(path).alias("path"), F.octet_length(content).cast("long").alias("size"), F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))


def verified(stored: DataFrame, found: DataFrame) -> DataFrame:
    """(path, status): same, changed, missing (only stored) or unlisted (only found)."""
    both = stored.select("path", F.col("sha256").alias("a")).join(found.select("path", F.col("sha256").alias("b")), "path", "full")
    return both.select("path", F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unlisted").when(F.col("a") == F.col("b"), "same").otherwise("changed").alias("status"))


def windows(df: DataFrame, year: str, k: int) -> DataFrame:
    """(y0, y1): the span of years in stretches of ``k``."""
    span = df.agg(F.min(year).alias("a"), F.max(year).alias("b")).where("a is not null")
    return span.select(F.explode(F.sequence("a", "b", F.lit(k))).alias("y0"), "b").select("y0", F.least(F.col("y0") + k - 1, "b").alias("y1"))


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is not done yet: the rows of an idempotent append."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def run_windows(spans: list[tuple[int, int]], done: set[tuple[int, int]], work, check) -> list[tuple[int, int, str]]:
    """Each span's outcome: skipped if done, else worked and checked; the first that fails its check ends the run."""
    out = []
    for span in spans:
        if span in done:
            out.append((*span, "skipped"))
            continue
        work(*span)
        good = check(*span)
        out.append((*span, "completed" if good else "failed"))
        if not good:
            break
    return out


#: Columns of the manifest of ``run_resumable``.
MANIFEST = "y0 int, y1 int, attempt int, status string, n long, digest long"


def _digest(df: DataFrame) -> tuple[int, int]:
    """Rows, and a number that any other rows would hardly have, in whatever order."""
    r = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*sorted(df.columns))).alias("x"), F.sum(F.pmod(F.xxhash64(F.lit(1), *sorted(df.columns)), F.lit(1 << 31))).alias("s")).head()
    return r["n"], (r["x"] or 0) ^ (r["s"] or 0)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The last attempt at each window; no rows before the first run."""
    rows = spark.createDataFrame([], MANIFEST)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
        rows = spark.read.schema(MANIFEST).parquet(path)
    last = rows.groupBy("y0", "y1").agg(F.max(F.struct("attempt", "status", "n", "digest")).alias("m"))
    return last.select("y0", "y1", "m.*")


def run_resumable(wanted: DataFrame, year: str, k: int, path: str, work, stop: bool = True) -> list[tuple[int, int, str, int]]:
    """(y0, y1, status, n): windows of ``k`` years of ``wanted`` written to ``path``/data, those with a completed manifest row skipped.

    ``work(rows, y0, y1)`` gives what is to be written for a window's rows. A window's part is written by dynamic overwrite, so one
    that failed or was cut off is replaced and no other is touched. It is read back and compared with what should be there by rows and
    digest, and only then does the manifest get a row: a run that dies in between leaves a window that the next run works again. The first failed
    window ends the run (``stop``). Windows without rows are completed.
    """
    spark = wanted.sparkSession
    done = {(r["y0"], r["y1"]): r for r in manifest(spark, f"{path}/manifest").collect()}  # a row per window
    out = []
    for y0, y1 in [(r["y0"], r["y1"]) for r in windows(wanted, year, k).orderBy("y0").collect()]:
        before = done.get((y0, y1))
        if before is not None and before["status"] == "completed":
            out.append((y0, y1, "skipped", before["n"]))
            continue
        rows = wanted.where(F.col(year).between(y0, y1))
        made = work(rows, y0, y1).withColumn("_y0", F.lit(y0))
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_y0").parquet(f"{path}/data")
        found = _digest(written(spark, path, wanted).where(F.col("_y0") == y0).select(*wanted.columns))
        status = "completed" if found == _digest(rows) else "failed"
        spark.createDataFrame([(y0, y1, before["attempt"] + 1 if before is not None else 1, status, *found)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
        out.append((y0, y1, status, found[0]))
        if status == "failed" and stop:
            break
    return out


def written(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The windows' data, of the columns of ``like`` and _y0."""
    return spark.read.schema(T.StructType([*like.schema.fields, T.StructField("_y0", T.IntegerType())])).parquet(f"{path}/data")
