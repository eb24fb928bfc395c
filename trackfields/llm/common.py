"""What the operators of this subpackage share: reading tables, the shared folder, small column helpers."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word pattern ``[^\x20\x09-\x0D]+``, as a Java character class.
SPACE = r"[ \t-\r]"
#: Documents that a Python worker holds at once.
BATCH = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local master gets a folder of this machine and a cluster a folder in the warehouse, which it shares.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if spark.sparkContext.master.split("[")[0] == "local":
        return _local_dir(spark.sparkContext.applicationId)
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/intermediate-{spark.sparkContext.applicationId}"


@lru_cache(4)
def _local_dir(application: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix='spark-')}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes what ``saved`` wrote for these tables, once nothing reads them any more."""
    for t in tables:
        files = t.inputFiles()
        if files:
            path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0].rpartition("/")[0])
            path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def free(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not use."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def bit_table(keys: DataFrame, bits: int) -> tuple[Column, int]:
    """A table of ``bits`` bits that holds the first column of ``keys`` (a long hash), to be looked up by ``in_table``."""
    at = F.pmod(F.col(keys.columns[0]), F.lit(bits))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    table = [0] * (bits // 64)
    for r in keys.groupBy(F.floor(at / 64).cast("int").alias("k")).agg(F.bit_or(one).alias("v")).collect():  # bits / 64 rows at most
        table[r["k"]] = r["v"]
    return keys.sparkSession.createDataFrame([(table,)], "t array<bigint>").scalar(), bits


def in_table(table: tuple[Column, int], key: Column) -> Column:
    """Whether a long hash may be in the table; never false for one that is, false for null."""
    known, bits = table
    at = F.pmod(key, F.lit(bits))
    return F.coalesce(F.getbit(F.element_at(known, F.floor(at / 64).cast("int") + 1), (at % 64).cast("int")) == 1, F.lit(False))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it in nested lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; Python workers get at most ``BATCH`` rows at once from now on, since rows here hold whole documents."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key, "10000")) <= BATCH:
        conf.set(key, str(BATCH))
    return df


def words_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null and empty texts."""
    t = F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")
    return F.when(F.coalesce(F.length(t), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split(t, f"{SPACE}+"))).cast("long")
