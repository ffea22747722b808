"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from velas.session import scratch_path

#: ASCII white space as the contracts spell it (Java and DuckDB syntax).
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


#: while a step is written: shuffle files go when it ends, and batches of texts
#: or sets that Python workers get stay small
WRITE_CONF = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
              "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_stored: list[str] = []


def discard_stored(spark: SparkSession) -> None:
    """Delete the tables that ``store`` has written in this session, at the end
    of a job: results that have not been written out yet still read them."""
    while _stored:
        path = spark._jvm.org.apache.hadoop.fs.Path(_stored.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete the tables from ``store`` that ``df`` reads, once nothing else will."""
    spark = df.sparkSession
    read = {f.rsplit("/", 2)[1] for f in df.inputFiles()}
    for path in [p for p in _stored if p.rsplit("/", 1)[1] in read]:
        _stored.remove(path)
        gone = spark._jvm.org.apache.hadoop.fs.Path(path)
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the cluster's shared checkpoint folder and
    read it back: later uses neither recompute it nor depend on executors that
    may be lost meanwhile.  The shuffle files of the write are let go when it ends,
    so a chain of stored steps needs the disk of one step."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    _stored.append(path)
    before = {k: spark.conf.get(k) for k in WRITE_CONF}
    for k, v in WRITE_CONF.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as ''."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only (``lower`` would change other alphabets too)."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
