"""File connectors: bar CSVs (S1, S6), chart JSON documents (S2-S4), and
table sinks for features, metrics and predictions (S6-S8).

Writers create their paths; partitioned layouts (``symbol=...``,
``run_date=...``) let later reads prune partitions by filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bar CSV layout: header Date,Open,High,Low,Close,Volume[,Adj Close]; one
# directory per symbol.  All columns are read as text and coerced.
BARS_CSV_SCHEMA = T.StructType([
    T.StructField("Date", T.StringType()), T.StructField("Open", T.StringType()),
    T.StructField("High", T.StringType()), T.StructField("Low", T.StringType()),
    T.StructField("Close", T.StringType()), T.StructField("Volume", T.StringType()),
    T.StructField("Adj Close", T.StringType()),
])


def write_bars_csv(bars: DataFrame, path: str) -> None:
    (bars.select("symbol", F.date_format("date", "yyyy-MM-dd").alias("Date"),
                 F.col("open").alias("Open"), F.col("high").alias("High"),
                 F.col("low").alias("Low"), F.col("close").alias("Close"),
                 F.col("volume").alias("Volume"))
     .write.mode("overwrite").partitionBy("symbol").option("header", True).csv(path))


def scan_bars(spark: SparkSession, path: str, symbols: list[str] | None = None,
              layout: str = "folders") -> DataFrame:
    """Read bar CSVs; unparsable numbers become NULL (try_cast).

    layout 'folders': ``symbol=<name>/*.csv``; 'files': one file per symbol,
    ``<name>_historical.csv`` or ``<name>.csv``, the symbol taken from the
    file name.  ``symbols`` prunes folders or files before they are read."""
    if layout == "files":
        paths = path if symbols is None else [f"{path.rstrip('/')}/{s}{{_historical,}}.csv" for s in symbols]
        df = spark.read.option("header", True).csv(paths)
        for c in ("Open", "High", "Low", "Close", "Volume"):
            if c not in df.columns:
                df = df.withColumn(c, F.lit(None).cast("string"))
        df = df.withColumn("symbol", F.regexp_extract(F.col("_metadata.file_name"), r"^(.+?)(?:_historical)?\.csv", 1))
    else:
        schema = T.StructType([*BARS_CSV_SCHEMA.fields, T.StructField("symbol", T.StringType())])
        df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
        if symbols is not None:
            df = df.where(F.col("symbol").isin(symbols))  # partition pruning
    num = {c: F.expr(f"try_cast(`{src}` as double)") for c, src in
           (("open", "Open"), ("high", "High"), ("low", "Low"), ("close", "Close"), ("volume", "Volume"))}
    return df.select("symbol", F.to_date("Date").alias("date"), *[v.alias(k) for k, v in num.items()])


# Chart JSON document (one per line): see FIXTURES.md F2.  A declared schema
# keeps the event maps as maps instead of one inferred field per epoch.
_PERIOD = T.StructType([T.StructField("timezone", T.StringType()), T.StructField("start", T.LongType()),
                        T.StructField("end", T.LongType()), T.StructField("gmtoffset", T.IntegerType())])
CHART_SCHEMA = T.StructType([T.StructField("chart", T.StructType([
    T.StructField("result", T.ArrayType(T.StructType([
        T.StructField("meta", T.StructType([
            T.StructField("currency", T.StringType()), T.StructField("symbol", T.StringType()),
            T.StructField("exchangeName", T.StringType()), T.StructField("instrumentType", T.StringType()),
            T.StructField("firstTradeDate", T.LongType()), T.StructField("regularMarketTime", T.LongType()),
            T.StructField("gmtoffset", T.IntegerType()), T.StructField("timezone", T.StringType()),
            T.StructField("exchangeTimezoneName", T.StringType()),
            T.StructField("regularMarketPrice", T.DoubleType()),
            T.StructField("dataGranularity", T.StringType()), T.StructField("range", T.StringType()),
            T.StructField("currentTradingPeriod", T.StructType([
                T.StructField("pre", _PERIOD), T.StructField("regular", _PERIOD),
                T.StructField("post", _PERIOD)])),
        ])),
        T.StructField("timestamp", T.ArrayType(T.LongType())),
        T.StructField("events", T.StructType([
            T.StructField("dividends", T.MapType(T.StringType(), T.StructType([
                T.StructField("amount", T.DoubleType()), T.StructField("date", T.LongType())]))),
            T.StructField("splits", T.MapType(T.StringType(), T.StructType([
                T.StructField("date", T.LongType()), T.StructField("numerator", T.DoubleType()),
                T.StructField("denominator", T.DoubleType()),
                T.StructField("splitRatio", T.StringType())]))),
        ])),
        T.StructField("indicators", T.StructType([
            T.StructField("quote", T.ArrayType(T.StructType([
                T.StructField("open", T.ArrayType(T.DoubleType())),
                T.StructField("high", T.ArrayType(T.DoubleType())),
                T.StructField("low", T.ArrayType(T.DoubleType())),
                T.StructField("close", T.ArrayType(T.DoubleType())),
                T.StructField("volume", T.ArrayType(T.LongType()))]))),
            T.StructField("adjclose", T.ArrayType(T.StructType([
                T.StructField("adjclose", T.ArrayType(T.DoubleType()))]))),
        ])),
    ]))),
    T.StructField("error", T.StringType()),
]))])


def _epoch_ntz():
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def epoch_to_ntz(seconds, zone=None):
    """Epoch seconds -> wall-clock timestamp (no zone) in ``zone`` (default
    UTC).  Pure wall-clock arithmetic: independent of the session zone."""
    ntz = F.timestamp_add("SECOND", seconds, _epoch_ntz())
    if zone is not None:
        ntz = F.convert_timezone(F.lit("UTC"), zone if not isinstance(zone, str) else F.lit(zone), ntz)
    return ntz


def epoch_to_date(seconds, zone=None):
    """Epoch seconds -> calendar date in ``zone`` (default UTC)."""
    return F.to_date(epoch_to_ntz(seconds, zone))


def ntz_to_epoch(ts):
    """Wall-clock timestamp (read as UTC) -> epoch seconds."""
    return F.timestamp_diff("SECOND", _epoch_ntz(), ts)


def read_chart_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHART_SCHEMA).json(path)


def explode_chart(doc: DataFrame) -> DataFrame:
    """Bars from chart documents: first result, parallel arrays zipped into
    rows, dates in the exchange's zone; adjusted close when present."""
    r = doc.select(F.get(F.col("chart.result"), 0).alias("r"))
    q = F.get(F.col("r.indicators.quote"), 0)
    adj = F.get(F.col("r.indicators.adjclose"), 0)
    z = r.select(
        F.col("r.meta.symbol").alias("symbol"),
        F.col("r.meta.exchangeTimezoneName").alias("tz"),
        F.posexplode(F.arrays_zip(
            F.col("r.timestamp").alias("ts"), q["open"].alias("open"), q["high"].alias("high"),
            q["low"].alias("low"), q["close"].alias("close"), q["volume"].alias("volume"),
            F.coalesce(adj["adjclose"], F.array().cast("array<double>")).alias("adj_close"))))
    return z.select(
        "symbol", epoch_to_date(F.col("col.ts"), F.col("tz")).alias("date"),
        F.col("col.open").alias("open"), F.col("col.high").alias("high"), F.col("col.low").alias("low"),
        F.col("col.close").alias("close"), F.col("col.volume").cast("double").alias("volume"),
        F.col("col.adj_close").alias("adj_close"))


def corporate_actions(doc: DataFrame) -> DataFrame:
    """Dividends and splits carried in chart documents, one row per event."""
    r = doc.select(F.get(F.col("chart.result"), 0).alias("r"))
    div = r.select(F.col("r.meta.symbol").alias("symbol"),
                   F.explode(F.col("r.events.dividends")).alias("k", "v")).select(
        "symbol", F.lit("dividend").alias("kind"), F.col("v.date").alias("epoch"),
        F.col("v.amount").alias("amount"), F.lit(None).cast("string").alias("ratio"))
    spl = r.select(F.col("r.meta.symbol").alias("symbol"),
                   F.explode(F.col("r.events.splits")).alias("k", "v")).select(
        "symbol", F.lit("split").alias("kind"), F.col("v.date").alias("epoch"),
        (F.col("v.numerator") / F.col("v.denominator")).alias("amount"),
        F.col("v.splitRatio").alias("ratio"))
    return div.unionByName(spl).withColumn("date", epoch_to_date(F.col("epoch")))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                fmt: str = "parquet") -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)
