"""Exact dedup by progressive refinement: length, prefix hash, full hash.

Three passes, each narrower than the last:

1. lengths of the normalised texts that more than one row has;
2. (length, prefix hash) pairs that more than one of those rows has;
3. SHA-256 of the whole normalised text, only of rows that survived both.

What one pass hands to the next is a *sieve*: a bit table of a fixed number of
bits (``SIEVE_BITS``), stored as 64-bit words and broadcast.  Its size does not
depend on the data, so the broadcast has a proven bound (65,536 rows of two
longs); hash collisions in it only let a row through that the full hash then
tells apart.  Texts never enter a shuffle: only lengths, hashes and ids do.

A group of copies of any size is counted with map-side partial aggregation.
The join that returns a group's id to its rows is a plain equi-join on the
hash, which adaptive execution splits when one hash holds many rows.

Defined cases: a null text counts as empty; all empty texts are one group;
null ids lose against any other id and are kept only where the whole group has
null ids; repeated rows each count in ``group_size`` and are ``kept`` alike
when they carry the smallest id; an empty table gives an empty result; only
``id_col`` and ``text_col`` are read, so further columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from velas.llm.common import SPACE, store

SIEVE_BITS = 1 << 22
PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _bit(*key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(SIEVE_BITS))


def _sieve(repeated: DataFrame, *key: Column) -> DataFrame:
    """Bit table (at most SIEVE_BITS / 64 rows) of the keys of ``repeated``."""
    bit = _bit(*key)
    return (repeated.select((bit / 64).cast("long").alias("_word"),
                            F.expr("1L").alias("_one"), F.pmod(bit, F.lit(64)).cast("int").alias("_at"))
            .groupBy("_word").agg(F.bit_or(F.expr("shiftleft(_one, _at)")).alias("_mask")))


def _through(rows: DataFrame, sieve: DataFrame, *key: Column) -> DataFrame:
    """Add ``_hit``: whether the sieve holds the row's key."""
    bit = _bit(*key)
    return (rows.withColumn("_word", (bit / 64).cast("long"))
            .withColumn("_at", F.pmod(bit, F.lit(64)).cast("int"))
            .join(F.broadcast(sieve), "_word", "left")
            .withColumn("_hit", F.coalesce(F.expr("shiftrightunsigned(_mask, _at) & 1L") == 1, F.lit(False)))
            .drop("_word", "_at", "_mask"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                digest: str = "survivors") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, sha256 (binary).

    ``digest="survivors"`` leaves sha256 null where length or prefix already
    prove a text unique; ``"all"`` fills it for every row, in the same pass.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("_norm"))
    length = F.octet_length("_norm")
    prefix = F.xxhash64(F.substring("_norm", 1, PREFIX_CHARS))

    lengths = base.groupBy(length.alias("_n")).count().where("count > 1")
    by_length = _sieve(lengths, F.col("_n"))

    narrow = base.select(length.alias("_n"), prefix.alias("_p"))
    pairs = (_through(narrow, by_length, F.col("_n")).where("_hit")
             .groupBy("_n", "_p").count().where("count > 1"))
    by_prefix = _sieve(pairs, F.col("_n"), F.col("_p"))

    keyed = base.withColumn("_n", length).withColumn("_p", prefix)
    full = F.unhex(F.sha2(F.col("_norm"), 256))
    hashed = store(
        _through(keyed, by_prefix, F.col("_n"), F.col("_p"))
        .select("doc_id", "_hit", (full if digest == "all" else F.when(F.col("_hit"), full)).alias("_sha")),
        "exact-dedup")

    # stored, so that the join below shuffles on its own and a hot hash can be split
    groups = store(hashed.where("_hit").groupBy(F.col("_sha").alias("_group"))
                   .agg(F.min("doc_id").alias("_keep"), F.count(F.lit(1)).alias("_size")).where("_size > 1"),
                   "exact-groups")
    joined = hashed.join(groups, (F.col("_sha") == F.col("_group")) & F.col("_hit"), "left")
    keep = F.when(F.col("_size").isNull(), F.col("doc_id")).otherwise(F.col("_keep"))
    return joined.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("_sha").alias("sha256"))
