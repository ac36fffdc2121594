"""Small helpers that the training-data operators share."""

from __future__ import annotations

import re
import string
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the cluster names in spark.checkpoint.dir.

    Where none is set, a session on one machine (as in tests) makes one and keeps it; on a cluster that is an error, as
    executors would each write to a disk of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="massloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a text whose words are lists at once.
TEXT_BLOCK = 1 << 20
_blank = re.compile(rb"[\x20\x09-\x0d]").search


def word_lists(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text between ASCII white space, in order, as lists of a bounded part of it each."""
    at = 0
    while at < len(raw):
        cut = _blank(raw, at + TEXT_BLOCK)
        end = cut.start() if cut else len(raw)
        yield raw[at:end].split()
        at = end


def filesystem(uri: str):
    """pyarrow's file system and path of a URI; a path without a scheme is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if re.match(r"[a-z][a-z0-9+.-]*:", uri) else f"file://{uri}")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def bit_place(hashed: Column, words: int) -> tuple[Column, Column]:
    """Word and one-bit mask of a hash in a bit table of ``words`` (a power of two) 64-bit words."""
    at = hashed.bitwiseAND(F.lit(64 * words - 1).cast("long"))
    return F.shiftright(at, 6), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63).cast("long")).cast("int"))


def bit_table(df: DataFrame, hashed: Column, words: int) -> DataFrame:
    """word, bits: a filter of the hashes in at most ``words`` rows, whatever df's size. A set bit means: perhaps."""
    word, bit = bit_place(hashed, words)
    return df.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))


def marked(df: DataFrame, hashed: Column, table: DataFrame, words: int) -> DataFrame:
    """df with ``__maybe``: whether the row's hash is perhaps in the bit table, which is broadcast (its size is bounded)."""
    word, bit = bit_place(hashed, words)
    held = df.withColumns({"__word": word, "__bit": bit}).join(F.broadcast(table.select(F.col("word").alias("__word"), F.col("bits").alias("__bits"))), "__word", "left")
    return held.withColumn("__maybe", F.coalesce(F.col("__bits").bitwiseAND(F.col("__bit")) != 0, F.lit(False))).drop("__word", "__bit", "__bits")


#: Words of the row filters below: at most 2 MB, whatever the input.
ROW_FILTER_WORDS = 1 << 17


def without_ids(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the rows whose id is in ``gone`` (same column name). Only rows that a bounded filter marks are shuffled."""
    key = F.xxhash64(F.col(id_col))
    gone = gone.select(id_col).distinct()
    part = marked(docs, key, bit_table(gone, key, ROW_FILTER_WORDS), ROW_FILTER_WORDS)
    rest, gone = part.filter("__maybe"), gone.withColumnRenamed(id_col, "__gone")
    left = rest.join(gone, rest[id_col].eqNullSafe(gone["__gone"]), "left_anti")
    return part.filter("not __maybe").drop("__maybe").unionByName(left.drop("__maybe"))


#: A class with more than one in so many rows is joined by broadcast; there are at most so many of them.
HOT_SHARE = 1000


def by_class(rows: DataFrame, classes: DataFrame, key: str, size: str, how: str = "inner") -> DataFrame:
    """The join (inner or left) of rows with their class (one row per ``key``, holding its number of rows ``size``), however large a class is.

    Classes that hold over a thousandth of the rows are at most a thousand, and broadcast; the other rows are shuffled
    by key, with at most a thousandth of them under one key. ``classes`` should be a written table, it is read three times.
    """
    total = classes.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    hot = F.col(size) * HOT_SHARE > F.lit(total)
    large, small = classes.filter(hot), classes.filter(~hot)
    near = rows.join(F.broadcast(large), key)
    rest = rows.join(F.broadcast(large.select(key)), key, "left_anti").join(small, key, how)
    return near.unionByName(rest)
