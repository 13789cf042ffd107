"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Share of all rows from which the rows of one key are named by broadcast; the table of such keys has 1 / HOT_SHARE rows at most.
HOT_SHARE = 1e-4
#: Bytes of text that go to Python at a time, where the session's configuration names no number; each task holds several times as many.
ARROW_BYTES = 2 << 20
#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words, 0 for null: text without leading white space starts as many words as it has gaps before one."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a temporary one in local mode, as in tests; ValueError on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quirelake-checkpoint-"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the session's checkpoint folder and go on from the files, which outlive any executor."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def sweep(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files and checkpoints that nothing refers to any more.

    It does so for what the driver's collector finds, which on a quiet driver is half an hour later.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def unit_hash(key: Column, seed: int) -> Column:
    """A number in [0, 1) from key and seed; 52 bits of MD5, so that other SQL engines can follow it."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame) -> DataFrame:
    """df as one column `row`, so that no name of its columns can clash with what is computed beside them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = 1024) -> DataFrame:
    """df.mapInArrow(run, schema) within bounded memory: run gets `rows` rows at a time, and what a task has freed goes back to the machine.

    Spark keeps Python workers for other tasks, and with them whatever their allocators hold on to. Its own bound of 64 MB a batch
    is held several times over, by the worker and outside the heap of the executor, which keeps it as well.
    """
    conf, limit = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(limit, None) is None:
        conf.set(limit, str(ARROW_BYTES))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (batch.slice(at, rows) for batch in batches for at in range(0, batch.num_rows, rows))
        try:
            yield from run(pieces)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return df.mapInArrow(bounded, schema)


def refuse_clash(keys: list[str], made: list[str]) -> None:
    """ValueError if a key column has the name of a column that comes out beside it."""
    if clash := set(keys) & set(made):
        raise ValueError(f"key columns {sorted(clash)} clash with the result's")


def with_text(df: DataFrame, keys: list[str], text: str) -> tuple[DataFrame, Callable]:
    """The key columns, the text after them unless it is one of them or a field of one (key.field), and what takes it from a batch."""
    columns = [F.col(f"`{k}`") for k in keys]
    head, _, field = text.partition(".")
    if text in keys:
        return df.select(*columns), lambda batch, at=keys.index(text): batch.column(at)
    if field and head in keys:
        return df.select(*columns), lambda batch, at=keys.index(head): batch.column(at).field(field)
    return df.select(*columns, F.col(f"`{text}`").alias("__text")), lambda batch, at=len(keys): batch.column(at)


def join_names(rows: DataFrame, named: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows with the other columns of named, joined by key, which is unique in named and never null; named.n is how many rows have the key.

    Keys with a HOT_SHARE of all rows or more are broadcast, so that their rows stay where they are; the others' rows are shuffled.
    """
    named = cut_lineage(named)
    hot = F.col("n") >= max(rows.count() * HOT_SHARE, 2)
    told = [c for c in named.columns if c not in (key, "n")]
    many = F.broadcast(named.filter(hot).drop("n").withColumn("__hot", F.lit(True)))
    split = rows.join(many, key, "left")
    rest = split.filter("__hot is null").drop(*told, "__hot").join(named.filter(~hot).drop("n"), key, how)
    return split.filter("__hot").drop("__hot").unionByName(rest)
