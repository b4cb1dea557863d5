"""What the corpus operators share: tables, work folders, words, row keys.

Row identity: ``doc_id`` may be null or repeated, so operators that take a row apart and
put it together again use (doc_id, hash of the text) as its key; rows that agree in both
are repeated rows, and get the same result each.
"""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWERING = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Words of letters: everything but ASCII characters that are neither digits nor letters.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same as bytes: what isn't such an ASCII character, after lowering.
_NO_WORD = re.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_GAPS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c > 0x7F else 0x20 for c in range(256))
_LOWER_GAPS = bytes(_GAPS[LOWERING[c]] for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared folder that the session names in spark.checkpoint.dir."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "spark-warehouse/llm-work"
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/llm/{label}-{uuid.uuid4().hex}"


#: Shuffle files go when the write that needed them is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage with a Parquet table in the shared folder; a lost executor costs no recomputation."""
    spark = df.sparkSession
    folder = work_folder(spark, label)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(folder)
    out.folder = folder
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that cut() made, once all that was read from them is a table itself."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.folder)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def joined_evenly(left: DataFrame, right: DataFrame, keys: list[str], how: str, total: int) -> DataFrame:
    """left joined with right, which has a row for each key and how often left has it (n), of ``total`` rows.

    Keys of more than a ten-thousandth of all rows, ten thousand at most, are broadcast, so
    that no task gets all rows of one.
    """
    most = max(1000, total // 10_000)
    hot = right.where(F.col("n") > most)
    if hot.isEmpty():
        return left.join(right, keys, how)
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.where(F.col("n") <= most), keys, how)
    return left.join(F.broadcast(hot), keys, how).unionByName(rest)


def small_batches(spark: SparkSession, rows: int = 2000, size: str = "4MB") -> None:
    """Arrow batches that hold few long texts; JVM and worker hold each several times over."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def pieces(frames: Iterator[pd.DataFrame], column: str, most: int = 8_000_000) -> Iterator[pd.DataFrame]:
    """The batches again, in slices of about ``most`` characters (a longer text stands alone).

    No string accessor and no grouping: both refer to themselves, and so keep the texts until garbage is collected.
    """
    for frame in frames:
        yield from slices(frame, np.array([len(x) if isinstance(x, (str, bytes)) else 0 for x in frame[column]], np.int64), most)


def slices(frame: pd.DataFrame, sizes: np.ndarray, most: int) -> Iterator[pd.DataFrame]:
    """The frame in slices of rows whose sizes add up to about ``most``."""
    cuts = [0, *(np.flatnonzero(np.diff(sizes.cumsum() // most)) + 1), len(frame)] if len(frame) else []
    for start, stop in pairwise(cuts):
        yield frame.iloc[start:stop]


@contextmanager
def uncollected() -> Iterator[None]:
    """No search for cycles among many small objects; what there is of them goes at the end, as workers take further tasks."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()
        give_back()


def give_back() -> None:
    """At a task's end: free memory goes back to the system, as idle workers otherwise keep what the largest task took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


#: What a worker keeps for further tasks of one operator; see forget().
KEPT: dict = {}


def forget() -> None:
    """At the begin of another operator's task: workers are lent to all operators, and hold nothing of the one before."""
    if KEPT:
        KEPT.clear()
        give_back()


def uncollected_over(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, uncollected."""

    @wraps(run)
    def whole(frames: Iterator) -> Iterator:
        with uncollected():
            yield from run(frames)

    return whole


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches; what another operator left is forgotten, and what ``run`` took is given back."""

    @wraps(run)
    def whole(frames: Iterator) -> Iterator:
        forget()
        try:
            yield from run(frames)
        finally:
            give_back()

    return whole


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def text_key(text: Column) -> Column:
    """64 bits of the text; a null text has the key of an empty one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def letter_words(text: str | None) -> list[bytes]:
    """The UTF-8 words of WORD_PATTERN after lowering A-Z."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER_GAPS).split()


def space_words(text: str | None) -> list[bytes]:
    r"""The UTF-8 words ``[^\x20\x09-\x0D]+`` after lowering A-Z."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWERING).split()
