"""Helpers shared by the training-data operators.

Intermediate tables are written below the folder named by ``spark.checkpoint.dir`` so that every executor
sees them and a lost executor costs only a recomputation of its own tasks.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

#: Rows of one Arrow batch handed to Python, so that a batch of long texts stays small.
BATCH_ROWS = 256
#: Bits of a bitmap of keys (likely_among): for each key at least, and at most in all (8 MB).
KEY_BITS, MOST_BITS = 64, 1 << 26


def reachable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, whatever folder they start in."""
    root, held = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in held.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, held) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that this process has made in the shared one.
_made: list[str] = []
#: Those of them that the innermost scratch() removes.
_scratch: ContextVar[list[str] | None] = ContextVar("_scratch", default=None)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Removes the intermediate tables made so far. Frames that were made from them can't be read afterwards."""
    while _made:
        _remove(spark, _made.pop())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made within are removed at its end: what is kept must be written to a folder made before."""
    own: list[str] = []
    token = _scratch.set(own)
    try:
        yield
    finally:
        _scratch.reset(token)
        for folder in own:
            _remove(spark, folder)
            if folder in _made:
                _made.remove(folder)


def new_folder(spark: SparkSession, label: str) -> str:
    """The path of a folder of its own in the shared one, which clean() removes."""
    path = f"{shared_folder(spark)}/relq-{label}-{uuid.uuid4().hex}"
    _made.append(path)
    own = _scratch.get()
    if own is not None:
        own.append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends here."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def likely_among(df: DataFrame, columns: list[str], keys: DataFrame, others: bool = False) -> DataFrame:
    """All rows of df whose values in these columns are among those of keys (columns of the same names and types), and
    a few others: one in 64 where keys has up to a million rows, more beyond that. A join with keys afterwards decides,
    and need not move the rest of df. others: the rest instead.

    The hashes of keys are bits of a bitmap, MOST_BITS at most, which is broadcast. keys is read twice.
    """
    bits = min(MOST_BITS, 1 << max(10, (KEY_BITS * keys.count() - 1).bit_length()))
    place = F.pmod(F.xxhash64(*columns), F.lit(bits))
    held = keys.select(place.alias("place")).select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, CAST(place & 63 AS INT))").alias("bit"))
    held = held.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[held["word"].to_numpy()] = held["bits"].to_numpy()
    (name,) = free_names(df, "__words")
    bitmap = df.sparkSession.createDataFrame(pa.table({name: pa.array([words], pa.list_(pa.int64()))}))
    bit = F.getbit(F.get(F.col(name), F.shiftright(place, 6).cast("int")), place.bitwiseAND(63).cast("int"))
    return df.join(F.broadcast(bitmap), bit == 1, "left_anti" if others else "left_semi")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    reachable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, or where df has a column of one, that name with underscores until it has none."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        out.append(name)
    return out


def held_out(doc_id) -> F.Column:
    """True for the rows whose labels may not be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _changed(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row.n, row.x or 0


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs -> (node, component) for every node of an edge; component is the smallest node reachable.

    Alternates the large-star and small-star steps until the edges are stars around their minima. Each step is a
    grouped minimum (combined before the shuffle) and one join, and writes its edges to the shared folder. Loops
    and null ends are ignored. Rounds grow with the logarithm of the longest path.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, "edges")
    before = _changed(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = _changed(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def learnable(labels: DataFrame, column: str, most: int) -> DataFrame:
    """(doc_id, label) of at most so many labelled rows, the first by a hash of their id; never of held-out ones."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    own = own.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    return own.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)
