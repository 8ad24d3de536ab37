"""Packing documents into fixed-length training sequences.

Documents are encoded where they are read and cut into full pieces and one rest. The pieces, without their ids unless
these are asked for, go to randomised groups of a bounded number of documents; each group places its pieces, longest
first, into the first sequence with room, which a tournament tree over the sequences' free room finds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table
from .tokenizer import default_path, encoder

#: The id that ends each document.
END = 0
GROUP_DOCS = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int"


class Tournament:
    """The winner of each match is the larger free room; the first entry with room is found from the root."""

    def __init__(self, entries: int, room: int) -> None:
        self.width = 1 << max(0, entries - 1).bit_length()
        self.room = [room] * (2 * self.width)

    def place(self, size: int) -> tuple[int, int]:
        """The first entry with room for size, and the room it had; it has less from now on."""
        room, k = self.room, 1
        while k < self.width:
            k *= 2
            if room[k] < size:
                k += 1
        entry, had = k - self.width, room[k]
        room[k] = had - size
        while k > 1:
            k //= 2
            best = room[2 * k] if room[2 * k] >= room[2 * k + 1] else room[2 * k + 1]
            if room[k] == best:
                break
            room[k] = best
        return entry, had


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset in it of each piece; sizes from 1 to capacity."""
    tree = Tournament(len(sizes), capacity)
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        entry, had = tree.place(int(sizes[i]))
        where[i], offset[i] = entry, capacity - had
    return where, offset


def pieces(docs: DataFrame, capacity: int, groups: int, path: str, keep_ids: bool, seed: int) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text, part in zip(*(c.to_pylist() for c in b.columns)):
                ids = encode(text or "") + END.to_bytes(4, "little")
                n = len(ids) // 4
                for k in range(0, n, capacity):
                    own = ids[4 * k : 4 * (k + capacity)]
                    rows.append((doc_id, k, len(own) // 4, zlib.crc32(own), n, part, *([own] if keep_ids else [])))
            kinds = [pa.int64()] * 5 + [pa.int32()] + [pa.binary()] * keep_ids
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part"] + ["ids"] * keep_ids
            columns = zip(*rows) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    part = (F.rand(seed) * groups).cast("int")
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), part.alias("part"))
    return chosen.mapInArrow(run, PIECES + ", ids binary" * keep_ids)


def pack(docs: DataFrame, capacity: int = 1024, group_docs: int = GROUP_DOCS, path: str | None = None, keep_ids: bool = False, seed: int = 7) -> DataFrame:
    """One row for each piece of docs (doc_id, text): its place in its document and in its sequence.

    With keep_ids, ids has the piece's token ids (little-endian uint32). A null text is the empty one, whose document
    is its end id alone; null ids stay; repeated rows are documents of their own; an empty table gives no rows; other
    columns are ignored. Sequences are numbered uniquely, not without gaps; offsets in a sequence leave no gap.
    """
    groups = max(1, -(-docs.count() // group_docs))
    own = pieces(docs, capacity, groups, path or default_path(), keep_ids, seed)
    names = [c for c in own.columns if c != "part"]

    def place(rows):
        order = rows.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        where, offset = first_fit_decreasing(order.column("length").to_numpy(), capacity)
        part = order.column("part").to_numpy().astype(np.int64)
        return order.select(names).append_column("sequence_id", pa.array((part << 32) + where)).append_column("offset", pa.array(offset))

    schema = PIECES.replace(", part int", ", ids binary" * keep_ids) + ", sequence_id long, offset long"
    return own.groupBy("part").applyInArrow(place, schema)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
