"""Sequence packing: best fit decreasing over a segment tree of remaining capacities.

Documents are cut into full windows, which need no search, and a rest. Rests are dealt to shards of
bounded size; in a shard, from the longest down, each goes to the tightest open sequence that holds it,
found by walking a segment tree whose leaves are the remaining capacities. Shards work on lengths only:
no token leaves the task that made it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbase.llm.chunks import encoded_texts, encoder, special_strings, text_slices
from quillbase.llm.common import cut

WINDOW = 1024
END_ID = 0
SHARD_ROWS = 50_000
BATCH_BYTES = 32_000_000


class Capacities:
    """Open sequences by remaining capacity: a segment tree finds the least capacity that is enough."""

    def __init__(self, most: int) -> None:
        self.leaves = 1
        while self.leaves <= most:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        node = capacity + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, sequence) of a tightest sequence with ``need`` free places, taken out; none if there is none."""
        node = need + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):  # up to the first right sibling with a sequence
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        while node:
            self.count[node] -= 1
            node >>= 1
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(sequence, offset) of each piece; ties by order of input."""
    tree, out, made = Capacities(window), [(0, 0)] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        need = lengths[i]
        if found := tree.take(need):
            capacity, sequence = found
        else:
            capacity, sequence = window, made
            made += 1
        out[i] = (sequence, window - capacity)
        if capacity > need:
            tree.add(capacity - need, sequence)
    return out


def _pieces(tokenizer_file: str, window: int, end_id: int, with_ids: bool):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, special = encoder(tokenizer_file), special_strings(tokenizer_file)
        for part in parts:
            for s in text_slices(part["text"], BATCH_BYTES):
                ids, offsets = encoded_texts(part["text"].slice(s.start, s.stop - s.start), encode, special)
                ids = np.insert(ids, offsets[1:], end_id).astype("<u4")
                offsets = offsets + np.arange(len(offsets))
                totals = np.diff(offsets)
                count = (totals + window - 1) // window
                row = np.repeat(np.arange(len(totals)), count)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * window
                length = np.minimum(window, totals[row] - start)
                view, begin = memoryview(ids.tobytes()), 4 * (offsets[row] + start)
                blobs = [view[a : a + 4 * n] for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
                columns = [part["id"].slice(s.start, s.stop - s.start).take(pa.array(row)), pa.array(start), pa.array(length), pa.array([zlib.crc32(b) for b in blobs], pa.int64()), pa.array(totals[row])]
                if with_ids:
                    columns.append(pa.array([bytes(b) for b in blobs], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])

    return run


def _pack(window: int, passed: list[str]):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[int, list[pa.RecordBatch]] = {}
        for part in parts:
            numbers = part["shard"].to_numpy()
            for k in np.unique(numbers).tolist():
                shards.setdefault(k, []).append(part.filter(pa.array(numbers == k)))
        for shard, held in shards.items():
            table = pa.Table.from_batches(held).combine_chunks().sort_by([("length", "descending"), ("id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
            placed = np.array(best_fit_decreasing(table["length"].to_pylist(), window), dtype=np.int64).reshape(-1, 2)
            columns = [*(table[c].combine_chunks() for c in passed), pa.array(placed[:, 0] + (shard << 32)), pa.array(placed[:, 1])]
            for batch in pa.Table.from_arrays(columns, names=[*passed, "sequence_id", "offset"]).to_batches(10_000):
                yield batch

    return run


def pack(documents: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = True, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: ``id_col``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` and,
    unless ``with_ids`` is false, ``ids`` (little-endian unsigned 32-bit).

    A document's ids are its text's, where strings of the tokenizer's added tokens become those tokens, then ``end_id``; a null text counts as empty, so it is one id. Rows
    that repeat an id, or have none, are packed each by itself. An empty table gives an empty table.
    Other columns are ignored. The tokenizer's file must be at the same path on every executor.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    kinds = "id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    pieces = cut(rows.mapInArrow(_pieces(tokenizer_file, window, end_id, with_ids), kinds))
    # a shard holds about shard_rows pieces, whatever the ids are
    shards = max(1, -(-pieces.count() // shard_rows))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "start", "length", "ids_crc32"), F.lit(shards)))
    names = [n for n, _ in pieces.dtypes]
    out = dealt.repartition(shards, "shard").mapInArrow(_pack(window, names), f"{kinds}, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
