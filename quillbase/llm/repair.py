"""Token files compressed by a Re-Pair grammar.

A block holds the ids of consecutive documents. Pairs of symbols that occur often become nonterminals,
round by round: first inside the block's distinct words, each pair weighted by how often its words
occur, then in the sequence itself. The block stores the rules, every rule's expansion length, and the
remaining symbols, so any range of ids is decoded without the rest.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillbase.llm.chunks import Chunked, encoder, gather, special_strings, text_slices

END_ID = 1
#: Ids are below this number, nonterminals from it on.
FIRST_RULE = 1 << 20
#: Text that shares one pass of the tokenizer, and text of one block.
SLICE_BYTES, BLOCK_BYTES = 36_000_000, 4_000_000
MIN_COUNT = 16
_HEAD = "<4sIQQ"
_MAGIC = b"QRP1"


class Pairs:
    """A sequence whose frequent pairs become nonterminals, in rounds that touch only the places of frequent pairs.

    Places are linked, so a replaced pair leaves no copy of the sequence behind. A round makes symbols that
    did not exist, so the pairs next to them are new and every other pair only loses occurrences: a pair
    is counted when it comes up, and what is not frequent then is never looked at again.
    """

    def __init__(self, symbols: np.ndarray, last: np.ndarray, weights: np.ndarray | None, first_rule: int) -> None:
        n = len(symbols)
        self.n, self.made, self.rules = n, first_rule, []
        self.symbol = np.append(symbols.astype(np.int32), np.int32(-1))
        self.weights = weights
        # place n stands for "no neighbour"
        self.after = np.where(np.append(last, True), n, np.arange(1, n + 2)).astype(np.int32)
        self.before = np.full(n + 1, n, dtype=np.int32)
        inner = np.flatnonzero(self.after[:n] < n)
        self.before[inner + 1] = inner
        self.alive = np.ones(n, dtype=bool)
        self.pair = np.full(n + 1, -1, dtype=np.int32)  # the number of the frequent pair that begins at a place
        self.names = np.empty(0, dtype=np.int64)
        self.places = np.empty(0, dtype=np.int64)
        # a count by hash is never below the pair's own, so most rare pairs need no count of their own
        cell = (self.symbol[inner] * np.int32(-1640531527) ^ self.symbol[inner + 1] * np.int32(40503)) & np.int32(0x1FFFFF)
        most = np.bincount(cell, weights=self._weight(inner), minlength=1 << 21)
        self._enter(inner[(most >= MIN_COUNT)[cell]])

    def _weight(self, places: np.ndarray) -> np.ndarray | None:
        return None if self.weights is None else self.weights[places]

    def _distinct(self, *places: np.ndarray) -> np.ndarray:
        """Places in order, each once: marking them is cheaper than hashing or sorting them."""
        marked = np.zeros(self.n, dtype=bool)
        for some in places:
            marked[some] = True
        return np.flatnonzero(marked)

    def _enter(self, places: np.ndarray) -> None:
        """Number the frequent ones of the pairs at ``places``."""
        numbers, names = pd.factorize((self.symbol[places].astype(np.int64) << 32) | self.symbol[self.after[places]])
        often = np.bincount(numbers, weights=self._weight(places), minlength=len(names)) >= MIN_COUNT
        hit = often[numbers]
        number = np.cumsum(often) - 1 + len(self.names)
        self.pair[places[hit]] = number[numbers[hit]]
        self.names = np.concatenate([self.names, names[often]])
        self.places = np.concatenate([self.places, places[hit]])

    def step(self) -> bool:
        """One round; whether there was a frequent pair. Where occurrences overlap, the more frequent pair wins; pairs that win
        fewer than ``MIN_COUNT`` places wait for the next round. The most frequent pair is replaced everywhere, so
        rounds come to an end."""
        here = self._distinct(self.places[self.pair[self.places] >= 0])  # a place enters again for each new pair
        numbers = self.pair[here]
        # of a run of equals, in which one pair begins at each place, every second place can be replaced
        follows = np.append(False, (self.after[here[:-1]] == here[1:]) & (numbers[1:] == numbers[:-1]))[: len(here)]
        start = np.maximum.accumulate(np.where(follows, 0, np.arange(len(here))))
        lead, usable = here[start], (np.arange(len(here)) - start) % 2 == 0
        counts = np.bincount(numbers[usable], weights=self._weight(here[usable]), minlength=len(self.names))
        often = counts[numbers] >= MIN_COUNT
        self.pair[here[~often]] = -1
        self.places = here[often]
        if not len(self.places):
            return False
        usable &= often
        here, numbers, lead = here[usable], numbers[usable], lead[usable]
        chosen = np.flatnonzero(counts >= MIN_COUNT)
        chosen = chosen[np.lexsort((self.names[chosen], -counts[chosen]))]
        rank_of = np.full(len(self.names) + 1, len(chosen), dtype=np.int32)  # the last one is for places without a frequent pair
        rank_of[chosen] = np.arange(len(chosen))
        while True:
            ranks = rank_of[numbers]
            wins = (ranks < rank_of[self.pair[self.before[lead]]]) & (ranks <= rank_of[self.pair[self.after[here]]])
            used = np.bincount(ranks[wins], weights=self._weight(here[wins]), minlength=len(chosen))
            short = np.flatnonzero((used < MIN_COUNT) & (rank_of[chosen] < len(chosen)))
            if not len(short):
                break
            # the pairs that win too little wait for the next round and stand in nobody's way; the others can only win more places
            rank_of[chosen[short]] = len(chosen)
            stay = rank_of[numbers] < len(chosen)
            here, numbers, lead = here[stay], numbers[stay], lead[stay]
        enough = rank_of[chosen] < len(chosen)
        kept = self.names[chosen[enough]]
        self.rules.append(np.stack([kept >> 32, kept & 0xFFFFFFFF], axis=1).astype(np.int32))
        won, rule = here[wins], (np.cumsum(enough) - 1)[ranks[wins]]
        gone = self.after[won]
        far = self.after[gone]
        self.symbol[won] = self.made + rule
        self.made += len(kept)
        self.alive[gone] = False
        self.pair[gone] = self.pair[won] = -1
        self.after[won] = far
        self.before[far] = won
        self.before[self.n] = self.n
        near = self.before[won]
        near = near[near < self.n]
        self.pair[near] = -1
        touched = self._distinct(near, won)
        self._enter(touched[self.after[touched] < self.n])
        return True

    def run(self) -> np.ndarray:
        """Rounds until no pair is frequent; the symbols that are left."""
        while self.step():
            pass
        return self.symbol[:-1][self.alive]


def compress(values: np.ndarray, starts: np.ndarray, numbers: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(rules, symbols) of words ``numbers`` of the dictionary (``values``, ``starts``), with ``end_id`` after each place in ``ends``.
    Rounds go on until no pair has ``MIN_COUNT`` occurrences."""
    sizes = np.diff(starts)
    last = np.zeros(len(values), dtype=bool)
    last[starts[1:][sizes > 0] - 1] = True
    inside = Pairs(values, last, np.repeat(np.bincount(numbers, minlength=len(sizes)), sizes), FIRST_RULE)
    symbols = inside.run()
    owner = np.repeat(np.arange(len(sizes)), sizes)[inside.alive]
    word_starts = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(sizes))))).astype(np.int64)
    whole, lengths = gather(symbols, word_starts, numbers)
    whole = np.insert(whole, np.concatenate(([0], np.cumsum(lengths)))[ends], end_id)
    last = np.zeros(len(whole), dtype=bool)
    last[-1:] = True
    across = Pairs(whole, last, None, inside.made)
    symbols = across.run()
    return np.concatenate([np.empty((0, 2), np.int32), *inside.rules, *across.rules]), symbols


def expansions(rules: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every rule's ids, one after the other, and where they begin."""
    flat, owner = rules.reshape(-1).astype(np.int64), np.repeat(np.arange(len(rules)), 2)
    while len(at := np.flatnonzero(flat >= FIRST_RULE)):
        size = np.ones(len(flat), dtype=np.int64)
        size[at] = 2
        owner = np.repeat(owner, size)
        place = np.cumsum(size) - size
        out = np.repeat(flat, size)
        out[place[at]], out[place[at] + 1] = rules[flat[at] - FIRST_RULE, 0], rules[flat[at] - FIRST_RULE, 1]
        flat = out
    return flat.astype(np.int32), np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(rules))))).astype(np.int64)


def _thin(values: np.ndarray) -> bytes:
    """Numbers below 2 ** 24 as a plane of low 16 bits, then one of high 8."""
    return (values & 0xFFFF).astype("<u2").tobytes() + (values >> 16).astype(np.uint8).tobytes()


def _thick(block: bytes, n: int, at: int) -> np.ndarray:
    return np.frombuffer(block, "<u2", n, at).astype(np.int32) | (np.frombuffer(block, np.uint8, n, at + 2 * n).astype(np.int32) << 16)


def pack_block(rules: np.ndarray, symbols: np.ndarray) -> bytes:
    """The file format: head, rules, expansion length of each rule (little-endian 32-bit), symbols."""
    if FIRST_RULE + len(rules) > 1 << 24:
        raise ValueError("too many rules for one block")
    _, starts = expansions(rules)
    lengths = np.diff(starts).astype("<u4")
    return struct.pack(_HEAD, _MAGIC, FIRST_RULE, len(rules), len(symbols)) + _thin(rules.reshape(-1)) + lengths.tobytes() + _thin(symbols)


def _open(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    magic, first, n_rules, n_symbols = struct.unpack_from(_HEAD, block)
    if magic != _MAGIC or first != FIRST_RULE:
        raise ValueError("not a token block of this format")
    at = struct.calcsize(_HEAD)
    rules = _thick(block, 2 * n_rules, at).reshape(-1, 2)
    lengths = np.frombuffer(block, "<u4", n_rules, at + 6 * n_rules)
    return rules, lengths, _thick(block, n_symbols, at + 10 * n_rules)


def decode_block(block: bytes) -> np.ndarray:
    """All ids of a block."""
    rules, _, symbols = _open(block)
    flat, starts = expansions(rules)
    ids = np.unique(symbols[symbols < FIRST_RULE])
    values = np.concatenate([flat, ids.astype(np.int32)])
    starts = np.concatenate([starts, starts[-1] + np.arange(1, len(ids) + 1)])
    numbers = np.where(symbols >= FIRST_RULE, symbols - FIRST_RULE, len(rules) + np.searchsorted(ids, symbols))
    return gather(values, starts, numbers)[0]


def decode_range(block: bytes, start: int, stop: int) -> list[int]:
    """Ids ``start:stop`` of a block, expanding only the symbols that cover them, by the stored lengths."""
    rules, lengths, symbols = _open(block)
    size = np.where(symbols >= FIRST_RULE, lengths[np.maximum(symbols - FIRST_RULE, 0)] if len(lengths) else 1, 1)
    upto = np.cumsum(size)
    if stop <= start:
        return []
    a, b = np.searchsorted(upto, start, side="right"), np.searchsorted(upto, stop, side="left")
    out: list[int] = []
    stack = symbols[a : b + 1][::-1].tolist()
    while stack:
        s = stack.pop()
        if s < FIRST_RULE:
            out.append(s)
        else:
            stack += [int(rules[s - FIRST_RULE, 1]), int(rules[s - FIRST_RULE, 0])]
    skip = start - int(upto[a] - size[a])
    return out[skip : skip + stop - start]


_BLOCK = "part long, block long, low long, high long, n_ids long, ids array<long>, sizes array<long>, payload binary"
_BLOCK_ARROW = pa.schema(
    [("part", pa.int64()), ("block", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("n_ids", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("payload", pa.binary())]
)


def _block_rows(tokenizer_file: str, end_id: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, special = encoder(tokenizer_file, word_level=True), special_strings(tokenizer_file)
        task, made = TaskContext.get().partitionId(), 0
        for part in parts:
            for s in text_slices(part["text"], SLICE_BYTES):
                texts = part["text"].slice(s.start, s.stop - s.start)
                keys = part["id"].slice(s.start, s.stop - s.start)
                chunked = Chunked(texts, special)
                values, starts = encode(chunked.words)
                numbers, offsets = chunked.numbers, chunked.offsets
                del chunked
                for b in text_slices(texts, BLOCK_BYTES):
                    places = offsets[b.start : b.stop + 1]
                    # the block's own dictionary: the words that it has
                    own, words = pd.factorize(numbers[places[0] : places[-1]])
                    flat, lengths = gather(values, starts, words)
                    first = np.concatenate(([0], np.cumsum(lengths)))
                    upto = np.concatenate(([0], np.cumsum(lengths[own])))
                    sizes = np.diff(upto[places - places[0]]) + 1
                    payload = pack_block(*compress(flat, first, own, places[1:] - places[0], end_id))
                    ids = keys.slice(b.start, b.stop - b.start).to_pylist()
                    known = [x for x in ids if x is not None]
                    row = {"part": task, "block": made, "low": min(known, default=None), "high": max(known, default=None), "n_ids": int(sizes.sum()), "ids": ids, "sizes": sizes.tolist(), "payload": payload}
                    yield pa.RecordBatch.from_pylist([row], schema=_BLOCK_ARROW)
                    made += 1

    return run


def _parts(blocks: DataFrame) -> DataFrame:
    """A row for each partition of blocks, with the highest id and the number of ids before it in order of its least id."""
    parts = blocks.groupBy("part").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n_ids").alias("n_ids"))
    order = Window.orderBy(F.col("low").asc_nulls_first(), F.col("high").asc_nulls_first(), "part")  # a row for each input partition
    return parts.withColumns({"last": F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1)), "before": F.sum("n_ids").over(order) - F.col("n_ids")})


def _in_order(blocks: DataFrame) -> bool:
    """Whether blocks ascend inside each partition, and partitions do not interleave."""
    inside = blocks.select("part", "low", F.lag("high").over(Window.partitionBy("part").orderBy("block")).alias("last"))
    return inside.select("low", "last").unionByName(_parts(blocks).select("low", "last")).where("last > low").isEmpty()


def write_tokens(documents: DataFrame, folder: str, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Write every text's ids, ``end_id`` after each, as blocks in ascending order of id (nulls first) under ``folder``.

    A null text counts as empty. Input whose partitions already hold disjoint ranges of ids is encoded in
    place; any other input is dealt by range first. Rows that repeat an id stand next to each other. An empty table
    gives an empty folder of files, which ``read_tokens`` reads as no rows. Other columns are not read and may have any names.
    The folder is the operator's output and stays; what it held before is replaced.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    spans = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count_if(F.col("id").isNull()).alias("nulls"), F.count(F.lit(1)).alias("n_ids"))
    spans = spans.withColumn("block", F.lit(0))
    in_place = spans.where("nulls > 0").isEmpty() and _in_order(spans)
    for dealt in [rows] * in_place + [rows.repartitionByRange("id")]:
        placed = dealt.sortWithinPartitions("id").mapInArrow(_block_rows(tokenizer_file, end_id), _BLOCK)
        placed.write.mode("overwrite").option("compression", "zstd").parquet(folder)
        if _in_order(documents.sparkSession.read.parquet(folder)):
            return
    raise RuntimeError("blocks interleave after dealing by range")


def _document_rows(with_ids: bool):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(part.num_rows):
                ids, sizes = part["ids"][k].values, part["sizes"][k].values.to_numpy()
                view = memoryview(decode_block(part["payload"][k].as_py()).astype("<u4").tobytes())
                start = np.cumsum(sizes) - sizes
                blobs = [view[4 * a : 4 * (a + n)] for a, n in zip(start.tolist(), sizes.tolist(), strict=True)]
                same = lambda c: pa.array(np.full(len(ids), part[c][k].as_py()))  # noqa: B023, E731
                columns = [same("part"), same("block"), ids, pa.array(start), pa.array(sizes), pa.array([zlib.crc32(b) for b in blobs], pa.int64())]
                if with_ids:
                    columns.append(pa.array([bytes(b) for b in blobs], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["part", "block", "id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    return run


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """One row per document from the files: ``id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32`` and,
    unless ``with_ids`` is false, ``ids`` (little-endian unsigned 32-bit).

    ``folder`` is one of ``write_tokens``. A null id comes back as null, before all others; rows that repeat an id come back each, and
    so does a text without ids of its own, as its end id. No blocks give no rows.
    """
    blocks = spark.read.parquet(folder)
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("n_ids")
    sums = blocks.select("part", "block", inside.alias("inside")).join(_parts(blocks).select("part", "before"), "part")
    sums = sums.select("part", "block", (F.col("before") + F.col("inside")).alias("before"))
    kinds = "part long, block long, id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    rows = blocks.select("part", "block", "ids", "sizes", "payload").mapInArrow(_document_rows(with_ids), kinds)
    out = rows.join(sums, ["part", "block"]).withColumn("start", F.col("start") + F.col("before"))
    return out.drop("part", "block", "before")
