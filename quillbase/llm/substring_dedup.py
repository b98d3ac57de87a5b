"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: of every 9 consecutive 5-word grams of a text the one with the least hash.
Any 13 consecutive words hold 9 such grams, so two documents that share a 13-word window share its
anchor. Documents are joined on anchors (in the form of a grouping, as a popular anchor must not emit
pairs); only anchors of two or more documents are extended, both ways, to the 13-word windows around
them; windows are matched by key with the least document that has them; matched windows that overlap or
touch merge into maximal repeats. Every step costs rows in proportion to the text, never to the square
of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbase.llm.common import cut, grams, slabs, trimmed, words_of

SEED = 5
LENGTH = 13
BATCH_BYTES = 4_000_000
#: Bits of the anchor filter at most (64 MB). Beyond its size the filter only lets more anchors through.
MOST_FILTER_BITS = 1 << 29


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive entries, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _windows(texts: list[str | None], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window inside one text: the text's place, the window's hash, its anchor's hash."""
    words = words_of(texts)
    ends = np.repeat(words.offsets[1:], np.diff(words.offsets))
    text = np.repeat(np.arange(len(texts)), np.diff(words.offsets))
    whole = grams(words.hashes, length)
    seeds = grams(words.hashes, SEED)
    anchors = _sliding_min(seeds, length - SEED + 1)[: len(whole)]
    inside = np.flatnonzero(np.arange(len(whole)) + length <= ends[: len(whole)])
    return text[inside], whole[inside], anchors[inside]


def _groups(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, id) pairs in order, and where each key begins."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
    keys, ids = keys[new], ids[new]
    first = np.ones(len(keys), dtype=bool)
    first[1:] = keys[1:] != keys[:-1]
    return keys, ids, np.flatnonzero(first)


def _anchor_rows(length: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids = part["id"].to_numpy()
            for s in slabs(BATCH_BYTES, part["text"]):
                text, _, anchors = _windows(part["text"][s].to_pylist(), length)
                if not len(text):
                    continue
                new = np.ones(len(text), dtype=bool)
                new[1:] = (anchors[1:] != anchors[:-1]) | (text[1:] != text[:-1])
                keys, docs, first = _groups(anchors[new], ids[s][text[new]])
                low, high = docs[first], docs[np.append(first[1:], len(docs)) - 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[first].view(np.int64)), pa.array(low), pa.array(high, mask=low == high)], names=["anchor", "low", "high"]
                )

    return run


def _window_rows(length: int, bits: Broadcast):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = bits.value
        mask = np.uint64(len(filled) * 8 - 1)
        for part in parts:
            ids = part["id"].to_numpy()
            for s in slabs(BATCH_BYTES, part["text"]):
                text, whole, anchors = _windows(part["text"][s].to_pylist(), length)
                at = anchors & mask
                hit = (filled[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                if not hit.any():
                    continue
                keys, docs, first = _groups(whole[hit], ids[s][text[hit]])
                rest = np.ones(len(docs), dtype=bool)
                rest[first] = False
                count = np.diff(np.append(first, len(docs))) - 1
                offsets = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
                others = pa.ListArray.from_arrays(pa.array(offsets), pa.array(docs[rest]))
                yield pa.RecordBatch.from_arrays([pa.array(keys[first].view(np.int64)), pa.array(docs[first]), others], names=["w", "low", "others"])

    return run


def _strip(length: int, passed: list[str]):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for s in slabs(BATCH_BYTES, part["_body"]):
                texts, own = part["_body"][s].to_pylist(), part["_gone"][s]
                counts, removed, spans, kept = [], [], [], []
                words = words_of(texts)
                whole = grams(words.hashes, length)
                for i, text in enumerate(texts):
                    a, b = int(words.offsets[i]), int(words.offsets[i + 1])
                    pieces = [] if text is None else text.encode("utf-8", "surrogatepass").split()
                    keep = np.ones(b - a, dtype=bool)
                    if own[i].is_valid and b - a >= length:
                        found = np.isin(whole[a : b - length + 1], np.asarray(own[i].values).view(np.uint64))
                        edge = np.zeros(b - a + 1, dtype=np.int64)
                        edge[: len(found)] += found
                        edge[length : length + len(found)] -= found
                        keep = np.cumsum(edge)[:-1] == 0
                    if keep.all():
                        spans.append([])
                    else:
                        turn = np.diff(np.concatenate(([1], keep.view(np.int8), [1])))
                        spans.append([{"start": int(x), "end": int(y)} for x, y in zip(np.flatnonzero(turn == -1), np.flatnonzero(turn == 1), strict=True)])
                        pieces = [w for w, k in zip(pieces, keep.tolist(), strict=True) if k]
                    counts.append(b - a)
                    removed.append(int((~keep).sum()))
                    kept.append(b" ".join(pieces).decode("utf-8", "surrogatepass"))
                arrays = [part[c].slice(s.start, s.stop - s.start) for c in passed]
                arrays += [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*passed, "_n_words", "_n_removed", "_spans", "_kept_text"])

    return run


def _filter_bits(anchors: DataFrame) -> np.ndarray:
    """A bitmap of the shared anchors, of 16 bits for each up to ``MOST_FILTER_BITS``, built by Spark's own aggregate."""
    size = 1 << 20
    rows = anchors.count()
    while size < 16 * rows and size < MOST_FILTER_BITS:
        size *= 2
    at = F.col("anchor").bitwiseAND(F.lit(size - 1)) + 1
    blocks = anchors.groupBy(F.bitmap_bucket_number(at).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(size // 8, dtype=np.uint8)
    for row in blocks.toLocalIterator():  # at most 64 MB in blocks of 4 KB
        out[(row["block"] - 1) * 4096 : row["block"] * 4096] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def removed_windows(documents: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """(doc, gone): the hashes of a document's windows that also start in a document with a smaller id."""
    spark = documents.sparkSession
    known = documents.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    anchors = known.mapInArrow(trimmed(_anchor_rows(length)), "anchor long, low long, high long")
    top = F.max(F.coalesce("high", "low"))
    shared = cut(anchors.groupBy("anchor").agg(F.min("low").alias("low"), top.alias("high")).where("low < high").select("anchor"))
    bits = spark.sparkContext.broadcast(_filter_bits(shared))
    windows = known.mapInArrow(trimmed(_window_rows(length, bits)), "w long, low long, others array<long>").repartition("w")
    # both sides read every column of ``windows``, so that they share one exchange
    least = windows.groupBy("w").agg(F.min("low").alias("least"), F.max(F.coalesce(F.size("others"), F.lit(0))).alias("most"))
    later = F.when(F.col("low") > F.col("least"), F.array("low")).otherwise(F.array().cast("array<long>"))
    found = windows.join(least, "w").where("low > least OR most > 0").select("w", F.explode(F.concat(later, "others")).alias("doc"))
    return found.groupBy("doc").agg(F.collect_list("w").alias("gone"))


def _judged(documents: DataFrame, id_col: str, text_col: str, length: int, keep: tuple[str, ...]) -> DataFrame:
    """(_id, _row: a struct of the columns in ``keep``, _n_words, _n_removed, _spans, _kept_text)."""
    if length < SEED + 1:
        raise ValueError(f"length must be over {SEED}")
    # one struct column carries what is kept, so no name can clash with those used here
    gone = removed_windows(documents, id_col, text_col, length)
    rows = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_body"), F.struct(F.lit(0).alias("_0"), *(F.col(f"`{c}`") for c in keep)).alias("_row"))
    joined = rows.join(gone.select(F.col("doc").alias("_doc"), F.col("gone").alias("_gone")), F.col("_id") == F.col("_doc"), "left").drop("_doc")
    kinds = dict(joined.dtypes)
    schema = f"_id {kinds['_id']}, _row {kinds['_row']}, _n_words long, _n_removed long, _spans array<struct<start:long,end:long>>, _kept_text string"
    return joined.mapInArrow(trimmed(_strip(length, ["_id", "_row"])), schema)


def substring_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``id_col``, ``_n_words``, ``_n_removed``, ``_spans`` (word ranges of the maximal repeats, end
    exclusive) and ``_kept_text`` (the other words, joined by one space), plus the columns in ``keep``.

    A word is removed if a window of ``length`` words that covers it also starts in a row with a smaller
    id; windows are those of the input. Rows with a null id keep all words and remove none elsewhere; a
    null text has no words; rows that repeat an id are judged each by itself and never against each
    other. An empty table gives an empty table. Other columns may have any names and types.
    """
    out = _judged(documents, id_col, text_col, length, keep)
    return out.select(F.col("_id").alias(id_col), *(F.col("_row")[c].alias(c) for c in keep if c != id_col), "_n_words", "_n_removed", "_spans", "_kept_text")


def dedup_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows with repeats taken out of the text (words joined by one space) and ``n_chars``, if there, set anew."""
    out = _judged(documents, id_col, text_col, LENGTH, tuple(documents.columns))
    changed = {text_col: F.col("_kept_text")} | ({"n_chars": F.length("_kept_text").cast("long")} if "n_chars" in documents.columns else {})
    return out.select(*(changed.get(c, F.col("_row")[c]).alias(c) for c in documents.columns))
