"""Importance resampling towards a target: hashed word n-grams, log-ratio gains by bucket, Gumbel draws without replacement.

Texts are read as Arrow's UTF-8 bytes. A lookup table lower-cases and classifies every byte, differences of
the classes are the words' edges, and a table-driven CRC-32 advances over all words of a block at once, a
byte of each word a step. Bucket counts are summed in each task before they are shuffled; the gains are a
table of fixed size. Ranks come from a histogram of the scores, whose range is bounded, so no task sorts
the whole corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillbase.llm.chunks import text_slices
from quillbase.llm.common import cut, scratch, trimmed

#: Texts of one slice; a longer one is a slice of its own.
SLICE_BYTES = 4_000_000
#: Words whose features are hashed at once.
BLOCK_WORDS = 500_000
#: Bytes of a word that all words of a block step through together; the few longer ones go on alone.
STEPS = 64
_POLYNOMIAL = 0xEDB88320


@dataclass(frozen=True)
class Settings:
    """``ngrams``: features are runs of 1 to so many words. ``percent`` of the documents with ``least_words`` are drawn."""

    ngrams: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: str = "2024"


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> np.uint32(1)) ^ np.uint32(_POLYNOMIAL), out >> np.uint32(1)).astype(np.uint32)
    return out


_CRC = _crc_table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Digits, letters of ASCII, and all bytes of other characters belong to words.
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an array and where each text begins and ends in them; a null text has none."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, places, data = texts.buffers()
    places = np.frombuffer(places, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    return raw[places[0] : places[-1]], places - places[0]


def words(raw: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start and length of each word, number of the first word of each text and of the end): words never span texts."""
    inside = _IN_WORD[raw]
    first = np.zeros(len(raw) + 1, dtype=bool)
    first[places] = True
    before = np.concatenate(([False], inside[:-1]))[: len(raw)]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.concatenate((inside[1:], [False]))[: len(raw)]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends - starts, np.searchsorted(starts, places)


def advance(state: np.ndarray, codes: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC register of each run of ``codes`` after its bytes, from ``state``: longest runs first, a byte of each run a step."""
    by = np.argsort(-length, kind="stable")
    register, at, length = state[by], at[by], length[by]
    live = np.searchsorted(-length, -np.arange(min(STEPS, int(length[0]) if len(length) else 0)), side="left")
    for k, n in enumerate(live.tolist()):
        register[:n] = _CRC[(register[:n] ^ codes[at[:n] + k]) & np.uint32(255)] ^ (register[:n] >> np.uint32(8))
    for i in range(int(np.searchsorted(-length, -STEPS, side="left"))):
        register[i] = zlib.crc32(codes[at[i] + STEPS : at[i] + length[i]], int(register[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(register)
    out[by] = register
    return out


def features(texts: pa.Array, ngrams: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text numbers, CRC-32 of the feature) in blocks: every run of 1 to ``ngrams`` words, joined by one space, as it ends."""
    raw, places = _bytes_of(texts)
    codes = _LOWER[raw]
    starts, lengths, firsts = words(raw, places)
    for a in range(0, len(starts), BLOCK_WORDS):
        ends = np.arange(a, min(a + BLOCK_WORDS, len(starts)))
        row = np.searchsorted(firsts, ends, side="right") - 1
        for k in range(ngrams):
            own = ends - k >= firsts[row]
            ends, row = ends[own], row[own]
            register = np.full(len(ends), 0xFFFFFFFF, dtype=np.uint32)
            for j in range(k, -1, -1):
                register = advance(register, codes, starts[ends - j], lengths[ends - j])
                if j:
                    register = _CRC[(register ^ np.uint32(32)) & np.uint32(255)] ^ (register >> np.uint32(8))
            yield row, register ^ np.uint32(0xFFFFFFFF)


def _count(settings: Settings) -> Callable[[Iterator], Iterator]:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(settings.buckets, dtype=np.int64)
        for part in parts:
            for s in text_slices(part["text"], SLICE_BYTES):
                for _, crc in features(part["text"][s], settings.ngrams):
                    total += np.bincount(crc % np.uint32(settings.buckets), minlength=settings.buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["bucket", "n"])

    return run


def _weigh(gains: np.ndarray, settings: Settings) -> Callable[[Iterator], Iterator]:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for s in text_slices(part["text"], SLICE_BYTES):
                ids, texts = part["id"][s], part["text"][s]
                n, total = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
                short = np.zeros(len(ids), dtype=np.int64)
                for k, (row, crc) in enumerate(features(texts, settings.ngrams)):
                    n += np.bincount(row, minlength=len(ids))
                    upto = np.concatenate(([0], np.cumsum(gains[crc % np.uint32(settings.buckets)])))
                    edges = np.searchsorted(row, np.arange(len(ids) + 1))  # rows ascend inside a block
                    total += upto[edges[1:]] - upto[edges[:-1]]
                    if k % settings.ngrams == 0:
                        short += np.diff(edges)
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(short), pa.array(weight)], names=["id", "n_features", "n_words", "weight"])

    return run


def bucket_counts(rows: DataFrame, settings: Settings) -> DataFrame:
    """(bucket, n): features of all texts of ``rows`` (text), summed in each task first."""
    return rows.select("text").mapInArrow(trimmed(_count(settings)), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(documents: DataFrame, target: DataFrame, settings: Settings) -> DataFrame:
    """(bucket, gain) of every bucket: 1000 times the log-ratio of the target's and the corpus's smoothed shares, rounded down."""
    spark, size = documents.sparkSession, float(settings.buckets)
    corpus, wanted = cut(bucket_counts(documents, settings)), cut(bucket_counts(target, settings))
    sums = [float(x.agg(F.sum("n")).first()[0] or 0) for x in (corpus, wanted)]  # two numbers
    every = spark.range(settings.buckets).select(F.col("id").alias("bucket"))
    both = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(wanted.withColumnRenamed("n", "t"), "bucket", "left")
    s, t = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in "st")
    return both.select("bucket", F.floor(1000 * F.log((t + 1) * (sums[0] + size) / ((s + 1) * (sums[1] + size)))).alias("gain"))


def noise(ids: Column, seed: str) -> Column:
    """A Gumbel draw of each id, in thousandths, rounded down: the id's hash under ``seed`` makes the uniform number."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(ids.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def _ranked(scored: DataFrame, settings: Settings) -> DataFrame:
    """``scored`` with ``rank``. Scores are whole numbers of a bounded range, so their histogram is small and tells how many
    rows stand before each score; only rows of one score are put in order together."""
    able = F.col("n_words") >= settings.least_words
    counts = cut(scored.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")).withColumn("cell", F.floor(F.col("score") / 256)))
    cells = counts.groupBy("cell").agg(F.sum("n").alias("n"))
    later = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each 256 scores
    base = cells.select(F.col("cell").alias("_cell"), F.coalesce(F.sum("n").over(later), F.lit(0)).alias("base"))
    inner = Window.partitionBy("cell").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    own = counts.withColumn("own", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    before = own.join(F.broadcast(base), F.col("cell") == F.col("_cell")).select(F.col("score").alias("_score"), (F.col("base") + F.col("own")).alias("before"))
    size = counts.agg(F.sum("n")).first()[0] or 0  # one number
    draws = settings.percent * size // 100
    before = cut(before.where(F.col("before") < draws))
    placed = scored.withColumn("_able", able).join(F.broadcast(before), F.col("_able") & (F.col("score") == F.col("_score")), "left")  # at most a row for each score
    tie = Window.partitionBy("score").orderBy(F.asc_nulls_last("id"))
    drawn = placed.where("before IS NOT NULL").withColumn("rank", F.col("before") + F.row_number().over(tie))
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= draws, F.col("rank")))
    rest = placed.where("before IS NULL").withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("id", "n_features", "weight", "score", "rank")


def resample(documents: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per input row: ``id_col``, ``n_features``, ``weight``, ``score`` and ``rank`` (null where not drawn), all long.

    A null or empty text has no features and weight 0 and is never drawn; a null id hashes as an empty one and
    comes last in ties; repeated rows are judged and ranked each. An empty ``target`` or table is allowed: all
    gains then come from the smoothing. Other columns are not read and may have any names. Tables made on
    the way are deleted; the scores last.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    with scratch(documents.sparkSession):
        table = bucket_gains(rows, target.select(F.col(target_col).alias("text")), settings).collect()  # ``buckets`` rows
        gains = np.zeros(settings.buckets, dtype=np.int64)
        gains[[r.bucket for r in table]] = [r.gain for r in table]
        weighed = rows.mapInArrow(trimmed(_weigh(gains, settings)), "id long, n_features long, n_words long, weight long")
        scored = cut(weighed.withColumn("score", F.col("weight") + noise(F.col("id"), settings.seed)))
        return cut(_ranked(scored, settings), lasting=True).withColumnRenamed("id", id_col)


def draw_documents(documents: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The input rows, all columns of any names, whose id has a drawn row; rows without an id are not drawn."""
    ranks = resample(documents, target, id_col, text_col, target_col, settings)
    drawn = ranks.where("rank IS NOT NULL").select(F.col(id_col).alias("_drawn_id")).distinct()
    return documents.join(drawn, documents[id_col] == drawn["_drawn_id"], "left_semi")
