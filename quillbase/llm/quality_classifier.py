"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of character n-grams.

N-grams of trusted text are counted batch by batch and summed in tables sharded by n-gram; every lower
order, discount and back-off weight comes from those tables by grouping. For scoring, documents are cut
into chunks of bounded size, each with the list of its distinct n-grams. The n-grams that occur anywhere
are joined, order by order, with the count tables; each chunk then gets back the log-probabilities of
its own n-grams and scores its documents. What moves is a row for each distinct n-gram of a chunk, so
neither documents nor the model meet in one place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillbase.llm.common import batches, cut, release_memory, scratch, small_enough_to_broadcast, trimmed

START = "\x02"
CHUNK_CHARS = 8_000_000
#: Characters whose n-grams a task works on at once; longer texts come in pieces.
SLAB_CHARS = 2_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """``reach``: a text is kept between the quartiles of its language less and plus ``reach`` quartile distances.

    ``prior_chars``: a text is judged as if so many more characters had its language's median, as the
    mean over a few characters says little. ``few``: a language with fewer distinct trusted texts, whose
    quartiles are unsteady, has at least the quartile distance of all languages' trusted texts.
    ``held``: one of so many distinct trusted texts, by a hash of the text, is not learned but sets the
    limits, as the model knows the texts that it has learned better than any new one.
    """

    order: int = 4
    reach: float = 6.0
    prior_chars: int = 100
    few: int = 20
    held: int = 5


def _pieces(ids, langs, trusted, keys, texts, order: int, base: int):
    """(uid, id, lang, trusted, text key, context and body): long texts in several pieces that share a uid."""
    for i, text in enumerate(texts):
        body = START * (order - 1) + (text or "").replace(START, "\ufffd")
        for a in range(0, max(len(body) - order + 1, 1), SLAB_CHARS):
            yield base + i, ids[i], langs[i], trusted[i], keys[i], body[a : a + SLAB_CHARS + order - 1]


def _codes(joined: str) -> np.ndarray:
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    odd = (codes == 0) | ((codes >= 0xD800) & (codes < 0xE000))
    return np.where(odd, np.uint32(0xFFFD), codes) if odd.any() else codes


def _names(codes: np.ndarray, order: int) -> np.ndarray:
    """A 64-bit name of each ``order`` consecutive characters."""
    out = np.zeros(len(codes) - order + 1, dtype=np.uint64)
    for k in range(order):
        out *= _STEP
        out += codes[k : k + len(out)]
    return out


def _grams(joined: str, lengths: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, places of the n-grams inside one piece, their dictionary numbers, the dictionary's names, n-grams in each piece."""
    codes = _codes(joined)
    ends = np.cumsum(lengths)
    inside = np.ones(max(len(codes), 1), dtype=bool)
    for k in range(1, order):
        inside[np.maximum(ends - k, 0)] = False
    places = np.flatnonzero(inside[: len(codes)])
    if not len(places):
        return codes, places, np.empty(0, np.int64), np.empty(0, np.uint64), np.zeros(len(lengths), np.int64)
    numbers, names = pd.factorize(_names(codes, order)[places].view(np.int64))
    return codes, places, numbers, names.view(np.uint64), np.maximum(lengths - order + 1, 0)


def _texts(codes: np.ndarray, places: np.ndarray, numbers: np.ndarray, size: int, order: int) -> list[str]:
    """The n-grams of a dictionary in its order."""
    first = np.empty(size, dtype=np.int64)
    first[numbers[::-1]] = places[::-1]
    return np.ascontiguousarray(codes[first[:, None] + np.arange(order)]).view(f"<U{order}").ravel().tolist() if size else []


def _slabs(joined: str, lengths: np.ndarray) -> Iterator[tuple[int, int, str]]:
    """(first piece, piece after the last, their text) of runs of pieces of about ``SLAB_CHARS``."""
    ends = np.concatenate(([0], np.cumsum(lengths)))
    a = 0
    while a < len(lengths):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + SLAB_CHARS, side="right")) - 1)
        yield a, b, joined[ends[a] : ends[b]]
        a = b


def _count_rows(order: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part["text"].to_pylist()
            for s in batches(texts, SLAB_CHARS):
                blank = [None] * (s.stop - s.start)
                for held in _held(_pieces(blank, blank, blank, blank, texts[s], order, 0)):
                    codes, places, numbers, names, _ = _grams("".join(held), np.array([len(x) for x in held]), order)
                    yield pa.RecordBatch.from_arrays([pa.array(_texts(codes, places, numbers, len(names), order), pa.string()), pa.array(np.bincount(numbers, minlength=len(names)))], names=["g", "n"])

    return run


def _held(pieces: Iterator[tuple]) -> Iterator[list[str]]:
    """Pieces' texts in lists of bounded size."""
    held, size = [], 0
    for piece in pieces:
        if held and size + len(piece[5]) > SLAB_CHARS:
            yield held
            held, size = [], 0
        held.append(piece[5])
        size += len(piece[5])
    if held:
        yield held


def _chunk_rows(order: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, task = zstandard.ZstdCompressor(level=6), TaskContext.get().partitionId()
        held: list[tuple] = []
        size = rows = chunks = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, chunks
            joined, lengths, grams = "".join(x[5] for x in held), np.array([len(x[5]) for x in held]), {}
            for a, b, text in _slabs(joined, lengths):
                codes, places, numbers, names, _ = _grams(text, lengths[a:b], order)
                grams.update(dict.fromkeys(_texts(codes, places, numbers, len(names), order)))
            row = {
                "chunk": task * (1 << 32) + chunks, "uid": [x[0] for x in held], "id": [x[1] for x in held], "lang": [x[2] for x in held], "trusted": [x[3] for x in held], "key": [x[4] for x in held],
                "lengths": lengths.tolist(), "packed": packer.compress(joined.encode("utf-8", "surrogatepass")), "grams": list(grams),
            }
            held, size, chunks = [], 0, chunks + 1
            return pa.RecordBatch.from_pylist([row], schema=_CHUNK_ARROW)

        for part in parts:
            columns = [part[c].to_pylist() for c in ("id", "lang", "trusted", "key", "text")]
            for piece in _pieces(*columns, order, task * (1 << 40) + rows):
                if held and size + len(piece[5]) > CHUNK_CHARS:
                    yield flush()
                held.append(piece)
                size += len(piece[5])
            rows += len(columns[0])
        if held:
            yield flush()

    return run


_CHUNK_ARROW = pa.schema(
    [("chunk", pa.int64()), ("uid", pa.list_(pa.int64())), ("id", pa.list_(pa.int64())), ("lang", pa.list_(pa.string())), ("trusted", pa.list_(pa.bool_())), ("key", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("packed", pa.binary()), ("grams", pa.list_(pa.string()))]
)
_CHUNK = "chunk long, uid array<long>, id array<long>, lang array<string>, trusted array<boolean>, key array<long>, lengths array<long>, packed binary, grams array<string>"


def _gram_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for k in range(part.num_rows):
            grams = part["grams"][k].values
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), part["chunk"][k].as_py())), grams], names=["chunk", "g"])


def _score(order: int):
    def run(chunk: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        keys = _names(_codes("".join(known["g"].to_pylist())), order)[::order] if known.num_rows else np.empty(0, np.uint64)
        by = np.argsort(keys)
        keys, logs = keys[by], known["log_p"].to_numpy()[by]
        for row in chunk.to_pylist():
            joined = zstandard.ZstdDecompressor().decompress(row["packed"]).decode("utf-8", "surrogatepass")
            lengths = np.array(row["lengths"])
            total, counts = np.zeros(len(lengths)), np.zeros(len(lengths), dtype=np.int64)
            for a, b, text in _slabs(joined, lengths):
                _, _, numbers, names, own = _grams(text, lengths[a:b], order)
                counts[a:b] = own
                if not len(names):
                    continue
                at = np.searchsorted(keys, names)
                if not len(keys) or (keys[np.minimum(at, len(keys) - 1)] != names).any():
                    raise ValueError("n-grams of a chunk have no probability: its rows were dealt anew in another order")
                each = logs[at][numbers]
                full = np.flatnonzero(own)
                total[a + full] = np.add.reduceat(each, np.concatenate(([0], np.cumsum(own[full])[:-1])))
            release_memory()
            out.append(pa.table({"uid": row["uid"], "id": pa.array(row["id"], pa.int64()), "lang": pa.array(row["lang"], pa.string()), "trusted": row["trusted"], "key": pa.array(row["key"], pa.int64()), "log_p": total, "n": pa.array(counts, pa.int64())}))
        return pa.concat_tables(out) if out else pa.table({"uid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "lang": pa.array([], pa.string()), "trusted": pa.array([], pa.bool_()), "key": pa.array([], pa.int64()), "log_p": pa.array([], pa.float64()), "n": pa.array([], pa.int64())})

    return run


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The modified discounts from the counts of counts; 0.5, 1 and 1.5 where those are too few."""
    n = counts.agg(*(F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4))).first()  # four numbers
    if not (n[0] and n[1] and n[2]):
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    raw = (1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2])
    return tuple(min(max(r, 0.1 * k), 0.95 * k) for k, r in enumerate(raw, 1))


def order_tables(counts: DataFrame, order: int) -> list[DataFrame]:
    """For each order from 1: (g, context, top, rest), with the discounted share of g after its context and what
    the context leaves for lower orders. ``counts``: (g, n), the n-grams of trusted text; lower orders
    count distinct left neighbours."""
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        levels[k] = cut(levels[k + 1].groupBy(F.substring("g", 2, k).alias("g")).agg(F.count(F.lit(1)).alias("n")))
    out = []
    for k in range(1, order + 1):
        d1, d2, d3 = _discounts(levels[k])
        spared = F.when(F.col("n") >= 3, d3).when(F.col("n") == 2, d2).otherwise(d1)
        context = F.substring("g", 1, k - 1)
        sums = levels[k].groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.sum(spared).alias("spared"), F.count(F.lit(1)).alias("kinds"))
        table = levels[k].select("g", context.alias("context"), F.greatest(F.col("n") - spared, F.lit(0.0)).alias("kept")).join(sums, "context")
        out.append(cut(table.select("g", "context", (F.col("kept") / F.col("total")).alias("top"), (F.col("spared") / F.col("total")).alias("rest"), "kinds")))
    return out


def probabilities(wanted: DataFrame, counts: DataFrame, order: int) -> DataFrame:
    """(g, log_p) for every row (g) of ``wanted``: the log-probability of its last character after the others."""
    tables = order_tables(counts, order)
    base = tables[0].select("rest", "kinds").first()  # two numbers: the rest is spread over the seen characters and one unseen
    floor = base["rest"] / (base["kinds"] + 1) if base else 1.0
    out = wanted.withColumn("p", F.lit(floor))
    for k, table in enumerate(tables, 1):
        tail, before = F.substring("g", order - k + 1, k), F.substring("g", order - k + 1, k - 1)
        out = out.withColumns({"_tail": tail, "_before": before}).join(table.select(F.col("g").alias("_tail"), "top"), "_tail", "left")
        if k > 1:
            out = out.join(table.select(F.col("context").alias("_before"), "rest").distinct(), "_before", "left")
            out = out.withColumn("p", F.coalesce("rest", F.lit(1.0)) * F.col("p"))
        out = out.select("g", (F.coalesce("top", F.lit(0.0)) + F.col("p")).alias("p"))
    return out.select("g", F.log("p").cast("float").alias("log_p"))


def distinct_texts(rows: DataFrame) -> DataFrame:
    """(text): each text of ``rows`` (id, key, text) once. Only keys are shuffled, and texts that one id repeats."""
    held = rows.groupBy("key", "id").agg(F.count(F.lit(1)).alias("copies")).groupBy("key").agg(F.min(F.struct("id", "copies")).alias("one"))
    held = cut(held.select(F.col("key").alias("_key"), F.col("one.id").alias("_id"), F.col("one.copies").alias("copies")))
    spread = F.broadcast if small_enough_to_broadcast(held.count(), 24) else lambda x: x
    mine = (F.col("key") == F.col("_key")) & (F.col("id") == F.col("_id"))
    once = rows.join(spread(held.where("copies = 1")), mine, "left_semi").select("text")
    again = held.where("copies > 1")
    return once if again.isEmpty() else once.unionByName(rows.join(spread(again), mine, "left_semi").select("text").distinct())


def is_held(held: int):
    """Whether the trusted text of a key sets limits and is not learned."""
    return F.pmod(F.col("key"), F.lit(held)) == 0


def perplexities(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings = Settings(), once: bool = False, held: int = 0) -> DataFrame:
    """(id, lang, trusted, key, log_p, n) for every input row: the natural log-probability of its n characters; equal texts share a key.

    With ``once``, equal trusted texts are counted once, so that a text with many copies is not learned by heart.
    With ``held``, trusted texts that ``is_held`` names are not learned.
    """
    trusted = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select(F.col("doc_id").alias("_t"))
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    trusted = cut(trusted)
    if small_enough_to_broadcast(trusted.count(), 16):
        trusted = F.broadcast(trusted)
    learned = rows.join(trusted, F.col("id") == F.col("_t"), "left_semi")
    learned = learned.where(~is_held(held)) if held else learned
    counted = (distinct_texts(learned) if once else learned.select("text")).mapInArrow(trimmed(_count_rows(settings.order)), "g string, n long")
    counts = cut(counted.groupBy("g").agg(F.sum("n").alias("n")))
    rows = rows.join(trusted, F.col("id") == F.col("_t"), "left").select("id", "lang", F.col("_t").isNotNull().alias("trusted"), "key", "text")
    chunks = rows.mapInArrow(trimmed(_chunk_rows(settings.order)), _CHUNK).repartition("chunk")
    listed = chunks.mapInArrow(_gram_rows, "chunk long, g string")
    known = listed.join(probabilities(listed.select("g").distinct(), counts, settings.order), "g")
    kind = "uid long, id long, lang string, trusted boolean, key long, log_p double, n long"
    scored = chunks.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_score(settings.order), kind)
    # a text in several pieces has its sums added up; a uid belongs to one row
    whole = scored.groupBy("uid").agg(F.max("id").alias("id"), F.max("lang").alias("lang"), F.max("trusted").alias("trusted"), F.max("key").alias("key"), F.sum("log_p").alias("log_p"), F.sum("n").alias("n"))
    return cut(whole.select("id", "lang", "trusted", "key", "log_p", "n"), lasting=True)


def _quartiles(cells: DataFrame) -> DataFrame:
    """(lang, q1, middle, q3, texts) of (lang, cell, k), in nats."""
    ordered = Window.partitionBy("lang").orderBy("cell")
    run = cells.withColumns({"upto": F.sum("k").over(ordered), "all": F.sum("k").over(Window.partitionBy("lang"))})
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("cell"))) / 1000
    return run.groupBy("lang").agg(at(0.25).alias("q1"), at(0.5).alias("middle"), at(0.75).alias("q3"), F.max("all").alias("texts"))


def language_limits(scores: DataFrame, settings: Settings) -> DataFrame:
    """(lang, low, middle, high) in nats per character: exact quartiles, on a grid of 0.001, of the distinct trusted texts that
    were held out, or of all of them in a language with fewer than ``few`` of those."""
    cell = F.round(-F.col("log_p") / F.col("n") * 1000).cast("long")
    texts = scores.where("trusted AND n > 0").groupBy("lang", "key").agg(F.min(cell).alias("cell"))
    new = is_held(settings.held) if settings.held else F.lit(True)
    counted = cut(texts.groupBy("lang", "cell").agg(F.count(F.lit(1)).alias("k"), F.count_if(new).alias("k_new")))
    enough = F.sum("k_new").over(Window.partitionBy("lang")) >= settings.few
    cells = counted.select("lang", "cell", F.when(enough, F.col("k_new")).otherwise(F.col("k")).alias("k")).where("k > 0")
    every = cells.groupBy("cell").agg(F.sum("k").alias("k")).withColumn("lang", F.lit(None).cast("string"))
    usual = _quartiles(every).select((F.col("q3") - F.col("q1")).alias("usual"))
    found = _quartiles(cells).withColumnRenamed("lang", "_lang").join(F.broadcast(usual))  # one number
    own = F.col("q3") - F.col("q1")
    wide = F.when(F.col("texts") < settings.few, F.greatest(own, F.col("usual"))).otherwise(own) * settings.reach
    return found.select("_lang", (F.col("q1") - wide).alias("low"), "middle", (F.col("q3") + wide).alias("high"))


def quality_classifier(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings = Settings()) -> DataFrame:
    """One row per input row: ``id_col``, ``n_scored``, ``perplexity``, ``low`` and ``high`` (perplexities) and ``kept``.

    Trusted are the rows whose id has only labels of quality 1. A text is kept if its perplexity per
    character, drawn towards its language's median as ``Settings`` says, lies within its language's
    limits; trusted texts with copies count once. Most trusted texts make the model and the others, new to it,
    the limits. A null or empty text has a null perplexity and is not kept; a language (null counts as one)
    without trusted text has null limits and its texts are kept. Rows with a null id are never trusted;
    repeated rows are judged each alike. An empty table gives an empty table; without labels all
    non-empty texts are kept. In a text, the character that marks starts (U+0002) counts as U+FFFD. Tables made on
    the way are deleted; the scores last.
    """
    with scratch(documents.sparkSession):
        scores = perplexities(documents, labels, id_col, text_col, lang_col, settings, once=True, held=settings.held)
        limits = cut(language_limits(scores, settings), lasting=True)
    out = scores.join(F.broadcast(limits), F.col("lang").eqNullSafe(F.col("_lang")), "left")  # four numbers a language
    drawn = (-F.col("log_p") + F.col("middle") * settings.prior_chars) / (F.col("n") + settings.prior_chars)
    kept = (F.col("n") > 0) & F.coalesce(drawn.between(F.col("low"), F.col("high")), F.lit(True))
    mean = F.when(F.col("n") > 0, -F.col("log_p") / F.col("n"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_scored"), F.exp(mean).alias("perplexity"), F.exp("low").alias("low"), F.exp("high").alias("high"), kept.alias("kept"))


def keep_documents(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings = Settings()) -> DataFrame:
    """The input rows, all columns of any names, whose id has no rejected row; rows without an id stay."""
    out = quality_classifier(documents, labels, id_col, text_col, lang_col, settings)
    rejected = out.where(~F.col("kept")).select(F.col(id_col).alias("_rejected")).distinct()
    return documents.join(rejected, documents[id_col] == rejected["_rejected"], "left_anti")
