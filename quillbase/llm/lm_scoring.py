"""Corpus-wide language-model scores from sharded Elias-Fano tries.

Documents become chunks of words, each word a place in its chunk's dictionary. Dictionaries meet in shards
by word, which count and number the words of training documents. With those numbers a chunk knows its
distinct pairs of neighbours and sends them, once, to the shards of their first words: there the training
counts are summed, a trie of discounted shares is built, and the same lists are looked up in it. A chunk
gets back two codes a pair and scores its documents. What moves is packed lists of distinct words and
pairs of a chunk; shards are as many as the corpus needs, and a first word that would overfill one is
spread over several by its second word.

The model: interpolated, with modified discounts. A pair has the share (c - D) / c(context), and the
context leaves what its discounts freed to the single words; these have (c - D) / N, and what that frees is
the probability of the one type that stands for all unknown words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbase.llm.chunks import text_slices
from quillbase.llm.common import SPACE_CLASS, cut, mix64, release_memory, scratch, trimmed, words_of
from quillbase.llm.lm_trie import Trie, quantise, restore, runs

#: The token that ends a document and stands before its first word, in place of a word's hash.
END = np.uint64(0x51ED270B0A1F39C1)
SLICE_BYTES, CHUNK_TOKENS = 2_000_000, 700_000
#: Bytes of text to a shard, and training tokens from which a first word is spread over several shards.
SHARD_BYTES, HOT_TOKENS = 16_000_000, 500_000
#: Pairs that are looked up in one pass over a trie.
PASS_PAIRS = 1_000_000
#: At most so many first words are spread: their table goes to every task.
MOST_HOT = 1_000_000


@dataclass(frozen=True)
class Settings:
    """A document is held out where the CRC-32 of its id as text has the remainder ``held_out`` modulo ``parts``."""

    parts: int = 7
    held_out: int = 2


@dataclass(frozen=True)
class Model:
    """What every task knows: a few numbers, and the hot first words (ascending numbers, totals, codes of what they leave)."""

    shards: int
    tokens: int
    words: int
    discounts: tuple[float, float, float]
    hot_limit: int
    pair_discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)
    free: float = 1.0
    hot: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None


def squeeze(values: np.ndarray) -> bytes:
    """Whole numbers as bytes: all first bytes, then all second ones, and so on, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unsqueeze(blob: bytes) -> np.ndarray:
    """The numbers of ``squeeze``."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel()


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The modified discounts from the counts of counts; 0.5, 1 and 1.5 where those are too few."""
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(r, 0.1 * k), 0.95 * k) for k, r in enumerate(raw, 1))


def spared(counts: np.ndarray, by: tuple[float, float, float]) -> np.ndarray:
    """What is taken off each count."""
    return np.array([0.0, *by])[np.minimum(counts, 3).astype(np.int64)]


_SPACE = re.compile(f"[{SPACE_CLASS}]")


def _sequences(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(text number, context and tokens) of each text; a single very long one in pieces, cut at white space, each with the word before it."""
    if len(texts) > 1 or len(texts[0] or "") <= SLICE_BYTES:
        w = words_of(texts, lower_ascii=True)
        for i in range(len(texts)):
            yield i, np.concatenate(([END], w.hashes[w.offsets[i] : w.offsets[i + 1]], [END]))
        return
    text, a, before = texts[0], 0, END
    while a < len(text):
        cut_at = _SPACE.search(text, a + SLICE_BYTES)
        b = cut_at.start() if cut_at else len(text)
        own = words_of([text[a:b]], lower_ascii=True).hashes
        yield 0, np.concatenate(([before], own, [END] if b == len(text) else np.empty(0, np.uint64)))
        a, before = b, own[-1] if len(own) else before


_PIECES = [("uid", pa.list_(pa.int64())), ("id", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64()))]
_CHUNK_ARROW = pa.schema([("chunk", pa.int64()), *_PIECES, ("tokens", pa.binary()), ("words", pa.list_(pa.struct([("shard", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])))])
_CHUNK = "chunk long, uid array<long>, id array<long>, held array<boolean>, sizes array<long>, tokens binary, words array<struct<shard: int, hashes: binary, counts: binary>>"


def _inner(sizes: np.ndarray) -> np.ndarray:
    """Which tokens of a chunk are events: all but the context that each piece begins with."""
    out = np.ones(int(sizes.sum()), dtype=bool)
    out[np.cumsum(sizes) - sizes] = False
    return out


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(shard, slice) of a list that is ordered by shard."""
    return ((int(shard[a]), slice(a, b)) for a, b in runs(shard))


def _chunk_rows(shards: int) -> Callable[[Iterator], Iterator]:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows, chunks, size = TaskContext.get().partitionId(), 0, 0, 0
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal held, chunks, size
            known, numbers = np.unique(np.concatenate([x[3] for x in held]), return_inverse=True)
            sizes = np.array([len(x[3]) for x in held])
            learned = _inner(sizes) & ~np.repeat([x[2] for x in held], sizes)
            counts = np.bincount(numbers[learned], minlength=len(known))
            shard = ((known >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)  # slices of the hash range, so their order is the dictionary's
            words = [{"shard": k, "hashes": squeeze(known[s]), "counts": squeeze(counts[s])} for k, s in _by_shard(shard.astype(np.int64))]
            row = {"chunk": task * (1 << 32) + chunks, "uid": [x[0] for x in held], "id": [x[1] for x in held], "held": [x[2] for x in held], "sizes": sizes.tolist(), "tokens": squeeze(numbers), "words": words}
            held, size, chunks = [], 0, chunks + 1
            return pa.RecordBatch.from_pylist([row], schema=_CHUNK_ARROW)

        for part in parts:
            for s in text_slices(part["text"], SLICE_BYTES):
                ids, outs = part["id"][s].to_pylist(), part["held"][s].to_pylist()
                for i, sequence in _sequences(part["text"][s].to_pylist()):
                    held.append((task * (1 << 40) + rows + i, ids[i], outs[i], sequence))
                    size += len(sequence)
                    if size > CHUNK_TOKENS:
                        yield flush()
                rows += len(ids)
        if held:
            yield flush()

    return run


_WORD_ANSWERS = "chunk long, shard int, first binary, second binary, words long, tokens long, n1 long, n2 long, n3 long, n4 long"


def _number_words(shards: int) -> Callable[[pa.Table], pa.Table]:
    """For a shard's lists of words: each list's numbers (0 for a word that no training text has, else 1 and more) and training
    counts; and a row (chunk -1) with the shard's sums. Frequent words have small numbers."""

    def run(lists: pa.Table) -> pa.Table:
        shard = lists["shard"][0].as_py()
        hashes, counts = ([unsqueeze(x) for x in lists[c].to_pylist()] for c in ("hashes", "counts"))
        known, place = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.zeros(len(known), dtype=np.int64)
        np.add.at(total, place, np.concatenate(counts).astype(np.int64))
        order = np.argsort(-total, kind="stable")
        rank = np.empty(len(known), dtype=np.int64)
        rank[order] = np.arange(len(known))
        number = np.where(total > 0, rank * shards + shard + 1, 0)
        ends = np.cumsum([len(x) for x in hashes])
        own = [place[e - len(x) : e] for x, e in zip(hashes, ends, strict=True)]
        n = [int((total == k).sum()) for k in (1, 2, 3, 4)]
        empty = [0] * len(own)
        columns = [
            [*lists["chunk"].to_pylist(), -1], [shard] * (len(own) + 1), [*(squeeze(number[x]) for x in own), None], [*(squeeze(total[x]) for x in own), None],
            [*empty, int((total > 0).sum())], [*empty, int(total.sum())], *([*empty, k] for k in n),
        ]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 6]
        release_memory()
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["chunk", "shard", "first", "second", "words", "tokens", "n1", "n2", "n3", "n4"])

    return run


class _Pairs:
    """The distinct pairs of a chunk whose first word is known (all unknown second words are one, 0), ordered by shard and
    then by word numbers: what a chunk sends and gets back."""

    def __init__(self, chunk: dict, answers: list[dict], model: Model) -> None:
        answers = sorted(answers, key=lambda x: x["shard"])
        self.numbers = np.concatenate([unsqueeze(x["first"]) for x in answers]).astype(np.int64)
        self.counts = np.concatenate([unsqueeze(x["second"]) for x in answers]).astype(np.int64)
        self.tokens, sizes = unsqueeze(chunk["tokens"]).astype(np.int64), np.array(chunk["sizes"])
        self.inner = _inner(sizes)
        self.events = np.flatnonzero(self.inner)
        learned = ~np.repeat(np.array(chunk["held"], dtype=bool), sizes)
        words, at, rank = np.unique(self.numbers, return_index=True, return_inverse=True)
        a, b = self.tokens[self.events - 1], self.tokens[self.events]
        self.asked = np.flatnonzero(self.numbers[a] > 0)
        keys, place = np.unique(rank[a[self.asked]] * len(words) + rank[b[self.asked]], return_inverse=True)
        one, two = np.divmod(keys, len(words))
        self.first, self.second = words[one], words[two]
        n = np.bincount(place[learned[self.events[self.asked]]], minlength=len(keys))
        pieces = 1 + self.counts[at][one] // model.hot_limit
        spread = (mix64(self.second.astype(np.uint64)) % pieces.astype(np.uint64)).astype(np.int64)
        shard = (self.first + spread) % model.shards
        by = np.argsort(shard, kind="stable")
        at = np.empty(len(by), dtype=np.int64)
        at[by] = np.arange(len(by))
        self.place = at[place]
        self.shard, self.first, self.second, self.n, self.spread = shard[by], self.first[by], self.second[by], n[by], pieces[by] > 1


_LISTS = "chunk long, shard int, first binary, second binary, counts binary, spread binary"


def _send_pairs(model: Model) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        for row in chunk.to_pylist():
            p = _Pairs(row, answers.to_pylist(), model)
            rows += [{"chunk": row["chunk"], "shard": k, "first": squeeze(np.diff(p.first[s], prepend=0)), "second": squeeze(p.second[s]), "counts": squeeze(p.n[s]), "spread": squeeze(np.unique(p.first[s][p.spread[s]]))} for k, s in _by_shard(p.shard)]
        release_memory()
        return pa.Table.from_pylist(rows, schema=pa.schema([("chunk", pa.int64()), ("shard", pa.int32()), ("first", pa.binary()), ("second", pa.binary()), ("counts", pa.binary()), ("spread", pa.binary())]))

    return run


_SHARD_ARROW = pa.schema(
    [("shard", pa.int32()), ("first", pa.binary()), ("second", pa.binary()), ("counts", pa.binary()), *((f"n{k}", pa.int64()) for k in (1, 2, 3, 4)), ("hot", pa.list_(pa.struct([("word", pa.int64()), ("total", pa.int64()), ("n1", pa.int64()), ("n2", pa.int64()), ("n3", pa.int64())]))), ("chunk", pa.list_(pa.int64())), ("firsts", pa.list_(pa.binary())), ("seconds", pa.list_(pa.binary()))]
)
_SHARD = "shard int, first binary, second binary, counts binary, n1 long, n2 long, n3 long, n4 long, hot array<struct<word: long, total: long, n1: long, n2: long, n3: long>>, chunk array<long>, firsts array<binary>, seconds array<binary>"


def _contexts(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct first words, and their totals and numbers of pairs seen once, twice and more often, a row each."""
    begins = np.flatnonzero(np.diff(first, prepend=-1))
    if not len(begins):
        return first[:0], np.zeros((0, 4), dtype=np.int64)
    kinds = [counts, counts == 1, counts == 2, counts >= 3]
    return first[begins], np.column_stack([np.add.reduceat(x.astype(np.int64), begins) for x in kinds])


def _merge_pairs(model: Model) -> Callable[[pa.Table], pa.Table]:
    """A shard's pairs with their training counts, its counts of counts, its part of each spread word, and all that was asked."""

    def run(lists: pa.Table) -> pa.Table:
        firsts, seconds = lists["first"].to_pylist(), lists["second"].to_pylist()
        a, i = np.unique(np.concatenate([np.cumsum(unsqueeze(x)) for x in firsts]).astype(np.int64), return_inverse=True)
        b, j = np.unique(np.concatenate([unsqueeze(x) for x in seconds]).astype(np.int64), return_inverse=True)
        keys, place = np.unique(i * len(b) + j, return_inverse=True)
        n = np.zeros(len(keys), dtype=np.int64)
        np.add.at(n, place, np.concatenate([unsqueeze(x) for x in lists["counts"].to_pylist()]).astype(np.int64))
        keys, n = keys[n > 0], n[n > 0]
        first, second = a[keys // len(b)], b[keys % len(b)]
        words, sums = _contexts(first, n)
        hot = np.flatnonzero(np.isin(words, np.concatenate([unsqueeze(x) for x in lists["spread"].to_pylist()]).astype(np.int64)))
        row = {
            "shard": lists["shard"][0].as_py(), "first": squeeze(np.diff(first, prepend=0)), "second": squeeze(second), "counts": squeeze(n), **{f"n{k}": int((n == k).sum()) for k in (1, 2, 3, 4)},
            "hot": [dict(zip(("word", "total", "n1", "n2", "n3"), (int(words[k]), *sums[k].tolist()), strict=True)) for k in hot], "chunk": lists["chunk"].to_pylist(), "firsts": firsts, "seconds": seconds,
        }
        release_memory()
        return pa.Table.from_pylist([row], schema=_SHARD_ARROW)

    return run


_ANSWERS = "chunk long, shard int, first binary, second binary"


def shard_trie(row: dict, model: Model) -> bytes:
    """The trie of a shard's row: shares of its pairs, and what its first words leave, both after the discounts."""
    first, second, n = (unsqueeze(row[c]).astype(np.int64) for c in ("first", "second", "counts"))
    first = np.cumsum(first)
    words, sums = _contexts(first, n)
    total, rest = sums[:, 0], (sums[:, 1:] @ np.array(model.pair_discounts)) / np.maximum(sums[:, 0], 1)
    hot, hot_total, hot_rest = model.hot
    if len(hot):
        at = np.minimum(np.searchsorted(hot, words), len(hot) - 1)
        whole = hot[at] == words
        total, rest = np.where(whole, hot_total[at], total), np.where(whole, hot_rest[at], rest)
    share = (n - spared(n, model.pair_discounts)) / total[np.searchsorted(words, first)]
    return Trie.build(first, second, share, words, rest)


def _groups(row: dict) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
    """A shard's lists (chunk, first, second), as many at a time as are looked up in one pass over the trie."""
    held, size = [], 0
    for chunk, first, second in zip(row["chunk"], row["firsts"], row["seconds"], strict=True):
        held.append((chunk, np.cumsum(unsqueeze(first)).astype(np.int64), unsqueeze(second).astype(np.int64)))
        size += len(held[-1][1])
        if size > PASS_PAIRS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _answer_pairs(model: Model) -> Callable[[Iterator], Iterator]:
    """Each shard's trie (chunk -1), and for each list that was asked the codes of its pairs and contexts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(part.num_rows):
                row = part.slice(k, 1).to_pylist()[0]
                buffer = shard_trie(row, model)
                trie, out = Trie(buffer), [(-1, buffer, None)]
                for lists in _groups(row):
                    first, second = (np.concatenate([x[c] for x in lists]) for c in (1, 2))
                    order = np.lexsort((second, first))
                    shares, rest = np.empty(len(order), dtype=np.uint16), np.empty(len(order), dtype=np.uint16)
                    shares[order], rest[order] = trie.find(first[order], second[order])
                    ends = np.cumsum([len(x[1]) for x in lists])
                    out += [(x[0], squeeze(shares[e - len(x[1]) : e]), squeeze(rest[e - len(x[1]) : e])) for x, e in zip(lists, ends, strict=True)]
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array([row["shard"]] * len(out), pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], names=["chunk", "shard", "first", "second"])

    return run


_SCORES = "uid long, id long, held boolean, n_tokens long, n_known long, base double, score double"


def _piece_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums over each piece's events; a piece of context alone has 0."""
    out, full = np.zeros(len(sizes)), np.flatnonzero(sizes > 1)
    if len(full):
        out[full] = np.add.reduceat(values.astype(float), np.concatenate(([0], np.cumsum(sizes[full] - 1)[:-1])))
    return out


def _score(model: Model) -> Callable[[pa.Table, pa.Table], pa.Table]:
    hot, hot_rest = model.hot[0], restore(quantise(model.hot[2]))

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in chunk.to_pylist():
            given = answers.to_pylist()
            p = _Pairs(row, [x for x in given if x["kind"] == 0], model)
            codes = sorted((x for x in given if x["kind"] == 1), key=lambda x: x["shard"])
            shares, rests = (np.concatenate([np.empty(0, np.int64), *(unsqueeze(x[c]).astype(np.int64) for x in codes)]) for c in ("first", "second"))
            if len(shares) != len(p.first):
                raise ValueError("pairs of a chunk have no answer")
            rest = np.where(rests > 0, restore(rests), 1.0)
            if len(hot):  # a piece of a spread word's pairs may hold none that was learned
                at = np.minimum(np.searchsorted(hot, p.first), len(hot) - 1)
                rest = np.where(hot[at] == p.first, hot_rest[at], rest)
            c = p.counts[p.tokens[p.events]]
            single = np.where(c > 0, (c - spared(c, model.discounts)) / max(model.tokens, 1), model.free)
            prob = single
            prob[p.asked] = restore(shares)[p.place] + rest[p.place] * single[p.asked]
            total = lambda x: _piece_sums(x, np.array(row["sizes"]))
            base = np.log10((c + 1) / (model.tokens + model.words + 1))
            out.append(pa.table([pa.array(row["uid"], pa.int64()), pa.array(row["id"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(np.array(row["sizes"]) - 1, pa.int64()), pa.array(total(c > 0).astype(np.int64)), pa.array(total(base)), pa.array(total(np.log10(prob)))], names=["uid", "id", "held", "n_tokens", "n_known", "base", "score"]))
        release_memory()
        return pa.concat_tables(out)

    return run


def _pair_model(model: Model, shards: DataFrame) -> Model:
    """The model with what all pairs tell: their discounts, and the sums of words whose pairs are spread over several shards."""
    n = shards.agg(*(F.coalesce(F.sum(f"n{k}"), F.lit(0)) for k in (1, 2, 3, 4))).first()  # four numbers
    by = discounts(*n)
    parts = shards.select(F.explode("hot").alias("x")).groupBy("x.word").agg(*(F.sum(f"x.{c}").alias(c) for c in ("total", "n1", "n2", "n3")))
    hot = sorted(parts.collect())  # at most a row for each ``hot_limit`` tokens, and MOST_HOT
    word, total, *kinds = (np.array([r[k] for r in hot], dtype=np.int64) for k in range(5))
    return replace(model, pair_discounts=by, hot=(word, total, np.column_stack(kinds) @ np.array(by) / np.maximum(total, 1)))


def score_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(scores, tries). Scores have a row per input row: ``id_col``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``
    and ``score``, base-10 logarithms; tries (shard, trie) are the model's levels, for ``lm_trie.Trie``.

    A text is its words and one end; a null or empty one is its end alone. A null id counts as the empty text and is
    learned; repeated rows count and are scored each. Without rows to learn from, all tokens are unknown, and
    have probability 1 as the only type. Words are told apart by 64-bit hashes. An empty table gives empty tables. Other
    columns are not read and may have any names. Tables made on the way are deleted; scores and tries last.
    """
    named = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = documents.select(F.col(id_col).cast("long").alias("id"), (F.crc32(named) % settings.parts == settings.held_out).alias("held"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # one number
    shards = 1 + size // SHARD_BYTES
    by_chunk = lambda df: df.groupBy("chunk")
    with scratch(documents.sparkSession):
        chunks = cut(rows.mapInArrow(trimmed(_chunk_rows(shards)), _CHUNK))
        words = chunks.select("chunk", F.explode("words").alias("w")).select("chunk", "w.shard", "w.hashes", "w.counts")
        answers = cut(words.groupBy("shard").applyInArrow(_number_words(shards), _WORD_ANSWERS))
        tokens, known, *n = answers.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "words", "n1", "n2", "n3", "n4"))).first()  # six numbers
        by = discounts(*n)
        free = (by[0] * n[0] + by[1] * n[1] + by[2] * (known - n[0] - n[1])) / tokens if tokens else 1.0
        model = Model(shards, tokens, known, by, max(HOT_TOKENS, tokens // MOST_HOT), free=free)
        numbered = answers.where("chunk >= 0").select("chunk", "shard", "first", "second")
        sequences = chunks.drop("words")
        sent = by_chunk(sequences).cogroup(by_chunk(numbered)).applyInArrow(_send_pairs(model), _LISTS)
        asked = cut(sent.groupBy("shard").applyInArrow(_merge_pairs(model), _SHARD))
        model = _pair_model(model, asked)
        coded = cut(asked.mapInArrow(trimmed(_answer_pairs(model)), _ANSWERS))
        given = numbered.withColumn("kind", F.lit(0)).unionByName(coded.where("chunk >= 0").withColumn("kind", F.lit(1)))
        scored = by_chunk(sequences).cogroup(by_chunk(given)).applyInArrow(_score(model), _SCORES)
        # a text in several pieces has its sums added up; a uid belongs to one row
        whole = scored.groupBy("uid").agg(F.max("id").alias(id_col), F.max("held").alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known")), F.lit(tokens).cast("long").alias("train_tokens"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
        scores = cut(whole.drop("uid"), lasting=True)
        return scores, cut(coded.where("chunk < 0").select("shard", F.col("first").alias("trie")), lasting=True)
