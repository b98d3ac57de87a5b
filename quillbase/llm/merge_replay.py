"""Byte-level BPE by replaying merges over a batch's distinct pieces.

All pieces lie end to end in one array of symbols. An inverted index gives, for each rank, the places
where a pair of that rank begins; ranks are replayed in order, every place of a rank at once, and only
the two pairs that a merge touches get a new entry. A pair whose rank is below the one at hand, which
a merge can make, is replayed before the later places of its piece, so each piece sees its pairs in
exactly the order of their ranks, leftmost first. A piece of a million bytes takes about a second.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbase.llm.chunks import _PLAIN, Chunked, gather, text_slices

BATCH_BYTES = 17_000_000


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by rank, of a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * (max(int(r) for _, r in pairs) + 1)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Merges:
    """Which pairs of tokens make which token."""

    def __init__(self, tokens: list[bytes]) -> None:
        rank = {t: r for r, t in enumerate(tokens) if t}
        self.tokens = tokens
        self.single = np.array([rank[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for r, t in enumerate(tokens):
            for k in range(1, len(t)):
                a, b = rank.get(t[:k]), rank.get(t[k:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = r
        keys = np.fromiter(pairs, dtype=np.int64, count=len(pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))[order], -1)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it makes no token."""
        keys = (left << 32) | right
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.ranks[at], -1)

    def _together(self, places: np.ndarray, r: int, symbol: np.ndarray, after: np.ndarray, before: np.ndarray, piece: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of all places of rank ``r``, in order: those that merge at once, and those that must wait.

        From the left, a merge takes away the place that overlaps it, so of a run of places that overlap every second one merges. The merges
        of one rank don't meddle with each other, unless one makes a pair of a lower rank, which comes first: a piece's
        places behind the first such merge wait.
        """
        gone = after[places]
        follows = np.append(False, gone[:-1] == places[1:])
        order = np.arange(len(places))
        in_run = order - np.maximum.accumulate(np.where(follows, 0, order))
        places, gone = places[in_run % 2 == 0], gone[in_run % 2 == 0]
        left, right = symbol[before[places]], symbol[after[gone]]
        joined = np.append(False, after[gone[:-1]] == places[1:])  # the left neighbour has merged just before
        left = np.where(joined, r, left)
        made = np.stack([self.of(left, np.full(len(places), r)), self.of(np.full(len(places), r), right)])
        made[0][before[places] >= n] = made[1][after[gone] >= n] = -1
        lower = ((made >= 0) & (made < r)).any(axis=0)
        if not lower.any():
            return places, places[:0]
        owner = piece[places]
        earlier = np.cumsum(lower) - lower  # merges before this one, of any piece, that make a lower pair
        begin = np.searchsorted(owner, owner, side="left")
        late = earlier > earlier[begin]
        return places[~late], places[late]

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and where each piece's begin."""
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        n = int(sizes.sum())
        symbol = self.single[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        piece = np.repeat(np.arange(len(pieces)), sizes)
        # a place before and one after stand for "no neighbour": rank -1 whatever is asked
        after = np.append(np.arange(1, n + 1), n)
        before = np.append(np.arange(-1, n - 1), n)
        ends = np.cumsum(sizes)[sizes > 0]
        after[ends - 1] = n
        before[ends[:-1]] = n
        if n:
            before[0] = n
        symbol = np.append(symbol, -1)
        pair = np.full(n + 1, -1, dtype=np.int64)
        start = np.flatnonzero(after[:n] < n)
        pair[start] = self.of(symbol[start], symbol[start + 1])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(places: np.ndarray) -> None:
            places = places[pair[places] >= 0]
            if not len(places):
                return
            ranks = pair[places]
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            begin = 0
            for r, end in zip(ranks[np.append(0, cuts)].tolist(), [*cuts.tolist(), len(places)], strict=True):
                have = index.get(r)
                if have is None:
                    index[r] = [places[begin:end]]
                    heapq.heappush(heap, r)
                else:
                    have.append(places[begin:end])
                begin = end

        enter(start)
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            places = lists[0] if len(lists) == 1 else np.concatenate(lists)
            places = places[pair[places] == r]
            if len(places) > 1:
                places = np.unique(places)
                places, wait = self._together(places, r, symbol, after, before, piece, n)
                if len(wait):
                    index[r] = [wait]
                    heapq.heappush(heap, r)
            if not len(places):
                continue
            gone = after[places]
            far = after[gone]
            symbol[places] = r
            symbol[gone] = -1
            pair[gone] = -1
            after[places] = far
            before[far] = places
            before[n] = n
            near = before[places]
            pair[places] = np.where(far < n, self.of(symbol[places], symbol[far]), -1)
            held = near < n
            pair[near[held]] = self.of(symbol[near[held]], symbol[places[held]])
            enter(np.concatenate([places, near[held]]))
        alive = symbol[:n] >= 0
        counts = np.bincount(piece[alive], minlength=len(pieces))
        return symbol[:n][alive], np.concatenate(([0], np.cumsum(counts))).astype(np.int64)


def chunk_ids(chunks: list[str], merges: Merges, pattern: regex.Pattern) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each chunk, each match of the pattern encoded separately."""
    known: dict[str, int] = {}
    numbers, counts = [], []
    for chunk, m in zip(chunks, map(_PLAIN.fullmatch, chunks), strict=True):
        pieces = [p for p in m.groups() if p] if m else pattern.findall(chunk)
        numbers += [known.setdefault(p, len(known)) for p in pieces]
        counts.append(len(pieces))
    ids, starts = merges.replay([p.encode("utf-8", "surrogatepass") for p in known])
    flat, lengths = gather(ids, starts, np.array(numbers, dtype=np.int64))
    upto = np.concatenate(([0], np.cumsum(lengths)))
    return flat, upto[np.concatenate(([0], np.cumsum(np.array(counts, dtype=np.int64))))]


def decode_bytes(ids: np.ndarray, tokens: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The bytes of all ids, joined, and where each id's begin."""
    starts = np.concatenate(([0], np.cumsum([len(t) for t in tokens]))).astype(np.int64)
    data, lengths = gather(np.frombuffer(b"".join(tokens), dtype=np.uint8), starts, ids)
    return data.tobytes(), np.concatenate(([0], np.cumsum(lengths)))


def _rows(rank_file: str, pattern: str, with_ids: bool):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, compiled = Merges(load_ranks(rank_file)), regex.compile(pattern)
        for part in parts:
            for s in text_slices(part["text"], BATCH_BYTES):
                chunked = Chunked(part["text"].slice(s.start, s.stop - s.start))
                flat, starts = chunk_ids(chunked.chunks, merges, compiled)
                ids, lengths = gather(flat, starts, chunked.numbers)
                upto = np.concatenate(([0], np.cumsum(lengths)))[chunked.offsets]
                data, places = decode_bytes(ids, merges.tokens)
                view, ends = memoryview(data), places[upto].tolist()
                decoded = [view[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                columns = [part["id"].slice(s.start, s.stop - s.start), pa.array(np.diff(upto))]
                if with_ids:
                    columns += [pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(ids.astype(np.int32))), pa.array([bytes(d) for d in decoded], pa.binary())]
                else:
                    said = flat.tolist()
                    cuts = starts.tolist()
                    words = [",".join(map(str, said[a:b])) + "," for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                    words = [w if len(w) > 1 else "" for w in words]
                    rows = chunked.offsets.tolist()
                    joined = ("".join(map(words.__getitem__, chunked.numbers[a:b].tolist()))[:-1] for a, b in zip(rows[:-1], rows[1:], strict=True))
                    columns += [pa.array([hashlib.sha256(j.encode()).hexdigest() for j in joined]), pa.array([hashlib.sha256(d).hexdigest() for d in decoded])]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", *(("ids", "decoded") if with_ids else ("ids_sha256", "decoded_sha256"))])

    return run


def encode_decode(documents: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per input row: ``id_col``, ``n_tokens`` and ``ids`` with the ``decoded`` bytes, or, unless ``with_ids``, digests
    of both (``ids_sha256`` over decimal ids joined by commas, ``decoded_sha256``).

    A null text counts as empty: no ids, no bytes. Null ids and repeated rows pass through; other columns
    are ignored; an empty table gives an empty table. ``rank_file`` must be at the same path on every executor.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    kinds = "ids array<int>, decoded binary" if with_ids else "ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(_rows(rank_file, pattern, with_ids), f"id long, n_tokens long, {kinds}").withColumnRenamed("id", id_col)
