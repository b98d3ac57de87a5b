"""Media columns: signatures located by Aho-Corasick, structure and length confirmed per format.

A signature only nominates a place; a validator walks the format's chunks, segments or pages from there
and returns the length, or nothing. End marks are noted in the same pass as signatures, and a step from
one chunk, segment or page to the next is taken once for all values that pass it. What is valid at the start of a value corrects its declared type;
what is valid further in, and not inside something already found, is carved as embedded media.
"""

from __future__ import annotations

import binascii
import bisect
import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbase.llm.common import batches

UNIT = 64
RATE = 8000
UNKNOWN = "application/octet-stream"
BATCH_CHARS = 4_000_000


class Chain:
    """Places that follow from each other: ``step(place)`` is the next one, further on, or None. Each step is taken once,
    however many values pass through it; ``mark(place)`` tells something that a whole rest of a chain may hold."""

    def __init__(self, step: Callable[[int], int | None], mark: Callable[[int], bool] = lambda _: False) -> None:
        self.step, self.mark = step, mark
        self.paths: list[list[int]] = []
        self.joins: list[tuple[int, int] | None] = []  # where in an older path each one goes on
        self.at: dict[int, tuple[int, int]] = {}
        self.last: dict[int, tuple[int, bool]] = {}

    def _find(self, place: int) -> tuple[int, int]:
        if place not in self.at:
            path, here = [], place
            while here is not None and here not in self.at:
                self.at[here] = len(self.paths), len(path)
                path.append(here)
                here = self.step(here)
            self.paths.append(path)
            self.joins.append(None if here is None else self.at[here])
            end, held = self.last[here] if here is not None else (path[-1], False)
            for x in reversed(path):
                held = held or self.mark(x)
                self.last[x] = end, held
        return self.at[place]

    def end(self, place: int) -> tuple[int, bool]:
        """The last place that is reached, and whether a place from here on is marked."""
        self._find(place)
        return self.last[place]

    def nth(self, place: int, steps: int) -> int | None:
        """The place after so many steps."""
        found = self._find(place)
        while found:
            path, k = found
            if k + steps < len(self.paths[path]):
                return self.paths[path][k + steps]
            steps -= len(self.paths[path]) - k
            found = self.joins[path]
        return None

    def before(self, place: int, goal: int) -> int | None:
        """The place whose next one is ``goal``, if that is reached from ``place``."""
        found, last = self._find(place), None
        while found:
            path, k = found
            own = self.paths[path]
            i = bisect.bisect_left(own, goal, k)
            if i < len(own) and own[i] == goal:
                return own[i - 1] if i > k else last
            if i < len(own):
                return None
            last, found = own[-1], self.joins[path]
        return None


class Value:
    """A value's bytes with what the validators share, so that a value full of signatures is still read about once.

    Only gzip has no such store: each place that begins like it is inflated until it fails.
    """

    def __init__(self, data: bytes, marks: dict[bytes, list[int]]) -> None:
        self.data, self.marks = data, marks
        self.png, self.jpeg = Chain(self._png, lambda p: data[p + 4 : p + 8] == b"IHDR"), Chain(self._jpeg)
        self.gif = Chain(self._gif, lambda p: data[p : p + 1] == b"\x2c")
        self.riff, self.ogg, self.midi, self.blocks = Chain(self._riff), Chain(self._ogg), Chain(self._midi), Chain(self._block)
        self.scan_ends: dict[int, int] = {}
        self.segments: list[int] | None = None

    def next_mark(self, mark: bytes, place: int) -> int:
        """The first place of an end mark from ``place`` on, -1 if there is none."""
        have = self.marks[mark]
        k = bisect.bisect_left(have, place)
        return have[k] if k < len(have) else -1

    def _png(self, place: int) -> int | None:
        if place + 12 > len(self.data):
            return None
        size, kind = struct.unpack_from(">I4s", self.data, place)
        end = place + 12 + size
        sound = end <= len(self.data) and binascii.crc32(self.data[place + 4 : end - 4]) == struct.unpack_from(">I", self.data, end - 4)[0]
        return end if sound and kind != b"IEND" else None

    def _block(self, place: int) -> int | None:
        """A sub-block of a GIF; the chain ends on the block of no bytes."""
        size = self.data[place] if place < len(self.data) else 0
        return place + size + 1 if size else None

    def _gif(self, place: int) -> int | None:
        data = self.data
        if place >= len(data):
            return None
        if data[place] == 0x21:
            body = place + 2
        elif data[place] == 0x2C and place + 10 < len(data):
            local = data[place + 9]
            body = place + 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0)
        else:
            return None
        return self.blocks.end(body)[0] + 1

    def _jpeg(self, place: int) -> int | None:
        """The next segment; after a scan its coded data are passed, and an end mark there is noted."""
        data = self.data
        if place + 4 > len(data) or data[place] != 0xFF or not 0xC0 <= data[place + 1] <= 0xFE or data[place + 1] == 0xD9:
            return None
        after = place + 2 + struct.unpack_from(">H", data, place + 2)[0]
        if data[place + 1] != 0xDA:
            return after
        if self.segments is None:
            codes = np.frombuffer(data, dtype=np.uint8)
            self.segments = np.flatnonzero((codes[:-1] == 0xFF) & (codes[1:] != 0) & ((codes[1:] < 0xD0) | (codes[1:] > 0xD7))).tolist()
        k = bisect.bisect_left(self.segments, after)
        if k == len(self.segments):
            return None
        at = self.segments[k]
        if data[at + 1] == 0xD9:
            self.scan_ends[place] = at + 2
            return None
        return at

    def _riff(self, place: int) -> int | None:
        if place + 8 > len(self.data):
            return None
        own = struct.unpack_from("<I", self.data, place + 4)[0]
        return place + 8 + own + (own & 1)

    def _ogg(self, place: int) -> int | None:
        """The next page; the chain ends on a page that is the last of its stream, or is none."""
        return None if self._is_page(place) and self.data[place + 5] & 4 else self.page_end(place)

    def _is_page(self, place: int) -> bool:
        return self.data[place : place + 5] == b"OggS\0" and place + 27 <= len(self.data)

    def page_end(self, place: int) -> int | None:
        if not self._is_page(place):
            return None
        table = self.data[place + 27 : place + 27 + self.data[place + 26]]
        return place + 27 + len(table) + sum(table)

    def _midi(self, place: int) -> int | None:
        if self.data[place : place + 4] != b"MTrk" or place + 8 > len(self.data):
            return None
        return place + 8 + struct.unpack_from(">I", self.data, place + 4)[0]


def _png(value: Value, at: int) -> int | None:
    second = value.png.nth(at + 8, 1) if value.data[at + 12 : at + 16] == b"IHDR" else None
    if second is None:
        return None
    end, again = value.png.end(second)
    # an IEND chunk is never followed, so it is tested here: it is empty, and its check sum always the same
    return end + 12 - at if not again and value.data[end : end + 12] == b"\0\0\0\0IEND\xae\x42\x60\x82" else None


def _gif(value: Value, at: int) -> int | None:
    data = value.data
    if at + 13 > len(data):
        return None
    flags = data[at + 10]
    end, framed = value.gif.end(at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0))
    return end + 1 - at if framed and end < len(data) and data[end] == 0x3B else None


def _jpeg(value: Value, at: int) -> int | None:
    end = value.scan_ends.get(value.jpeg.end(at + 2)[0])
    return end - at if end else None


def _riff(value: Value, at: int) -> int | None:
    data = value.data
    if at + 12 > len(data):
        return None
    size, form = struct.unpack_from("<I4s", data, at + 4)
    end = at + 8 + size
    if end > len(data) or form not in RIFF_TYPES or end <= at + 12:
        return None
    last = [value.riff.before(at + 12, x) for x in (end, end + 1)]
    return end - at if any(x is not None and x + 8 <= end for x in last) else None


def _bmp(value: Value, at: int) -> int | None:
    if at + 30 > len(value.data):
        return None
    size, zero, offset, head, _, _, planes, bits = struct.unpack_from("<IIIIiiHH", value.data, at + 2)
    sound = not zero and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and head in (40, 52, 56, 108, 124) and 14 + head <= offset <= size
    return size if sound and at + size <= len(value.data) else None


def _gzip(value: Value, at: int) -> int | None:
    data, reader, place = value.data, zlib.decompressobj(31), at
    try:
        while not reader.eof and place < len(data):
            reader.decompress(reader.unconsumed_tail or data[place : place + 65536], 1 << 20)
            place += 0 if reader.unconsumed_tail else 65536
    except zlib.error:
        return None
    return min(place, len(data)) - len(reader.unused_data) - at if reader.eof else None


def _pdf(value: Value, at: int) -> int | None:
    end = value.next_mark(b"%%EOF", at)
    table = value.next_mark(b"startxref", at)
    return end + 5 - at if value.data[at + 5 : at + 6].isdigit() and 0 <= table < end else None


def _zip(value: Value, at: int) -> int | None:
    data, end = value.data, value.next_mark(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(data):
        return None
    size, offset, note = struct.unpack_from("<IIH", data, end + 12)
    sound = at + offset + size == end and data[at + offset : at + offset + 4] == b"PK\x01\x02" and end + 22 + note <= len(data)
    return end + 22 + note - at if sound else None


def _ogg(value: Value, at: int) -> int | None:
    end = value.page_end(last := value.ogg.end(at)[0])
    return end - at if end is not None and value.data[last + 5] & 4 and end <= len(value.data) else None


def _midi(value: Value, at: int) -> int | None:
    data = value.data
    if at + 14 > len(data) or data[at + 4 : at + 8] != b"\0\0\0\6":
        return None
    tracks = struct.unpack_from(">H", data, at + 10)[0]
    end = value.midi.nth(at + 14, tracks) if tracks else None
    return end - at if end is not None and end <= len(data) else None


# The formats' magic bytes, end marks and media types.
SIGNATURES: tuple[tuple[bytes, str, Callable[[Value, int], int | None]], ...] = (
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"RIFF", "", _riff),
    (b"BM", "image/bmp", _bmp),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"%PDF-", "application/pdf", _pdf),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"OggS", "audio/ogg", _ogg),
    (b"MThd", "audio/midi", _midi),
)
END_MARKS = (b"%%EOF", b"startxref", b"PK\x05\x06")
RIFF_TYPES = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}


def automaton() -> ahocorasick.Automaton:
    """All signatures and end marks in one machine; bytes stand as Latin-1 characters."""
    out = ahocorasick.Automaton()
    for k, magic in enumerate([*(m for m, _, _ in SIGNATURES), *END_MARKS]):
        out.add_word(magic.decode("latin-1"), k)
    out.make_automaton()
    return out


def sniff(data: bytes, machine: ahocorasick.Automaton, after: int = 0) -> list[tuple[str, int, int]]:
    """(type, start, length) of every valid media value that starts at ``after`` or later, in order; none overlaps another."""
    places, marks = [], {m: [] for m in END_MARKS}
    for last, k in machine.iter(data.decode("latin-1")):
        if k < len(SIGNATURES):
            places.append((last - len(SIGNATURES[k][0]) + 1, k))
        else:
            mark = END_MARKS[k - len(SIGNATURES)]
            marks[mark].append(last - len(mark) + 1)
    value, found, free = Value(data, marks), [], after
    for at, k in places:
        _, kind, valid = SIGNATURES[k]
        if at >= free and (size := valid(value, at)):
            found.append((kind or RIFF_TYPES[data[at + 8 : at + 12]], at, size))
            free = at + size
    return found


def wav(payload: bytes) -> bytes:
    """The payload as 8-bit samples of one channel."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def wav_samples(data: bytes) -> tuple[int, int]:
    """Where the samples of a valid WAV value begin, and how many bytes they are."""
    place = 12
    while True:
        kind, size = struct.unpack_from("<4sI", data, place)
        if kind == b"data":
            return place + 8, size
        place += 8 + size + (size & 1)


def _store(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        texts = part["text"].to_pylist()
        for s in batches(texts, BATCH_CHARS):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts[s]]
            media = [wav(r + bytes(max(UNIT, -(-len(r) // UNIT) * UNIT) - len(r))) for r in raw]
            own = part["id"].slice(s.start, s.stop - s.start)
            yield pa.RecordBatch.from_arrays([own, pa.array([len(r) for r in raw], pa.int64()), pa.array([UNKNOWN] * len(raw)), pa.array(media, pa.binary())], names=["id", "n_bytes", "declared", "media"])


def store_texts(documents: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write every text, as UTF-8 filled up with zero bytes to a positive multiple of 64, as a WAV value: (id, n_bytes, declared, media).

    A null or empty text is 64 zero bytes; null ids and repeated rows are stored as they are; other columns
    are ignored; an empty table writes an empty one. The declared type says nothing, for the reader to correct.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows.mapInArrow(_store, "id long, n_bytes long, declared string, media binary").write.mode("overwrite").option("compression", "zstd").parquet(folder)


def _inspect(keep: list[str]):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for part in parts:
            kinds, sizes, embedded = [], [], []
            for value in part["media"]:
                data = value.as_py() or b""
                # the first value is the column's own; what lies in its body is looked for with its head left out
                found = sniff(data, machine)
                own = found[0] if found and found[0][1] == 0 else None
                inner = sniff(data, machine, 1) if own else found
                kinds.append(own[0] if own else None)
                sizes.append(own[2] if own else None)
                embedded.append([{"type": t, "start": a, "length": n} for t, a, n in inner])
            kind = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), pa.array(kinds, pa.string()), pa.array(sizes, pa.int64()), pa.array(embedded, kind)], names=[*keep, "detected", "valid_bytes", "embedded"])

    return run


def correct_types(media: DataFrame, media_col: str = "media", declared_col: str = "declared") -> DataFrame:
    """The input columns and ``detected`` (type of the whole value, null if none is valid), ``valid_bytes``, ``embedded`` (type,
    start, length) and ``corrected`` (detected, else declared, type).

    A null or empty value has nothing to detect. Names used here replace columns of the same name.
    """
    keep = [c for c in media.columns if c not in ("detected", "valid_bytes", "embedded", "corrected")]
    held = media.select(F.struct(*keep).alias("row"), F.col(media_col).alias("media"))
    out = held.mapInArrow(_inspect(["row"]), f"row {dict(held.dtypes)['row']}, detected string, valid_bytes long, embedded array<struct<type:string,start:long,length:long>>")
    return out.select("row.*", "detected", "valid_bytes", "embedded", F.coalesce("detected", F.col("row")[declared_col]).alias("corrected"))


def _read_back(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    machine = automaton()
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "declared", "corrected"]
    for part in parts:
        out = []
        for key, size, declared, value in zip(*(part[c].to_pylist() for c in ("id", "n_bytes", "declared")), part["media"], strict=True):
            data = value.as_py()
            found = sniff(data, machine)
            if not found or found[0] != ("audio/wav", 0, len(data)):
                raise ValueError(f"the stored media of {key} are not valid")
            at, count = wav_samples(data)
            body = data[at : at + count]
            inner = sniff(body, machine)
            feature = f"audio/wav {RATE} Hz, {count} samples, mean {sum(body) // count}, embedded: {' '.join(f'{t}@{a}+{n}' for t, a, n in inner) or 'none'}"
            out.append((key, size, count, hashlib.sha256(body).hexdigest(), zlib.crc32(body[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature, declared, found[0][0]))
        kinds = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2 + [pa.string()] * 4
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)


def read_features(stored: DataFrame) -> DataFrame:
    """One row per stored text: id, sizes and digests of the samples carved from the media and of the media, a feature of the
    samples, and the declared type with the one that the bytes have.

    Rows of equal texts have equal values; null ids and repeated rows pass through; an empty table gives an
    empty table. Stored bytes that are no valid media of this kind are an error.
    """
    kinds = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, declared string, corrected string"
    return stored.select("id", "n_bytes", "declared", "media").mapInArrow(_read_back, kinds)
