"""What several operators share: checkpoints, word hashing on whole batches, chunk dictionaries."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from quillbase.session import checkpoint_folder

#: Characters that separate words, as a class of Java's and Python's regular expressions.
SPACE_CLASS = r"\x20\x09-\x0D"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any file system that Spark can write to; one that isn't there is no error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``cut`` writes inside the block are deleted when it ends; what is to last is cut with ``lasting``."""
    folder = f"{checkpoint_folder(spark)}/scratch-{uuid.uuid4().hex}"
    token = _SCRATCH.set(folder)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        remove_folder(spark, folder)


def cut(df: DataFrame, lasting: bool = False) -> DataFrame:
    """The same rows with lineage cut at a table in the shared folder, so that a lost executor costs no recomputation.

    Its reader makes as many tasks as the table's size needs, whatever the number of shuffle partitions
    that wrote it.
    """
    spark = df.sparkSession
    path = f"{(None if lasting else _SCRATCH.get()) or checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_enough_to_broadcast(rows: int, bytes_per_row: int, limit_mb: int = 64) -> bool:
    """Whether ``rows`` counted rows may be broadcast; the caller joins by shuffle beyond that."""
    return rows * bytes_per_row <= limit_mb * 1_000_000


def release_memory() -> None:
    """Give a task's freed memory back to the system, as its Python worker lives on beside the next task's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same task function, which gives memory back when it ends."""

    def wrapped(parts: Iterator) -> Iterator:
        try:
            yield from run(parts)
        finally:
            release_memory()

    return wrapped


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply rounds): every input bit reaches every output bit."""
    x = x.copy()
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


#: Bytes of text whose prefix sums are held at once: some 40 bytes of working memory for each.
PIECE_BYTES = 1 << 20


@dataclass
class Words:
    """The words of a batch of texts: a 64-bit hash each, and where each text's words begin."""

    hashes: np.ndarray
    #: Text ``i`` has the words ``offsets[i]:offsets[i + 1]``.
    offsets: np.ndarray
    #: Byte places of each word in ``data``.
    starts: np.ndarray
    ends: np.ndarray
    data: bytes


def words_of(texts: Sequence[str | None], lower_ascii: bool = False) -> Words:
    """Words are maximal runs without the characters 0x20 and 0x09-0x0D; a null text has none.

    Bytes are summed with powers of an odd base modulo 2^64, so a word's hash is a difference of two prefix
    sums times the inverse power of its place. Sums run over pieces of about ``PIECE_BYTES``, which end between words.
    """
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    data = b" ".join(raw) + b" "
    text_starts = np.cumsum([0, *(len(r) + 1 for r in raw)])
    del raw
    codes = np.frombuffer(data, dtype=np.uint8)
    is_space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    edge = np.diff(is_space.view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    del is_space, edge
    hashes = np.empty(len(starts), dtype=np.uint64)
    a = 0
    powers = inverse = np.empty(0, dtype=np.uint64)
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + PIECE_BYTES, side="right")))
        first, n = starts[a], int(ends[b - 1] - starts[a])
        if n > len(powers):
            powers, inverse = _powers(_BASE, n), _powers(_BASE_INVERSE, n)
        piece = codes[first : first + n]
        if lower_ascii:
            piece = np.where((piece >= 65) & (piece <= 90), piece + 32, piece).astype(np.uint8)
        prefix = np.zeros(n + 1, dtype=np.uint64)
        np.multiply(_BYTE_CODES[piece], powers[:n], out=prefix[1:])
        np.cumsum(prefix, out=prefix)
        s, e = starts[a:b] - first, ends[a:b] - first
        hashes[a:b] = mix64((prefix[e] - prefix[s]) * inverse[s] + (e - s).astype(np.uint64))
        a = b
    return Words(hashes, np.searchsorted(starts, text_starts), starts, ends, data)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` consecutive words, in order; entry ``i`` starts at word ``i``."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        out *= np.uint64(0x9FB21C651E98DF25)
        out += hashes[k : k + m]
    return mix64(out)


def slabs(most_bytes: int, *columns: pa.Array) -> Iterator[slice]:
    """Slices of rows whose texts or bytes in ``columns`` come to ``most_bytes`` at most; one longer row is a slice of its own."""
    lengths = [pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]
    ends = np.cumsum(sum(lengths))
    begin = 0
    while begin < len(ends):
        before = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
        yield slice(begin, stop)
        begin = stop


def batches(texts: Sequence[str | None], most_chars: int):
    """Slices of ``texts`` of about ``most_chars`` characters at most; one longer text is a slice of its own."""
    begin = size = 0
    for i, t in enumerate(texts):
        own = len(t) if t is not None else 0
        if i > begin and size + own > most_chars:
            yield slice(begin, i)
            begin, size = i, 0
        size += own
    if begin < len(texts):
        yield slice(begin, len(texts))
