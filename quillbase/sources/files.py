"""Files at exact paths: a sink for pages and images, each row a file, and a source that opens the files of given paths.

Tasks write every file under a name of their own, move it to its place in a new folder, and report it; when all
have, that folder takes the old one's place by one rename. Files of failed or repeated task attempts stay under
their own names or are replaced; if anything fails, the old folder is as it was and what was new is deleted.
No step lists files: what there is to read is known by the paths that were written.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbase.operators.stored import Scratch


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it: a local (shared) path, or an address that Arrow knows, such as s3:// or hdfs://."""
    store, path = fs.FileSystem.from_uri(folder)
    return store, path.rstrip("/")


#: Contents of files that leave a task in one batch.
BATCH_BYTES = 16_000_000


def _place(store: fs.FileSystem, staged: str, target: str) -> None:
    """Move a file to its place. An attempt that is repeated replaces what the first one put there, also in a store whose moves don't."""
    try:
        store.move(staged, target)
    except OSError:
        if store.get_file_info(target).type != fs.FileType.File:
            raise
        store.delete_file(target)
        store.move(staged, target)


def _put(folder: str, staging: str) -> Callable[[Iterator], Iterator]:
    """Write rows (path, data, sound) under ``folder`` and report (path, sound); a path that isn't sound is only reported."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (store, base), (_, aside) = _store(folder), _store(staging)
        staged, made = f"{aside}/{uuid.uuid4().hex}", base
        store.create_dir(aside, recursive=True)
        for part in parts:
            for path, data, sound in zip(part["path"].to_pylist(), part["data"], part["sound"].to_pylist(), strict=True):
                if sound:
                    with store.open_output_stream(staged) as out:
                        out.write(data.as_buffer())
                    target = f"{base}/{path}"
                    if (parent := target.rpartition("/")[0]) != made:
                        store.create_dir(parent, recursive=True)
                        made = parent
                    _place(store, staged, target)
            yield part.select(["path", "sound"])

    return run


def _missing(folder: str) -> Callable[[Iterator], Iterator]:
    """The rows whose path is no file under ``folder``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        for part in parts:
            there = store.get_file_info([f"{base}/{path}" if sound else base for path, sound in zip(part["path"].to_pylist(), part["sound"].to_pylist(), strict=True)])
            yield part.filter(pa.array([x.type != fs.FileType.File for x in there], pa.bool_()))

    return run


def _move(source: str, folder: str) -> Callable[[Iterator], Iterator]:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (_, aside), (store, base) = _store(source), _store(folder)
        for part in parts:
            for path in part["path"].to_pylist():
                staged, target = f"{aside}/{path}", f"{base}/{path}"
                store.create_dir(target.rpartition("/")[0], recursive=True)
                # an attempt that is repeated finds what the first one moved
                if store.get_file_info(staged).type != fs.FileType.NotFound:
                    store.move(staged, target)
                elif store.get_file_info(target).type == fs.FileType.NotFound:
                    raise FileNotFoundError(target)
            yield part.select(["path"])

    return run


def _contents(folder: str) -> Callable[[Iterator], Iterator]:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        batch = lambda paths, data: pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(data, pa.binary())], names=["path", "data"])
        for part in parts:
            paths, data, held = [], [], 0
            for path in part["path"].to_pylist():
                with store.open_input_stream(f"{base}/{path}") as file:
                    data.append(file.read())
                paths.append(path)
                held += len(data[-1])
                if held >= BATCH_BYTES:
                    yield batch(paths, data)
                    paths, data, held = [], [], 0
            yield batch(paths, data)

    return run


def read_files(paths: DataFrame, folder: str) -> DataFrame:
    """(path, data): what each ``path`` of ``paths`` under ``folder`` holds, opened by tasks; a file that isn't there is an error."""
    return paths.select("path").mapInArrow(_contents(folder), "path string, data binary")


def put_files(files: DataFrame, folder: str, add: bool = False, last: bool = True) -> tuple[DataFrame, int]:
    """``write_files`` that also gives the table (path) of the files written, for ``read_files``. It stays in the checkpoint folder if it is to ``last``."""
    spark = files.sparkSession
    sound = F.col("path").isNotNull() & (F.col("path") != "") & ~F.col("path").rlike(r"^/|/$|(^|/)\.\.?(/|$)|//")
    rows = files.where("data IS NOT NULL").select("path", F.col("data").cast("binary").alias("data"), F.coalesce(sound, F.lit(False)).alias("sound"))
    store, base = _store(folder)
    mark = uuid.uuid4().hex
    staging, fresh, old = (f"{base}.{x}-{mark}" for x in ("staged", "new", "old"))
    address = lambda path: folder.rstrip("/")[: len(folder.rstrip("/")) - len(base)] + path
    with Scratch(spark) as scratch:
        try:
            if add:
                rows = rows.mapInArrow(_missing(folder), rows.schema)
            store.create_dir(fresh, recursive=True)
            told = scratch.keep(rows.mapInArrow(_put(address(fresh), address(staging)), "path string, sound boolean"), last)
            wrong = told.where("NOT sound").first()
            again = told.groupBy("path").count().where("count > 1").first()
            if wrong or again:
                raise ValueError(f"not a path of a file: {wrong.path!r}" if wrong else f"two files at one path: {again.path!r}")
            paths = told.select("path")
            if add:
                store.create_dir(base, recursive=True)
                return paths, scratch.keep(paths.mapInArrow(_move(address(fresh), folder), "path string")).count()
            had = store.get_file_info(base).type != fs.FileType.NotFound
            if had:
                store.move(base, old)
            try:
                store.move(fresh, base)
            except Exception:
                if had:
                    store.move(old, base)
                raise
            return paths, paths.count()
        except Exception:
            scratch.drop(scratch.lasting)
            raise
        finally:
            for path in (staging, fresh, old):
                if store.get_file_info(path).type == fs.FileType.Directory:
                    store.delete_dir(path)


def write_files(files: DataFrame, folder: str, add: bool = False) -> int:
    """Write each row of ``files`` (path, data) to exactly that path under ``folder``; the number of files written.

    ``folder`` gets the files and nothing else, by one rename at the end; with ``add`` it keeps what it has, and only
    paths that aren't there are written (file by file). ``data`` may be text or binary; a row without data is left out, and an empty one is
    an empty file. Paths that are null, absolute, or lead outside, and two rows with one path, are errors, and nothing is changed.
    """
    return put_files(files, folder, add, last=False)[1]


# Tasks get these functions by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
