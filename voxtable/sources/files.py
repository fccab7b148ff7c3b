"""Files of volumes: small texts by the driver, ranges and fresh copies by the tasks of data sources."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSourceArrowWriter, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual, WriterCommitMessage


def register(spark: SparkSession, source: type) -> str:
    """Makes a data source known to the session, with filters pushed into it; returns its name."""
    spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return source.name()


def _place(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(conf), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _place(spark, path)
    return fs.exists(place)


def small_file(spark: SparkSession, path: str) -> str | None:
    """The text of a metadata file, None if there is none; Spark's readers skip names that begin with a dot."""
    fs, place = _place(spark, path)
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def local_path(path: str) -> str | None:
    """The path as the operating system's, None if it is on another file system."""
    bare = path.removeprefix("file://")
    return None if "://" in bare else bare.rstrip("/")


def file_store(path: str):
    """(Arrow file system, path in it), for drivers and tasks alike: local and shared folders, and the stores that Arrow knows by their scheme."""
    from pyarrow import fs

    local = local_path(path)
    return (fs.LocalFileSystem(), local) if local is not None else fs.FileSystem.from_uri(path.rstrip("/").replace("s3a://", "s3://", 1))


def read_whole(store, path: str) -> bytes | None:
    """The content of a file, None if there is none."""
    try:
        with store.open_input_stream(path) as f:
            return f.read()
    except FileNotFoundError:
        return None


def drop(store, path: str) -> None:
    """Deletes a file or folder, if it is there."""
    from pyarrow.fs import FileType

    kind = store.get_file_info(path).type
    if kind == FileType.Directory:
        store.delete_dir(path)
    elif kind == FileType.File:
        store.delete_file(path)


def narrowed(ranges: dict[str, tuple[int, int]], filters: Iterable[Filter]) -> dict[str, tuple[int, int]]:
    """``ranges`` ({column: (first, end)}) cut down to what ``filters`` on these columns leave; others change nothing."""
    out = dict(ranges)
    for f in filters:
        name = f.attribute[0] if getattr(f, "attribute", ()) else None
        if name not in out or len(f.attribute) > 1:
            continue
        first, end = out[name]
        if isinstance(f, (EqualTo, EqualNullSafe)) and f.value is not None:
            first, end = max(first, f.value), min(end, f.value + 1)
        elif isinstance(f, In) and (some := [v for v in f.value if v is not None]):
            first, end = max(first, min(some)), min(end, max(some) + 1)
        elif isinstance(f, GreaterThanOrEqual):
            first = max(first, f.value)
        elif isinstance(f, GreaterThan):
            first = max(first, f.value + 1)
        elif isinstance(f, LessThan):
            end = min(end, f.value)
        elif isinstance(f, LessThanOrEqual):
            end = min(end, f.value + 1)
        out[name] = (first, max(first, end))
    return out


@dataclass
class Written(WriterCommitMessage):
    """What a task has put into the fresh copy."""

    files: int


class FreshCopy(DataSourceArrowWriter):
    """Tasks write a copy beside ``path``; the commit puts it in the place of what was there, an abort drops it and leaves the old one whole.

    A task writes each file under a name of its own and moves it, so that a task
    that runs twice leaves one whole file.
    """

    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.fresh = f"{self.path}.{uuid.uuid4().hex}"

    def put(self, store, base: str, name: str, content: bytes) -> None:
        store.create_dir(base, recursive=True)
        part = f"{base}/_part-{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            out.write(content)
        store.move(part, f"{base}/{name}")

    def finish(self, store, base: str) -> None:
        """What is still to be written once all tasks are done."""
        store.create_dir(base, recursive=True)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow.fs import FileType

        store, path = file_store(self.path)
        _, fresh = file_store(self.fresh)
        self.finish(store, fresh)
        old = f"{fresh}.old"
        there = store.get_file_info(path).type != FileType.NotFound
        if there:
            store.move(path, old)
        try:
            store.move(fresh, path)
        except OSError:
            if there:
                store.move(old, path)
            raise
        drop(store, old)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        drop(*file_store(self.fresh))
