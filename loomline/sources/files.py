"""An inventory of files with digests, as a data source that sees every file: empty ones, and ones too large for a row."""

from __future__ import annotations

import hashlib
import io
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomline.operators.checks import CheckFailed

CHUNK, LINES = 1 << 22, 1 << 13
SCHEMA = "name string, length long, sha256 string"


def listed(path: str, pattern: str) -> list[tuple[str, int]]:
    """(name in the folder, length) of all files below it whose own name fits, in order."""
    store, root = fs.FileSystem.from_uri(path)
    found = store.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted((f.path[len(root.rstrip("/")) + 1 :], f.size) for f in found if f.is_file and fnmatch(f.base_name, pattern))


@dataclass
class Files(InputPartition):
    names: tuple[str, ...]


class DigestReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.path, self.pattern, self.limit = options["path"], options.get("pattern", "*"), int(options.get("bytes", 1 << 27))

    def partitions(self) -> list[Files]:
        """Files side by side up to a number of bytes; a larger file is a partition of its own."""
        out, names, size = [], [], 0
        for name, length in listed(self.path, self.pattern):
            if names and size + length > self.limit:
                out.append(Files(tuple(names)))
                names, size = [], 0
            names.append(name)
            size += length
        return [*out, Files(tuple(names))]

    def read(self, partition: Files) -> Iterator[tuple[str, int, str]]:
        store, root = fs.FileSystem.from_uri(self.path)
        for name in partition.names:
            digest, length = hashlib.sha256(), 0
            with store.open_input_stream(f"{root.rstrip('/')}/{name}") as stream:
                while chunk := stream.read(CHUNK):
                    digest.update(chunk)
                    length += len(chunk)
            yield name, length, digest.hexdigest()


class FileDigests(DataSource):
    """Options: path (of any store that Arrow knows by its address), pattern of file names, bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DigestReader:
        return DigestReader(self.options)


class LineReader(DigestReader):
    """(file, value) of all lines that aren't empty; files are opened as their names say, so compressed ones are read too."""

    def partitions(self) -> list[Files]:
        """At most `files` small files side by side; ones above `bytes` and names that begin with _ or a dot are left to Spark, or out."""
        names, each = small(listed(self.path, self.pattern), self.limit), int(self.options["files"])
        return [Files(tuple(names[k : k + each])) for k in range(0, len(names), each)] or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(self.path)
        file, value = [], []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(file, pa.string()), pa.array(value, pa.string())], names=["file", "value"])
        for name in partition.names:
            place = f"{root.rstrip('/')}/{name}"
            with io.TextIOWrapper(store.open_input_stream(place), encoding="utf-8", errors="replace") as lines:
                for line in lines:
                    if line.strip():
                        file.append(place)
                        value.append(line.rstrip("\n"))
                    if len(value) >= LINES:
                        yield batch()
                        file, value = [], []
        yield batch()


class FileLines(FileDigests):
    @classmethod
    def name(cls) -> str:
        return "file_lines"

    def schema(self) -> str:
        return "file string, value string"

    def reader(self, schema) -> LineReader:
        return LineReader(self.options)


def small(found: list[tuple[str, int]], limit: int) -> list[str]:
    return [name for name, length in found if 0 < length <= limit and not any(part[0] in "_." for part in name.split("/"))]


def file_lines(spark: SparkSession, path: str, pattern: str = "*", files: int = 2000, limit: int = 1 << 27) -> tuple[DataFrame, list[str]]:
    """(file, value) of the lines of all files below a folder up to `limit` bytes each, many to a task; and the larger files, which Spark reads in splits.

    Spark's own sources plan, list and open each file by itself, which costs milliseconds of the driver a file.
    """
    spark.dataSource.register(FileLines)
    lines = spark.read.format("file_lines").options(path=path, pattern=pattern, bytes=str(limit), files=str(files)).load()
    store, root = fs.FileSystem.from_uri(path)
    full = "" if isinstance(store, fs.LocalFileSystem) else path[: len(path.rstrip("/")) - len(root.rstrip("/"))]
    found = [(name, length) for name, length in listed(path, pattern) if length > limit]
    return lines, [f"{full}{root.rstrip('/')}/{name}" for name in small(found, 1 << 62)]


def write_lines(df: DataFrame, path: str) -> None:
    """Writes (place, value): each value is a line of the file of that place below a folder. All lines of a file are written by one task, which a second attempt writes anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        last, out = None, None
        try:
            for batch in batches:
                for place, value in zip(batch.column("place").to_pylist(), batch.column("value").to_pylist()):
                    if place != last:
                        if out:
                            out.close()
                        last, file = place, f"{root.rstrip('/')}/{place}"
                        store.create_dir(file.rsplit("/", 1)[0], recursive=True)
                        out = store.open_output_stream(file, compression=None)
                    out.write(f"{value}\n".encode())
        finally:
            if out:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())], names=["none"])

    tasks = df.sparkSession.sparkContext.defaultParallelism  # adaptive execution would put many small files into one task
    df.select("place", "value").repartition(tasks, "place").sortWithinPartitions("place").mapInArrow(run, "none long").write.format("noop").mode("overwrite").save()


def known(path: str) -> bool:
    """Whether Arrow has the store of an address; others are read by Spark alone."""
    try:
        fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, NotImplementedError, OSError):  # no such scheme, or no library for it
        return False
    return True


def listed_by_spark(spark: SparkSession, path: str, pattern: str) -> tuple[str, list[tuple[str, int]]]:
    """The folder's full address, and what `listed` gives, from any store that Spark reads; names below it that begin with _ or a dot are left out, as Spark does."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    address = store.makeQualified(root).toString().rstrip("/")
    out, files = [], store.listFiles(root, True)
    while files.hasNext():
        file = files.next()
        name = file.getPath().toString()[len(address) + 1 :]
        if fnmatch(file.getPath().getName(), pattern) and not any(part[0] in "_." for part in name.split("/")):
            out.append((name, file.getLen()))
    return address, sorted(out)


def digests_by_spark(spark: SparkSession, address: str, found: list[tuple[str, int]], pattern: str) -> DataFrame:
    """The inventory of files whose store Arrow lacks: each is read as one value, so one of 2 GB or more is an error of Spark's. Empty ones, which Spark passes over, come from the list."""
    nothing = hashlib.sha256().hexdigest()
    empty = spark.createDataFrame([(name, length, nothing) for name, length in found if not length], SCHEMA)
    if len(found) == empty.count():
        return empty
    read = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=pattern).load(address)
    name = F.substring("path", len(address) + 2, 1 << 30)
    return read.select(name.alias("name"), "length", F.sha2("content", 256).alias("sha256")).unionByName(empty)


def file_inventory(spark: SparkSession, path: str, pattern: str = "*", partition_bytes: int = 1 << 27, unique: bool = True) -> DataFrame:
    """(name, length, sha256) of all files under a folder, named by their path in it; a file name that occurs twice is an error, unless `unique` is off, as for tables in several parts each.

    Contents are read in chunks by the tasks; only names and lengths are listed on the driver. A folder without files gives no rows.
    """
    own = known(path)
    address, found = (path, listed(path, pattern)) if own else listed_by_spark(spark, path, pattern)
    repeated = [n for n, k in Counter(name.rsplit("/", 1)[-1] for name, _ in found).items() if k > 1]
    if unique and repeated:
        raise CheckFailed(f"file names repeat: {', '.join(sorted(repeated)[:5])}")
    if not own:
        return digests_by_spark(spark, address, found, pattern)
    spark.dataSource.register(FileDigests)
    return spark.read.format("file_digests").options(path=path, pattern=pattern, bytes=str(partition_bytes)).load()
