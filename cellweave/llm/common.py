"""Shared pieces of the training-data operators: text columns, written intermediates, shared files."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\f\r"

#: Stand-ins for the shared folder, by application.
_own: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def words(text: Column) -> Column:
    """Array of the ``[^\\x20\\x09-\\x0D]+`` runs of ``text``; null text has none. Built-in functions only."""
    flat = F.translate(F.coalesce(text, F.lit("")), BLANKS[1:], " " * (len(BLANKS) - 1))
    return F.array_remove(F.split(flat, " "), "")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the folder that ``spark.checkpoint.dir`` names for the whole cluster.

    Where the session names none, a temporary folder stands in on one machine; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        application = spark.sparkContext.applicationId
        if application not in _own:
            _own[application] = "file://" + tempfile.mkdtemp(prefix="cellweave-")
        root = _own[application]
    path = f"{root.rstrip('/')}/cellweave-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def _clean() -> None:
    """Removes what ``shared_dir`` handed out once the application ends; results read those files until then."""
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone by now; the files are then left to the folder's owner
            pass


_shipped: set[str] = set()


def shipped(df: DataFrame) -> DataFrame:
    """``df``, once the executors' Python can import this package: it is sent along, once for each application."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        base = os.path.join(tempfile.mkdtemp(prefix="cellweave-"), "cellweave_code.zip")
        with zipfile.ZipFile(base, "w") as out:
            for folder, _, names in sorted(os.walk(top)):  # whole, so it stands in for any other copy of the package
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, os.path.dirname(top)))
        context.addPyFile(base)
        _shipped.add(context.applicationId)
    return df


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Files:
    """Byte files in the shared folder, for Python on executors: a mounted folder, or any pyarrow file system."""

    def __init__(self, root: str):
        self.root = root

    def _local(self, name: str) -> str | None:
        path = f"{self.root}/{name}"
        if path.startswith("file:"):
            return "/" + path[5:].lstrip("/")
        return path if "://" not in path else None

    def _remote(self, name: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(f"{self.root}/{name}")

    def write(self, name: str, chunks) -> int:
        """Writes the chunks to a name of its own and renames, so a task that runs twice leaves one whole file."""
        local, size = self._local(name), 0
        own = f"{name}.{uuid.uuid4().hex}.part"
        if local is not None:
            os.makedirs(os.path.dirname(local), exist_ok=True)
            with open(self._local(own), "wb") as out:
                for chunk in chunks:
                    size += out.write(chunk)
            os.replace(self._local(own), local)
            return size
        system, path = self._remote(own)
        with system.open_output_stream(path) as out:
            for chunk in chunks:
                size += out.write(chunk)
        system.move(path, path[: -len(own)] + name)
        return size

    def open(self, name: str):
        local = self._local(name)
        if local is not None:
            return open(local, "rb")
        system, path = self._remote(name)
        return system.open_input_file(path)


_memories: dict[str, list[dict]] = {}


def memories(owner: str) -> list[dict]:
    """What an operator remembers in this worker process, for ``only``."""
    return _memories.setdefault(owner, [])


class Remembered(dict):
    """A bounded memory of a function of one argument; it starts afresh when full, so results never depend on it."""

    def __init__(self, function, most: int, owner: str):
        super().__init__()
        self.function, self.most = function, most
        memories(owner).append(self)

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.function(key)
        return value


def only(owner: str) -> None:
    """Empties what other operators' memories hold in this worker process; Spark reuses processes from stage to stage."""
    import pyarrow as pa

    for other, held in _memories.items():
        if other != owner:
            for memory in held:
                memory.clear()
    pa.default_memory_pool().release_unused()
