"""What the corpus operators share: scratch tables in the shared folder, file access, small codecs."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

#: Stands for a null id wherever an id is a join key, so that null ids survive joins.
NULL_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session that runs in this process alone gets a folder of its own; on a cluster that would
    be another folder on every machine, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: the corpus operators need a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quern-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found if "://" in found or found.startswith("file:") else "file://" + os.path.abspath(found)


class Scratch:
    """Tables that cut a job's lineage, written below the shared folder and removed when the program ends.

    A lost executor costs nothing that was written here: every executor sees the folder.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/quern-{tag}-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and returns the written table."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        with suppress(Exception):  # the session may be gone when the program ends
            self.drop()


class Files:
    """Opens files below a base URI on the driver or an executor."""

    def __init__(self, base: str):
        self.local = base.split("://", 1)[-1] if base.startswith("file://") else base[5:] if base.startswith("file:") else None
        if self.local is None:
            from pyarrow import fs

            self.fs, self.base = fs.FileSystem.from_uri(base)
        else:
            self.base = self.local

    def write(self, name: str, parts) -> None:
        """Writes all parts under a name of this attempt, then renames: a repeated task leaves one whole file."""
        to, tmp = f"{self.base}/{name}", f"{self.base}/.{name}.{uuid.uuid4().hex}"
        if self.local is not None:
            os.makedirs(os.path.dirname(tmp), exist_ok=True)
            with open(tmp, "wb") as f:
                for p in parts:
                    f.write(p)
            os.replace(tmp, to)
            return
        self.fs.create_dir(self.base, recursive=True)
        with self.fs.open_output_stream(tmp) as f:
            for p in parts:
                f.write(p)
        from pyarrow.fs import FileType

        if self.fs.get_file_info(to).type != FileType.NotFound:
            self.fs.delete_file(to)
        self.fs.move(tmp, to)

    def open(self, name: str):
        return open(f"{self.base}/{name}", "rb") if self.local is not None else self.fs.open_input_file(f"{self.base}/{name}")


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def spread(spark: SparkSession, n_rows: int) -> int:
    """How many tasks a small table of work items is dealt to."""
    return max(1, min(n_rows, 4 * partitions(spark)))


def let_go(encoder: bool = True, scorer: bool = False) -> None:
    """Gives back what earlier tasks have left in this Python worker, which Spark uses again for other operators' tasks.

    With ``encoder``, the parts of texts that an encoder remembers go too; without ``scorer``, so do the words of a scorer.
    """
    import ctypes
    import gc
    import sys

    import pyarrow as pa

    tokens, toxicity = sys.modules.get("quern.llm.tokens"), sys.modules.get("quern.llm.toxicity")
    if encoder and tokens is not None:
        tokens.encoder.cache_clear()
    if not scorer and toxicity is not None:
        toxicity._SCORERS.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)
