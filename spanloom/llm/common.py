"""Helpers shared by the training-data operators: tables, shared folders, checkpoints, files."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that part words in every operator of this subpackage: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder, as a URI, below the one that all executors share.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset (tests in local mode) a
    temporary folder is set for the context, once.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _context_dir(spark)
    if base is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spanloom-"))
        base = _context_dir(spark)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def _context_dir(spark: SparkSession) -> str | None:
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get() if found.isDefined() else None


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, uri: str) -> None:
    """Deletes a folder of the shared file system if it is there."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI or a plain path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + os.path.abspath(uri)
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def atomic_file(folder: str, name: str):
    """A binary stream whose file appears under its name only when complete, so a rerun task replaces it whole."""
    system, root = filesystem(folder)
    system.create_dir(root, recursive=True)
    draft = f"{root}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as stream:
        yield stream
    system.move(draft, f"{root}/{name}")


def save_array(folder: str, name: str, array) -> None:
    """Writes an array as a .npy file of the shared folder."""
    import numpy as np

    with atomic_file(folder, name) as stream:
        np.lib.format.write_array_header_1_0(stream, {"descr": array.dtype.str, "fortran_order": False, "shape": array.shape})
        stream.write(np.ascontiguousarray(array).tobytes())


def is_local(system) -> bool:
    from pyarrow import fs

    return isinstance(system, fs.LocalFileSystem)


#: Blocks of files that are at hand in a worker, by path and offset; BLOCKS_HELD at most.
_blocks: dict = {}
BLOCKS_HELD = 128


def _block(system, path: str, offset: int, dtype, n: int):
    """n entries of a file from a byte offset on."""
    import numpy as np

    key = (path, offset)
    if key not in _blocks:
        with system.open_input_file(path) as source:
            found = np.frombuffer(source.read_at(n * dtype.itemsize, offset), dtype)
        while len(_blocks) >= BLOCKS_HELD:  # the one that has gone unused for longest
            del _blocks[next(iter(_blocks))]
        _blocks[key] = found
    else:
        _blocks[key] = _blocks.pop(key)
    return _blocks[key]


class StoredArray:
    """A one-dimensional array of save_array(), however large: mapped into memory where the file system is local, else read by blocks of BLOCK entries
    as they are asked for. No worker ever reads the whole file because it needs one entry."""

    BLOCK = 1 << 15

    def __init__(self, system, path: str):
        import numpy as np

        self.system, self.path = system, path
        self.mapped = np.load(path, mmap_mode="r") if is_local(system) else None
        if self.mapped is not None:
            self.n, self.dtype = len(self.mapped), self.mapped.dtype
            return
        with system.open_input_file(path) as source:
            np.lib.format.read_magic(source)
            (self.n,), _, self.dtype = np.lib.format.read_array_header_1_0(source)
            self.offset = source.tell()

    def __len__(self) -> int:
        return self.n

    def _part(self, block: int):
        size = min(self.BLOCK, self.n - block * self.BLOCK)
        return _block(self.system, self.path, self.offset + block * self.BLOCK * self.dtype.itemsize, self.dtype, size)

    def rows(self, start: int, end: int):
        """The entries from start to end."""
        import numpy as np

        if self.mapped is not None:
            return self.mapped[start:end]
        if start >= end:
            return np.empty(0, self.dtype)
        first, last = start // self.BLOCK, (end - 1) // self.BLOCK
        whole = np.concatenate([self._part(b) for b in range(first, last + 1)])
        return whole[start - first * self.BLOCK:end - first * self.BLOCK]

    def at(self, places):
        """The entries at an array of places."""
        import numpy as np

        if self.mapped is not None:
            return self.mapped[places]
        out = np.empty(len(places), self.dtype)
        block = places // self.BLOCK
        for b in np.unique(block).tolist():
            here = block == b
            out[here] = self._part(b)[places[here] - b * self.BLOCK]
        return out

    def find(self, values, side: str = "left"):
        """Places of the values in the array, which must be ascending, as numpy's searchsorted() gives them."""
        import numpy as np

        if self.mapped is not None:
            return np.searchsorted(self.mapped, values, side)
        values = np.asarray(values)
        out, stack = np.zeros(len(values), np.int64), [(0, -(-self.n // self.BLOCK), np.arange(len(values)))]
        while stack:  # blocks lo..hi - 1 hold the places of these values
            lo, hi, which = stack.pop()
            if not len(which) or lo == hi:
                out[which] = min(lo * self.BLOCK, self.n)
                continue
            mid = (lo + hi) // 2
            have, mine = self._part(mid), values[which]
            before = mine <= have[0] if side == "left" else mine < have[0]
            after = mine > have[-1] if side == "left" else mine >= have[-1]
            inside = which[~before & ~after]
            out[inside] = mid * self.BLOCK + np.searchsorted(have, values[inside], side)
            stack += [(lo, mid, which[before]), (mid + 1, hi, which[after])]
        return out


def stored_arrays(folder: str, suffix: str = ".npy", prefix: str = "") -> list[StoredArray]:
    """The arrays of a folder, in order of their names."""
    from pyarrow import fs

    system, root = filesystem(folder)
    found = sorted(f.path for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name.endswith(suffix) and f.base_name.startswith(prefix or "part-"))
    return [StoredArray(system, p) for p in found]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has (Spark ignores case), so that a user's columns never clash with internal ones."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that would clash with an operator's own outputs."""
    return df.drop(*[n for n in names if n in df.columns])


def or_empty(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def let(value, body):
    """body(value) with the value computed once, however often the body (its lambdas included) uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tidy() -> None:
    """Gives freed memory of a Python worker back to the system at a task's end; workers outlive tasks, and the next may need it elsewhere."""
    import ctypes
    import gc

    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
