"""A set of ids as sorted .npy files in the shared folder.

Tests for membership need no shuffle of the rows that are tested, and neither the driver nor a broadcast holds the ids. Workers map the files into
memory where the file system is local, and else read the blocks that they need (see StoredArray).
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import save_array, shared_dir, stored_arrays


def store(ids: DataFrame, column: str) -> str:
    """Writes the distinct values (long, nulls left out) of a column; returns the folder."""
    folder = shared_dir(ids.sparkSession, "ids")

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held = [b.column(0).to_numpy() for b in batches]
        array = np.concatenate(held) if held else np.empty(0, np.int64)
        if len(array):
            save_array(folder, f"part-{part:06d}.npy", array)
        yield pa.RecordBatch.from_arrays([pa.array([len(array)], pa.int64())], names=["n"])

    distinct = ids.select(F.col(column).cast("long").alias("id")).where("id IS NOT NULL").distinct()
    distinct.repartitionByRange("id").sortWithinPartitions("id").mapInArrow(run, "n long").write.parquet(f"{folder}-written")
    return folder


class SortedIds:
    def __init__(self, folder: str):
        self.parts = stored_arrays(folder)
        self.firsts = np.array([p.rows(0, 1)[0] for p in self.parts], np.int64)

    def has(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), bool)
        part = np.searchsorted(self.firsts, ids, "right") - 1
        for p in np.unique(part[part >= 0]):
            at = np.flatnonzero(part == p)
            have = self.parts[p]
            out[at] = have.at(np.minimum(have.find(ids[at]), len(have) - 1)) == ids[at]
        return out


@functools.lru_cache(maxsize=4)
def loaded(folder: str) -> SortedIds:
    return SortedIds(folder)


def rows_with(df: DataFrame, column: str, folder: str, wanted: bool = True) -> DataFrame:
    """The rows whose id is (or, with wanted=False, is not) in the stored set; a null id is in no set."""

    def run(batches):
        have = loaded(folder)
        for batch in batches:
            values = batch.column(batch.schema.names.index(column))
            ids = np.asarray(values.fill_null(0), np.int64)
            hit = have.has(ids) & ~np.asarray(values.is_null())
            mask = hit if wanted else ~hit
            if mask.any():
                yield batch.filter(pa.array(mask))

    return df.mapInArrow(run, df.schema)


def store_pairs(pairs: DataFrame) -> str:
    """Writes the distinct pairs (a, b) of longs, in order; returns the folder."""
    folder = shared_dir(pairs.sparkSession, "id-pairs")

    def run(batches):
        from pyspark import TaskContext

        held = [np.stack([np.asarray(c) for c in b.columns]) for b in batches if b.num_rows]
        if held:
            for name, column in zip("ab", np.concatenate(held, 1)):
                save_array(folder, f"part-{TaskContext.get().partitionId():06d}.{name}.npy", column)
        yield pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64())], names=["n"])

    pairs.select("a", "b").distinct().repartitionByRange("a", "b").sortWithinPartitions("a", "b").mapInArrow(run, "n long").write.parquet(f"{folder}-written")
    return folder


class SortedPairs:
    def __init__(self, folder: str):
        self.parts = list(zip(*(stored_arrays(folder, f".{x}.npy") for x in "ab")))
        self.ends = np.array([[a.rows(0, 1)[0], a.rows(len(a) - 1, len(a))[0]] for a, _ in self.parts], np.int64).reshape(-1, 2)

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        for (have, others), (first, last) in zip(self.parts, self.ends):
            rows = np.flatnonzero((first <= a) & (a <= last))
            for row, i, j in zip(rows.tolist(), have.find(a[rows], "left").tolist(), have.find(a[rows], "right").tolist()):
                if i < j:
                    mine = others.rows(i, j)
                    k = int(np.searchsorted(mine, b[row]))
                    out[row] |= k < j - i and mine[k] == b[row]
        return out


@functools.lru_cache(maxsize=4)
def loaded_pairs(folder: str) -> SortedPairs:
    return SortedPairs(folder)
