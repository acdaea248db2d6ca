"""Line dedup by winnowing: repeated runs of lines are deleted wherever they occur again.

A document is a sequence of line hashes (of the lines without white space at either end). A gram opens at every line with a word and reaches
just as far as it takes to hold half of MIN_WORDS words; a window opens at every line and holds MIN_WORDS. Of each window the least gram is selected (the
last of equal ones), once however many windows select it: these are the document's fingerprints, about 2 for each w + 1 lines where a window holds w
grams. Any run of lines with MIN_WORDS words or more that occurs twice holds a whole window, so both places have a fingerprint in common for certain.

1. Fingerprints that occur once are dropped; only their values and places were shuffled.
2. The windows of the others are joined with the first position (by document id, then line) of an equal window. A fingerprint alone would pair a frequent
   passage with its first occurrence in some other context, and miss the run that goes on.
3. From there the match is extended both ways as far as the lines of the two documents agree, and the lines of the later run are deleted. A deleted
   line always has an equal line at an earlier position, so one copy of everything stays. Repeats of fewer words than MIN_WORDS stay too.

The first positions are pre-aggregated minima, so a window that a third of all documents share costs one row for each of them. The lines of a document that
many others repeat are sent once for every FAN of those; the lines of a later document travel once for each document that it repeats. Texts aren't shuffled:
the deletions are stored as sorted arrays in the shared folder, in which the workers look documents up.

Nulls: a null text has no lines and stays null; documents with a null id come last. Rows that are equal in id and text are one document.
Empty texts have one line without words. Very long texts are worked off whole, in time linear in their lines. Empty tables give empty results. Extra columns are
kept, whatever their names; columns that have the name of an output are replaced.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.bpe import blocks
from spanloom.llm.common import fresh, materialise, save_array, shared_dir, stored_arrays, without

MIN_WORDS = 50
#: Later documents that share one copy of the lines of the document they repeat.
FAN = 256
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _hash(line: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"))


def lines_of(text: str | None) -> list[str]:
    return [] if text is None else text.split("\n")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def fingerprints(hashes: np.ndarray, words: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(values, places, upto, windows): the selected grams' hashes and lines, ascending; windows[upto[k]:upto[k + 1]] are the hashes of the windows
    that selected the k-th of them."""
    n, total = len(hashes), np.concatenate([[0], np.cumsum(words)])
    ends = np.searchsorted(total, total[:-1] + min_words)  # lines i..ends[i] - 1 hold enough for a window
    last_window = int(np.searchsorted(ends, n, "right"))  # windows open at lines before this one
    if not last_window:
        return (np.empty(0, np.int64),) * 2 + (np.zeros(1, np.int64), np.empty(0, np.int64))
    grams = np.flatnonzero(words > 0)
    gram_ends = np.searchsorted(total, total[grams] + (min_words + 1) // 2)
    grams = grams[gram_ends <= n]
    gram_ends = gram_ends[:len(grams)]
    # Polynomial hashes of all runs of lines follow from running sums.
    powers, inverses = (np.cumprod(np.full(n + 1, b, np.uint64)) for b in (_BASE, _INVERSE))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(hashes.view(np.uint64)) * powers[:n], dtype=np.uint64)])
    run = lambda a, b: _mixed((sums[b] - sums[a]) * inverses[a])
    values = run(grams, gram_ends).view(np.int64)
    starts = np.arange(last_window)
    first = np.searchsorted(grams, starts)
    beyond = np.searchsorted(gram_ends, ends[:last_window], "right")  # grams first..beyond - 1 lie within the window
    chosen = _least(values, first, beyond)
    # A window's hash tells its content and where in it the selected gram lies.
    found = _mixed(run(starts, ends[:last_window]) ^ (grams[chosen] - starts).astype(np.uint64)).view(np.int64)
    at = np.flatnonzero(np.diff(chosen, prepend=-1))
    return values[chosen[at]], grams[chosen[at]], np.append(at, last_window), found


def _least(values: np.ndarray, first: np.ndarray, beyond: np.ndarray) -> np.ndarray:
    """The place of the least value (the last of equal ones) of each range first..beyond - 1; both ends ascend. One pass with a queue of candidates."""
    from collections import deque

    queue, out, k = deque(), [], 0
    v = values.tolist()
    for a, b in zip(first.tolist(), beyond.tolist()):
        while k < b:
            while queue and v[queue[-1]] >= v[k]:
                queue.pop()
            queue.append(k)
            k += 1
        while queue[0] < a:
            queue.popleft()
        out.append(queue[0])
    return np.array(out, np.int64)


def extended(later: np.ndarray, first: np.ndarray, p: int, q: int) -> tuple[int, int]:
    """The run of later lines (start, end) around p that agree with first's lines around q."""
    a, b = p, p + 1
    while a > 0 and q - (p - a) > 0 and later[a - 1] == first[q - (p - a) - 1]:
        a -= 1
    while b < len(later) and q + (b - p) < len(first) and later[b] == first[q + (b - p)]:
        b += 1
    return a, b


_SEQUENCES = "last boolean, id long, th long, hashes array<long>, values array<long>, places array<int>, windows array<array<long>>"


def _sequences(df: DataFrame, min_words: int) -> DataFrame:
    """Line hashes and fingerprints of each document with a window; df has last (whether the id is null), id, th and text."""

    def run(batches):
        lists = lambda arrays, kind: pa.array(arrays, pa.list_(kind))
        for batch in batches:
            for part in blocks(batch, "text"):
                rows = []
                for last, doc, th, text in zip(*(c.to_pylist() for c in part.columns)):
                    lines = lines_of(text)
                    words = np.array([len(x.split()) for x in lines], np.int64)
                    if words.sum() >= min_words:
                        hashes = np.array([_hash(x.strip()) for x in lines], np.uint64).view(np.int64)
                        values, places, upto, found = fingerprints(hashes, words, min_words)
                        windows = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(found))
                        rows.append((last, doc, th, hashes, values, places.astype(np.int32), windows))
                if rows:
                    last, doc, th, hashes, values, places, windows = zip(*rows)
                    counts = np.cumsum([0, *map(len, windows)])
                    nested = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.concat_arrays(windows))
                    columns = [pa.array(last), pa.array(doc, pa.int64()), pa.array(th, pa.int64()), lists(hashes, pa.int64()), lists(values, pa.int64()), lists(places, pa.int32()), nested]
                    yield pa.RecordBatch.from_arrays(columns, names=["last", "id", "th", "hashes", "values", "places", "windows"])

    return df.mapInArrow(run, _SEQUENCES)


DOC = ("last", "id", "th")


def repeats(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(last, id, th, removed) for documents that repeat something: the line numbers (from 0, ascending) of later runs."""
    rows = df.select(F.col(key).isNull().alias("last"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("id"), F.xxhash64(text).alias("th"), F.col(text).cast("string").alias("text"))
    every = materialise(_sequences(rows, min_words), "line-sequences")
    # Rows equal in id and text give the same fingerprints; one of them counts.
    chosen = every.select(*DOC, F.explode(F.arrays_zip("values", "places")).alias("f")).select(*DOC, F.col("f.values").alias("value"), F.col("f.places").alias("place"))
    shared = chosen.groupBy("value").agg(F.min(F.struct(*DOC, "place")).alias("a"), F.max(F.struct(*DOC, "place")).alias("b")).where("a <> b").select("value")
    shared = materialise(shared, "shared-fingerprints")
    open_ = every.select(*DOC, F.explode(F.arrays_zip("values", "places", "windows")).alias("f")).select(*DOC, F.col("f.values").alias("value"), F.col("f.places").alias("place"), F.col("f.windows").alias("windows"))
    windows = open_.join(shared, "value", "leftsemi").select(*DOC, "place", F.explode("windows").alias("window"))
    windows = materialise(windows.distinct(), "shared-windows")
    first = windows.groupBy("window").agg(F.min(F.struct(*DOC, "place")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("window", "first")
    pairs = (
        windows.join(first, "window")
        .where(F.struct(*DOC, "place") != F.col("first"))
        .groupBy(*DOC, F.struct(*[F.col(f"first.{c}").alias(c) for c in DOC]).alias("of"))
        .agg(F.array_sort(F.collect_set(F.struct(F.col("place"), F.col("first.place").alias("first_place")))).alias("found"))
    )
    pairs = materialise(pairs, "line-pairs")
    mine = every.select(*DOC, "hashes").dropDuplicates(DOC)
    fan = pairs.groupBy("of").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("fan"))
    copies = mine.select(F.struct(*DOC).alias("of"), "hashes").join(fan, "of").select("of", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("salt"), "hashes", *[F.lit(None).cast(t).alias(c) for c, t in zip(DOC, ("boolean", "long", "long"))], F.lit(None).cast(pairs.schema["found"].dataType).alias("found"))
    salt = F.pmod(F.xxhash64(*DOC), F.col("fan")).cast("int").alias("salt")
    later = pairs.join(fan, "of").select("of", salt, *DOC, "found").join(mine, list(DOC)).select("of", "salt", "hashes", *DOC, "found")

    def run(batches):
        """The first document of each group (found is null) comes before those that repeat it."""
        theirs = None
        for batch in batches:
            out, kept = [], []
            for i in range(batch.num_rows):
                hashes = np.asarray(batch.column(2)[i].values)
                if not batch.column(6)[i].is_valid:
                    theirs = hashes
                    continue
                removed: list[np.ndarray] = []
                covered: dict[int, int] = {}
                for pair in batch.column(6)[i].as_py():
                    p, q = pair["place"], pair["first_place"]
                    if covered.get(p - q, -1) > p:  # within the run that an earlier place on this diagonal gave
                        continue
                    a, b = extended(hashes, theirs, p, q)
                    covered[p - q] = b
                    removed.append(np.arange(a, b))
                out.append(np.unique(np.concatenate(removed)).astype(np.int32))
                kept.append(i)
            if kept:
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(kept)) for c in (3, 4, 5)], pa.array(out, pa.list_(pa.int32()))], names=[*DOC, "removed"])

    grouped = copies.unionByName(later).repartition("of", "salt").sortWithinPartitions("of", "salt", F.col("found").isNotNull())
    runs = grouped.mapInArrow(run, "last boolean, id long, th long, removed array<int>")
    return runs.groupBy(*DOC).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("removed")))).alias("removed"))


def store(found: DataFrame) -> str:
    """Writes repeats() as sorted arrays (id and th of each document, where its line numbers start, and those) into the shared folder; returns it."""
    folder = shared_dir(found.sparkSession, "line-repeats")

    def run(batches):
        from pyspark import TaskContext

        held = [(np.asarray(b.column(0)), np.asarray(b.column(1)), b.column(2).to_pylist()) for b in batches if b.num_rows]
        if held:
            rows = [x for h in held for x in h[2]]
            upto = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
            arrays = {"ids": np.concatenate([h[0] for h in held]), "ths": np.concatenate([h[1] for h in held]), "upto": upto, "lines": np.array([v for x in rows for v in x], np.int64)}
            for name, array in arrays.items():
                save_array(folder, f"part-{TaskContext.get().partitionId():06d}.{name}.npy", array.astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64())], names=["n"])

    # Documents without an id are told by their text alone: their place is that of the text's hash.
    placed = found.select(F.when(F.col("last"), F.col("th")).otherwise(F.col("id")).alias("at"), F.when(F.col("last"), F.bitwise_not("th")).otherwise(F.col("th")).alias("th"), "removed")
    placed.repartitionByRange("at", "th").sortWithinPartitions("at", "th").mapInArrow(run, "n long").write.parquet(f"{folder}-written")
    return folder


class Removed:
    """The stored line numbers by document."""

    def __init__(self, folder: str):
        self.parts = list(zip(*(stored_arrays(folder, f".{x}.npy") for x in ("ids", "ths", "upto", "lines"))))
        self.lasts = np.array([p[0].rows(len(p[0]) - 1, len(p[0]))[0] for p in self.parts], np.int64)

    def get(self, doc: int, th: int) -> np.ndarray | None:
        for ids, ths, upto, lines in self.parts[int(np.searchsorted(self.lasts, doc, "left")):]:
            sought = np.array([doc], np.int64)
            i, j = int(ids.find(sought, "left")[0]), int(ids.find(sought, "right")[0])
            if i == j:
                return None
            k = i + int(np.searchsorted(ths.rows(i, j), th))
            if k < j and ths.rows(k, k + 1)[0] == th:
                return lines.rows(*(int(x) for x in upto.rows(k, k + 2)))
            if j < len(ids):
                return None
        return None


@functools.lru_cache(maxsize=2)
def _loaded(folder: str) -> Removed:
    return Removed(folder)


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """df with the text's later repeats deleted, n_lines (before) and removed (array<int>: numbers of the deleted lines)."""
    folder = store(materialise(repeats(df, key, text, min_words), "line-repeats"))
    rows = without(df, *[c for c in ("n_lines", "removed") if c not in (key, text)])
    kept = rows.schema.fields
    schema = T.StructType([*kept, T.StructField("n_lines", T.LongType(), False), T.StructField("removed", T.ArrayType(T.IntegerType(), False), False)])
    # The last two columns, whatever they are called, are what documents are looked up by.
    at_name, th_name = fresh(rows, "_at", "_th")
    th = F.xxhash64(text)
    no_id = F.col(key).isNull()
    marked = rows.withColumns({at_name: F.coalesce(F.col(key).cast("long"), th), th_name: F.when(no_id, F.bitwise_not(th)).otherwise(th)})

    def run(batches):
        found, at_text = _loaded(folder), [f.name for f in kept].index(text)
        for batch in batches:
            for part in blocks(batch, text):
                texts, n_lines, removed = part.column(at_text).to_pylist(), [], []
                for i, (doc, th) in enumerate(zip(part.column(len(kept)).to_pylist(), part.column(len(kept) + 1).to_pylist())):
                    gone = found.get(doc, th)
                    if gone is None:
                        n_lines.append(0 if texts[i] is None else texts[i].count("\n") + 1)
                        removed.append([])
                    else:
                        lines, drop = lines_of(texts[i]), set(gone.tolist())
                        n_lines.append(len(lines))
                        removed.append(gone.tolist())
                        texts[i] = "\n".join([x for k, x in enumerate(lines) if k not in drop])
                columns = [pa.array(texts, part.schema.field(k).type) if k == at_text else part.column(k) for k in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(removed, pa.list_(pa.int32()))], names=[*[f.name for f in kept], "n_lines", "removed"])

    return marked.mapInArrow(run, schema)
