"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures.

A document's set is that of its distinct word shingles (64-bit hashes); its signature has LENGTH symbols, the low 16 bits of as
many min-hashes. Two sets of Jaccard similarity s differ in a symbol with probability 1 - s. All pairs whose signatures differ in at most
DISTANCE symbols are candidates, for certain: a signature is split into CHUNKS chunks, and among DISTANCE = 2 * CHUNKS - 1 differences one chunk has
at most one (pigeonhole). That one error is enumerated by leaving out each symbol of the chunk in turn: each document has an index key
for each symbol, and the pairs wanted share a key. At the similarity of 0.85 that must be found, more than DISTANCE differences have a
probability of about 1e-6 (miss_probability()).

Candidates are confirmed on full sets, and links are closed to components:

1. Documents of equal sets are one class, by the least id; a group of exact copies, however large, is one row from here on.
2. Each member of a bucket (the documents of one key) is paired with the bucket's least and greatest id, two pre-aggregated values.
   No bucket is collected. Pairs within DISTANCE are confirmed; the links give components.
3. What such stars can't show lies in buckets of three or more that still hold different components. Of each such bucket all documents but those of its
   largest component are compared with the whole bucket, block by block (BLOCK x BLOCK signatures at once; the blocks are spread over as many
   tasks as their number asks for), and only pairs of different components within DISTANCE go on to be confirmed. So no link that changes a
   component is lost, and a group of copies, however large, is never expanded into pairs nor compared within itself.

Confirmation reads sets from a store in the shared folder: the sets of the candidates only, written by one pass over the documents,
each found by its document's position in a sorted index. So neither texts nor sets are shuffled. The store's files are named by task attempt: a
rerun task never replaces what another attempt's index rows point into.

Nulls and texts without words have an empty set and link with nothing. A null id links with nothing. Rows of one id are one
document, whose sets are those of all its rows. Ties can't arise: of a group the least id is kept. Very long texts are shingled whole. Empty tables give empty
results. Extra columns are kept, whatever their names.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import sorted_ids
from spanloom.llm.bpe import blocks
from spanloom.llm.common import atomic_file, filesystem, is_local, materialise, save_array, shared_dir, stored_arrays, tidy
from spanloom.llm.components import components

LENGTH, CHUNKS = 65, 13
DISTANCE = 2 * CHUNKS - 1
BLOCK = 1024
#: Tasks at most in which the blocks of open buckets are compared.
MAX_TASKS = 50_000
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_SEEDS = np.random.default_rng(20240229).integers(1, 1 << 63, (LENGTH, 2), dtype=np.uint64) | np.uint64(1)


def miss_probability(similarity: float) -> float:
    """That two sets of this similarity differ in more than DISTANCE symbols."""
    p = 1 - similarity
    return sum(math.comb(LENGTH, k) * p**k * (1 - p) ** (LENGTH - k) for k in range(DISTANCE + 1, LENGTH + 1))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """The 8-byte hash of each word, looked up; emptied when it has LIMIT words."""

    LIMIT = 200_000

    def __missing__(self, word: str) -> bytes:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        found = self[word] = xxhash.xxh64_digest(word.encode("utf-8", "surrogatepass"))
        return found


class Shingler:
    """Distinct shingle hashes of texts."""

    def __init__(self, words: int):
        self.words, self.known = words, WordHashes()

    def __call__(self, text: str) -> np.ndarray:
        """Sorted distinct hashes of the text's shingles (the whole sequence if it is shorter, none without words)."""
        # lower() of bytes changes A-Z alone
        found = _WORDS.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))
        n, h = self.words, np.frombuffer(b"".join(map(self.known.__getitem__, found)), np.uint64)
        if len(h) < n:
            import xxhash

            return np.array([xxhash.xxh64_intdigest(h.tobytes(), seed=len(h))], np.uint64) if len(h) else h
        out = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            # each step's product spreads what was mixed in before, so the order of the words counts
            out = (out ^ h[k:len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return np.unique(_mixed(out))


def signature(shingles: np.ndarray) -> np.ndarray:
    """LENGTH symbols (uint16) of a set that isn't empty. All hash functions are worked off together, over blocks of the set that stay in the cache."""
    least = None
    for i in range(0, len(shingles), 1024):
        x = shingles[None, i:i + 1024] ^ _SEEDS[:, :1]
        x *= _SEEDS[:, 1:]
        least = x.min(1) if least is None else np.minimum(least, x.min(1))
    # the minimum's own bits are small numbers at the top: mix them before 16 are taken
    return (_mixed(least) & np.uint64(0xFFFF)).astype(np.uint16)


def index_keys(signatures: np.ndarray) -> np.ndarray:
    """The keys (int64, one per symbol) of each row: of every chunk, all its symbols but one, with the place of that one."""
    n, size = len(signatures), LENGTH // CHUNKS
    out = np.empty((n, LENGTH), np.uint64)
    wide = signatures.astype(np.uint64)
    for c in range(CHUNKS):
        for gap in range(size):
            h = np.full(n, c * size + gap + 1, np.uint64)
            for k in range(size):
                if k != gap:
                    h = (h << np.uint64(16)) | wide[:, c * size + k]
                    if k == size // 2:
                        h = _mixed(h)
            out[:, c * size + gap] = _mixed(h ^ np.uint64(c * size + gap))
    return out.view(np.int64)


def sketches(df: DataFrame, words: int) -> DataFrame:
    """(id, n, print, sig) for (id, text): the size of the set, its 128-bit digest and its signature (both null if empty)."""

    def run(batches):
        import xxhash

        shingler = Shingler(words)
        for batch in batches:
            for part in blocks(batch, "text"):
                n, prints, sigs = [], [], []
                for text in part.column(1).to_pylist():
                    s = shingler(text or "")
                    n.append(len(s))
                    prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    sigs.append(signature(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(sigs, pa.binary())], names=["id", "n", "print", "sig"])
        del shingler
        tidy()

    return df.mapInArrow(run, "id long, n long, print binary, sig binary")


def keyed(classes: DataFrame) -> DataFrame:
    """(key, id) for the classes' (id, sig)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, LENGTH)
                keys = index_keys(sigs)
                ids = np.repeat(np.asarray(batch.column(0)), LENGTH)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], names=["key", "id"])

    return classes.select("id", "sig").mapInArrow(run, "key long, id long")


def _near(df: DataFrame, out: str) -> DataFrame:
    """The rows of (u, v, us, vs) whose signatures differ in at most DISTANCE symbols, as (u, v)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, LENGTH) for c in (2, 3))
                yield batch.select([0, 1]).filter(pa.array((a != b).sum(1) <= DISTANCE))

    return df.mapInArrow(run, out)


# --- the store of candidates' sets ----------------------------------------------------------------------------------------------


INDEX = ("id", "part", "attempt", "offset", "n")


def store_sets(df: DataFrame, chosen: str, words: int) -> str:
    """Writes the sets of the documents (id, text) whose ids are in the stored set chosen; returns the folder."""
    folder = shared_dir(df.sparkSession, "shingle-sets")
    kind = ", ".join(f"{c} long" for c in INDEX)

    def run(batches):
        from pyspark import TaskContext

        shingler, want, task = Shingler(words), sorted_ids.loaded(chosen), TaskContext.get()
        part, attempt, at, rows = task.partitionId(), task.taskAttemptId(), 0, []
        with atomic_file(folder, _sets_file(part, attempt)) as stream:
            for batch in batches:
                for block in blocks(batch, "text"):
                    ids = block.column(0)
                    hit = np.flatnonzero(want.has(np.asarray(ids.fill_null(0), np.int64)) & ~np.asarray(ids.is_null()))
                    for i in hit.tolist():
                        s = shingler(block.column(1)[i].as_py() or "")
                        rows.append((ids[i].as_py(), part, attempt, at, len(s)))
                        stream.write(s.tobytes())
                        at += 8 * len(s)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=list(INDEX))

    index = materialise(df.mapInArrow(run, kind), "shingle-index")

    def indexed(batches):
        from pyspark import TaskContext

        held = [np.stack([np.asarray(c) for c in b.columns]) for b in batches if b.num_rows]
        if held:
            for name, column in zip(INDEX, np.concatenate(held, 1)):
                save_array(folder, f"index-{TaskContext.get().partitionId():06d}.{name}.npy", column)
        yield pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64())], names=["n"])

    index.repartitionByRange("id").sortWithinPartitions(*INDEX).mapInArrow(indexed, "n long").write.parquet(f"{folder}-indexed")
    return folder


def _sets_file(part: int, attempt: int) -> str:
    return f"part-{part:06d}-{attempt}.sets"


class Sets:
    """The stored sets by id. Index and sets are mapped into memory on a local file system, else read by byte ranges."""

    def __init__(self, folder: str):
        self.system, self.root = filesystem(folder)
        self.local = is_local(self.system)
        self.index = list(zip(*(stored_arrays(folder, f".{c}.npy", "index-") for c in INDEX)))
        self.firsts = np.array([ids.rows(0, 1)[0] for ids, *_ in self.index], np.int64)
        self.files: dict[str, object] = {}

    def _rows(self, doc: int):
        """Index rows of an id; one for each row of the documents that has it, perhaps over two neighbouring parts."""
        p = int(np.searchsorted(self.firsts, doc, "left"))
        sought = np.array([doc], np.int64)
        for q in range(max(0, p - 1), len(self.index)):
            if self.firsts[q] > doc:
                return
            ids, *rest = self.index[q]
            i, j = (int(ids.find(sought, side)[0]) for side in ("left", "right"))
            yield from zip(*(c.rows(i, j).tolist() for c in rest))

    def _read(self, name: str, offset: int, n: int) -> np.ndarray:
        path = f"{self.root}/{name}"
        if name not in self.files:
            self.files[name] = np.memmap(path, np.uint64, "r") if self.local else self.system.open_input_file(path)
        return self.files[name][offset // 8:offset // 8 + n] if self.local else np.frombuffer(self.files[name].read_at(8 * n, offset), np.uint64)

    @functools.lru_cache(maxsize=16)  # noqa: B019
    def get(self, doc: int) -> list[np.ndarray]:
        return [np.array(self._read(_sets_file(part, attempt), offset, n)) for part, attempt, offset, n in self._rows(doc) if n]


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b| for sorted distinct arrays."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are as alike as percent asks; docs: (id, text)."""
    pairs = materialise(pairs, "candidate-pairs")
    ids = pairs.select(F.explode(F.array("u", "v")).alias("id"))
    folder = store_sets(docs, sorted_ids.store(ids, "id"), words)

    def run(batches):
        sets = Sets(folder)
        for batch in batches:
            keep = [any(alike(a, b, percent) for a in sets.get(u) for b in sets.get(v)) for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    # The pairs of one hot document are spread by its partner, then sorted so that its set stays at hand.
    spread = pairs.repartition(F.col("v"), F.pmod(F.hash("u"), F.lit(64))).sortWithinPartitions("v", "u")
    return materialise(spread.mapInArrow(run, "u long, v long"), "links")


def _blocks_apart(rows: DataFrame) -> DataFrame:
    """Near pairs of different components within buckets; rows: (key, id, component, sig)."""
    rows = materialise(rows, "open-buckets")
    sizes = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.sum("c").alias("n"), F.max(F.struct("c", "component")).alias("top"))
    sizes = sizes.select("key", (F.col("n") * (F.col("n") - F.col("top.c"))).alias("compared"), (F.ceil(F.col("n") / BLOCK)).cast("int").alias("across"), F.ceil((F.col("n") - F.col("top.c")) / BLOCK).cast("int").alias("down"), F.col("top.component").alias("largest"))
    sizes = materialise(sizes, "open-bucket-sizes")
    compared_pairs = sizes.agg(F.sum(F.col("compared").cast("double"))).first()[0] or 0
    marked = rows.join(sizes.drop("compared"), "key").withColumn("minor", F.col("component") != F.col("largest"))
    place = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # What isn't of the largest component goes down, everything across: a cell is compared in one task.
    right = marked.select("key", each("down").alias("a"), place(7, "across").alias("b"), F.lit(False).alias("left"), "id", "component", "sig")
    left = marked.where("minor").select("key", place(11, "down").alias("a"), each("across").alias("b"), F.lit(True).alias("left"), "id", "component", "sig")

    def run(batches):
        held = None
        for batch in batches:
            if batch.num_rows:
                now = [np.asarray(c) for c in batch.columns[:6]]
                now.append(np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint16).reshape(-1, LENGTH))
                if held is not None:
                    now = [np.concatenate(x) for x in zip(held, now)]
                key, a, b = now[:3]
                starts = np.flatnonzero((key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
                bounds = [0, *starts.tolist()]
                for i, j in zip(bounds, bounds[1:]):
                    yield from compared(*(x[i:j] for x in now[3:]))
                held = [x[bounds[-1]:] for x in now]
        if held is not None:
            yield from compared(*held[3:])

    def compared(left, ids, components, sigs):
        down, across = np.flatnonzero(left), np.flatnonzero(~left)
        pairs = []
        for i in down.tolist():
            near = across[(components[across] != components[i]) & ((sigs[across] != sigs[i]).sum(1) <= DISTANCE)]
            if len(near):
                pairs.append((np.full(len(near), ids[i]), ids[near]))
        if pairs:
            u, v = (np.concatenate(x) for x in zip(*pairs))
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    # A number of partitions that is asked for isn't coalesced: the cells' bytes are few, their work is not.
    tasks = int(min(max(compared_pairs // (4 * BLOCK * BLOCK), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), MAX_TASKS))
    return right.unionByName(left).repartition(tasks, "key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(run, "u long, v long").distinct()


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component) for each row of df: the size of its set and the least id that it reaches through links."""
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    sketched = materialise(sketches(docs, words), "sketches")
    whole = sketched.where("id IS NOT NULL AND n > 0")
    # Documents of equal sets: linked with the least of them. Their signature stands for all.
    classes = materialise(whole.groupBy("print").agg(F.min("id").alias("id"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("copies")), "set-classes")
    copies = whole.join(classes.where("copies > 1").select("print", F.col("id").alias("v")), "print").select(F.col("id").alias("u"), "v").where("u <> v")
    # An id with several rows may stand for several sets: its row in each class is the same node.
    keys = materialise(keyed(classes), "index-keys")
    ends = keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialise(keys.join(ends, "key"), "bucket-members")
    stars = members.select(F.explode(F.array(F.struct(F.col("id").alias("u"), F.col("lo").alias("v")), F.struct(F.col("hi").alias("u"), F.col("id").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
    sigs = classes.select("id", "sig")
    with_u = stars.join(sigs.select(F.col("id").alias("u"), F.col("sig").alias("us")), "u")
    with_both = with_u.join(sigs.select(F.col("id").alias("v"), F.col("sig").alias("vs")), "v").select("u", "v", "us", "vs")
    links = confirmed(_near(with_both, "u long, v long"), docs, words, percent)
    found = materialise(components(links), "star-components")
    # Buckets of three or more that the stars left in different components.
    labelled = members.where("n > 2").join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    open_ = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    rest = _blocks_apart(labelled.join(open_, "key").join(sigs, "id").select("key", "id", "component", "sig"))
    more = confirmed(rest, docs, words, percent)
    every = links.unionByName(more).unionByName(copies)
    final = components(every)
    joined = sketched.select("id", F.col("n").alias("n_shingles")).join(materialise(final, "components"), "id", "left")
    return joined.select("id", "n_shingles", F.coalesce("component", "id").alias("component"))


def survivors(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of df that are the least of their group, with all their columns; the texts aren't shuffled."""
    gone = groups(df, key, text, words, percent).where("id <> component").select("id")
    folder = sorted_ids.store(gone, "id")
    return sorted_ids.rows_with(df, key, folder, wanted=False)
