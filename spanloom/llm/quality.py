"""Quality rules, and perplexity bands of a modified Kneser-Ney language model counted by Spark.

The model is an interpolated character n-gram model (ORDER characters) for each language, over all documents. The workers count the
n-grams of blocks of text, Spark sums the counts; the lower orders' continuation counts, the modified Kneser-Ney discounts and the
interpolated probabilities are groupings and joins of those tables. The result is stored as sorted hash arrays: for each order
two tables (n-gram hash to log2 probability, context hash to log2 back-off weight), range-partitioned by hash, each part a pair
of .npy files in the shared folder. Workers map the files into memory (or read blocks of them, where the file system isn't local)
and look the hashes of a block of texts up by binary search; nothing is collected or broadcast, however large the model grows.

A text's score is the mean bits per character. For each language the quartiles of the scores of documents that pass the
base rules set a lower and an upper band, quartile -/+ SPREAD times the distance between the quartiles (FLOOR bits at
least), so a band holds all but far outliers. A document is kept if it passes the base rules and its score lies within its language's band.

Nulls: a null text has no words and fails; a null language is a language of its own. Equal texts of one language get equal scores, and bounds of a band
belong to it. Very long texts are scored whole. Empty tables give empty results. judge() returns the key beside its outputs.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.bpe import blocks
from spanloom.llm.common import materialise, save_array, shared_dir, stored_arrays, tidy

ORDER = 5
PAD = "\x02"
SPREAD, FLOOR = 6.0, 0.12
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SUBBLOCK_CHARS = 500_000

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_SPACES = " \t\n\x0b\x0c\r"


# --- n-grams of blocks -------------------------------------------------------------------------------------------------------------


def _packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(alphabet, n-gram keys, text number) of all positions of the texts; a key is the n-gram as a number to the base of the alphabet's size.

    Each text is preceded by ORDER - 1 pads, so that every character ends one n-gram.
    """
    pad = PAD * (ORDER - 1)
    flat = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.zeros(0x110000, bool)
    seen[flat] = True
    alphabet = np.flatnonzero(seen)
    if len(alphabet) ** ORDER >= 1 << 64:
        return alphabet, np.empty(0, np.uint64), np.empty(0, np.int64)
    number = np.zeros(0x110000, np.uint64)
    number[alphabet] = np.arange(len(alphabet), dtype=np.uint64)
    ids, base = number[flat], np.uint64(len(alphabet))
    keys = ids[:-(ORDER - 1)].copy()
    for k in range(1, ORDER):
        keys *= base
        keys += ids[k:len(ids) - (ORDER - 1) + k]
    # The n-gram that starts at i ends at i + ORDER - 1; text t's characters follow its pads.
    lengths = np.array([len(x) for x in texts], np.int64)
    which = np.repeat(np.arange(len(texts)), lengths)
    ends = np.arange(len(which)) + (which + 1) * (ORDER - 1)
    return alphabet, keys[ends - (ORDER - 1)], which


def _grams(alphabet: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The code points (rows of ORDER) of n-gram keys."""
    base, out, rest = np.uint64(len(alphabet)), np.empty((len(keys), ORDER), np.uint32), keys.copy()
    for k in range(ORDER - 1, -1, -1):
        out[:, k] = alphabet[(rest % base).astype(np.int64)]
        rest //= base
    return out


def _pieces(texts: list[str]):
    """Groups of texts (as lists of their numbers) of about SUBBLOCK_CHARS; halves a group whose alphabet is too large for packed keys."""
    group, size = [], 0
    for i, x in enumerate(texts):
        group.append(i)
        size += len(x)
        if size >= SUBBLOCK_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def _counted(texts: list[str]):
    """(grams as code points, counts) for groups of texts."""
    stack = list(_pieces(texts))[::-1]
    while stack:
        group = stack.pop()
        mine = [texts[i] for i in group]
        alphabet, keys, which = _packed(mine)
        if len(alphabet) ** ORDER >= 1 << 64:
            yield from _wide(mine)
            continue
        unique, counts = np.unique(keys, return_counts=True)
        yield _grams(alphabet, unique), counts


def _wide(texts: list[str]):
    """As _counted, for alphabets beyond packed keys: rows of code points are compared as they are."""
    for x in texts:
        rows = _rows(x)
        if len(rows):
            yield np.unique(rows, axis=0, return_counts=True)


def _rows(text: str) -> np.ndarray:
    flat = np.frombuffer((PAD * (ORDER - 1) + text).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.lib.stride_tricks.sliding_window_view(flat, ORDER)


def counts(df: DataFrame, lang: str, text: str) -> DataFrame:
    """(lang, g, c): how often each n-gram occurs in each language's texts."""

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                by: dict[str | None, list[str]] = {}
                for language, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if x:
                        by.setdefault(language, []).append(x)
                for language, texts in by.items():
                    for grams, n in _counted(texts):
                        # each row of code points becomes one string
                        whole = np.ascontiguousarray(grams).tobytes().decode("utf-32-le", "surrogatepass")
                        g = [whole[i:i + ORDER] for i in range(0, len(whole), ORDER)]
                        yield pa.RecordBatch.from_arrays([pa.array([language] * len(g), pa.string()), pa.array(g, pa.string()), pa.array(n, pa.int64())], names=["lang", "g", "c"])
        tidy()

    rows = df.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "lang string, g string, c long").groupBy("lang", "g").agg(F.sum("c").alias("c"))


# --- the model -----------------------------------------------------------------------------------------------------------------------


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def hashed(lang: str | None, grams: np.ndarray) -> np.ndarray:
    """The hashes by which the model's tables are sorted, of rows of code points (uint32). All rows are worked off together."""
    import xxhash

    h = np.full(len(grams), xxhash.xxh64_intdigest(b"" if lang is None else b"\x01" + lang.encode("utf-8", "surrogatepass"), grams.shape[1]), np.uint64)
    for k in range(grams.shape[1]):
        h = (h ^ (grams[:, k].astype(np.uint64) + np.uint64(1))) * _A
        h ^= h >> np.uint64(32)
    h *= _B
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def _keyed(df: DataFrame, name: str, length: int) -> DataFrame:
    """(name, h, v) of a table (lang, gram, v) whose n-grams have so many characters."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            langs = batch.column(0).dictionary_encode(null_encoding="encode")
            grams = np.frombuffer("".join(batch.column(1).to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(batch.num_rows, length)
            which, h = np.asarray(langs.indices), np.empty(batch.num_rows, np.int64)
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                h[which == i] = hashed(lang, grams[which == i])
            yield pa.RecordBatch.from_arrays([pa.array([name] * batch.num_rows), pa.array(h), batch.column(2)], names=["name", "h", "v"])

    return df.mapInArrow(run, "name string, h long, v float")


def _discounts(table: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): modified Kneser-Ney discounts of a table's counts."""
    n = [F.sum(F.when(F.col("c") == i, 1).otherwise(0)).cast("double") for i in (1, 2, 3, 4)]
    a = table.groupBy("lang").agg(*[x.alias(f"n{i}") for i, x in enumerate(n, 1)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    usable = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0)
    d = lambda i, plain: F.when(usable, F.greatest(F.lit(0.1), F.least(F.lit(i - 0.1), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")))).otherwise(plain)
    return a.select(F.col("lang").alias("dl"), d(1, 0.5).alias("d1"), d(2, 1.0).alias("d2"), d(3, 1.5).alias("d3"))


def model(grams: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: (lang, g, lp: log2 probability) and (lang, ctx, lb: log2 back-off weight).

    grams: (lang, g, c) of counts(). Order ORDER has the counts, each lower order the number of distinct n-grams of the
    next order that end in its n-gram.
    """
    tables = {ORDER: grams}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = materialise(tables[k + 1].groupBy("lang", F.expr("substring(g, 2)").alias("g")).agg(F.count(F.lit(1)).alias("c")), f"kn-count{k}")
    letters = tables[1].groupBy(F.col("lang").alias("ll")).agg((F.count(F.lit(1)) + 1).alias("v"))
    out, lower = [], None
    for k in range(1, ORDER + 1):
        t, d = tables[k], _discounts(tables[k])
        c = F.col("c")
        cut = F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = t.join(d, t["lang"].eqNullSafe(d["dl"])).select("lang", "g", F.expr(f"substring(g, 1, {k - 1})").alias("ctx"), c.cast("double").alias("c"), cut.alias("cut"))
        context = rows.groupBy(F.col("lang").alias("cl"), F.col("ctx").alias("cc")).agg(F.sum("c").alias("total"), F.sum("cut").alias("mass"))
        context = materialise(context.select("cl", "cc", "total", (F.col("mass") / F.col("total")).alias("back")), f"kn-context{k}")
        joined = rows.join(context, F.col("lang").eqNullSafe(F.col("cl")) & (F.col("ctx") == F.col("cc")))
        own = (F.col("c") - F.col("cut")) / F.col("total")
        if k == 1:
            joined = joined.join(letters, F.col("lang").eqNullSafe(F.col("ll"))).withColumn("low", 1 / F.col("v"))
        else:
            before = lower.select(F.col("lang").alias("bl"), F.col("g").alias("bg"), F.col("p").alias("low"))
            joined = joined.join(before, F.col("lang").eqNullSafe(F.col("bl")) & (F.expr("substring(g, 2)") == F.col("bg")))
        lower = materialise(joined.select("lang", "g", (own + F.col("back") * F.col("low")).alias("p")), f"kn-order{k}")
        out.append((lower.select("lang", "g", F.log2("p").alias("lp")), context.select(F.col("cl").alias("lang"), F.col("cc").alias("ctx"), F.log2("back").alias("lb"))))
    # order 0: uniform over the characters of the language and one for all others
    return [(letters.select(F.col("ll").alias("lang"), F.lit("").alias("g"), (-F.log2("v")).alias("lp")), None), *out]


def store(tables, folder: str) -> None:
    """Writes the model as sorted hash arrays: <name>/part-N.keys.npy and .values.npy, ascending over the parts."""
    every = None
    for k, (probabilities, backs) in enumerate(tables):
        for name, df, gram, value, length in ((f"p{k}", probabilities, "g", "lp", k), (f"b{k}", backs, "ctx", "lb", k - 1)):
            if df is not None:
                rows = _keyed(df.select("lang", gram, F.col(value).cast("float").alias("v")), name, length)
                every = rows if every is None else every.unionByName(rows)

    def run(batches):
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), {}
        for batch in batches:
            names, h, v = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for name in np.unique(names):
                held.setdefault(name, []).append((h[names == name], v[names == name]))
        for name, pieces in held.items():
            for what, i in (("keys", 0), ("values", 1)):
                save_array(f"{folder}/{name}", f"part-{part:06d}.{what}.npy", np.concatenate([p[i] for p in pieces]))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([sum(len(p[0]) for p in pieces)], pa.int64())], names=["name", "part", "entries"])

    every.repartitionByRange("h").sortWithinPartitions("h").mapInArrow(run, "name string, part int, entries long").write.parquet(f"{folder}/parts")


class HashArray:
    """A stored table: sorted parts."""

    def __init__(self, folder: str, name: str):
        self.parts = list(zip(*(stored_arrays(f"{folder}/{name}", f".{x}.npy") for x in ("keys", "values"))))
        self.firsts = np.array([k.rows(0, 1)[0] for k, _ in self.parts], np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of the keys, NaN where a key is missing. They are looked up in ascending order, which keeps to few pages at a time."""
        out, order = np.full(len(keys), np.nan), np.argsort(keys)
        keys = keys[order]
        bounds = np.searchsorted(keys, self.firsts)
        for (have, values), i, j in zip(self.parts, bounds, [*bounds[1:], len(keys)]):
            if i < j:
                at = np.minimum(have.find(keys[i:j]), len(have) - 1)
                out[order[i:j]] = np.where(have.at(at) == keys[i:j], values.at(at), np.nan)
        return out


class Model:
    def __init__(self, folder: str):
        self.p = [HashArray(folder, f"p{k}") for k in range(ORDER + 1)]
        self.b = [None, *[HashArray(folder, f"b{k}") for k in range(1, ORDER + 1)]]

    def bits(self, lang: str | None, grams: np.ndarray) -> np.ndarray:
        """- log2 of the probability of each row's last character after the others."""
        n = len(grams)
        total, open_ = np.zeros(n), np.arange(n)
        for k in range(ORDER, 0, -1):
            if not len(open_):
                break
            got = self.p[k].get(hashed(lang, grams[open_, ORDER - k:]))
            hit = ~np.isnan(got)
            total[open_[hit]] += got[hit]
            open_ = open_[~hit]
            if len(open_):
                back = self.b[k].get(hashed(lang, grams[open_, ORDER - k:-1]))
                total[open_] += np.nan_to_num(back, nan=0.0)
        if len(open_):
            total[open_] += np.nan_to_num(self.p[0].get(hashed(lang, np.empty((1, 0), np.uint32))), nan=-20.0)[0]
        return -total


@functools.lru_cache(maxsize=2)
def loaded(folder: str) -> Model:
    return Model(folder)


class Scorer:
    """Bits of texts; each distinct n-gram of a group of texts is looked up once."""

    def __init__(self, m: Model):
        self.model = m

    def total(self, lang: str | None, texts: list[str]) -> np.ndarray:
        """The sum of bits of each text."""
        out = np.zeros(len(texts))
        for group in _pieces(texts):
            mine = [texts[i] for i in group]
            alphabet, keys, which = _packed(mine)
            if len(alphabet) ** ORDER >= 1 << 64:
                for i, x in zip(group, mine):
                    rows, n = np.unique(_rows(x), axis=0, return_counts=True) if x else (np.empty((0, ORDER), np.uint32), np.empty(0))
                    out[i] = (self.model.bits(lang, rows) * n).sum()
                continue
            unique = np.unique(keys)
            bits = self.model.bits(lang, _grams(alphabet, unique))
            out[group] = np.bincount(which, bits[np.searchsorted(unique, keys)], len(mine))
        return out


# --- the rules ------------------------------------------------------------------------------------------------------------------------


def features(texts: list[str]) -> list[np.ndarray]:
    """FEATURES of a block of texts. Equal 3-word windows of one text are found by a 64-bit mix of the words' numbers."""
    n = len(texts)
    numbers: dict[str, int] = {}
    n_words, chars, symbols, lines = (np.zeros(n, np.int64) for _ in range(4))
    ids: list[int] = []
    for t, x in enumerate(texts):
        words = _WORDS.findall(x)
        n_words[t], chars[t] = len(words), sum(map(len, words))
        symbols[t] = sum(map(x.count, SYMBOLS))
        if "\n" in x:
            full = [y for y in x.split("\n") if y.strip(_SPACES)]
            lines[t] = len(full) - len(set(full))
        ids += [numbers.setdefault(w, len(numbers)) for w in words]
    flat, which = np.array(ids, np.uint64), np.repeat(np.arange(n), n_words)
    repeated = np.zeros(n, np.int64)
    if len(flat) >= 3:
        a, b, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)
        h = which[:-2].astype(np.uint64) * c
        for k in range(3):
            h = (h ^ flat[k:len(flat) - 2 + k] * a) * b
            h ^= h >> np.uint64(29)
        at = np.flatnonzero(which[:-2] == which[2:])
        order = at[np.argsort(h[at], kind="stable")]
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        covered = np.zeros(len(flat), bool)
        for k in range(3):
            covered[order[twice] + k] = True
        repeated = np.bincount(which[covered], minlength=n).astype(np.int64)
    return [n_words, chars, symbols, lines, repeated]


def score(df: DataFrame, folder: str, lang: str = "lang", text: str = "text") -> DataFrame:
    """df (without the text) with FEATURES and bits (mean per character; null for empty texts), by the model stored in folder."""
    keep = [f for f in df.schema if f.name not in (*FEATURES, "bits", text)]
    schema = T.StructType([*keep, *[T.StructField(n, T.LongType(), False) for n in FEATURES], T.StructField("bits", T.DoubleType())])

    def run(batches):
        scorer = Scorer(loaded(folder))
        for batch in batches:
            for part in blocks(batch, text):
                names = part.schema.names
                texts = [x or "" for x in part.column(names.index(text)).to_pylist()]
                bits, by = np.zeros(len(texts)), {}
                for i, language in enumerate(part.column(names.index(lang)).to_pylist()):
                    by.setdefault(language, []).append(i)
                for language, rows in by.items():
                    bits[rows] = scorer.total(language, [texts[i] for i in rows])
                size = np.array([len(x) for x in texts])
                mean = pa.array(bits / np.maximum(size, 1), mask=size == 0)
                yield pa.RecordBatch.from_arrays([*[part.column(names.index(f.name)) for f in keep], *map(pa.array, features(texts)), mean], names=[*[f.name for f in keep], *FEATURES, "bits"])
        tidy()

    return df.mapInArrow(run, schema)


def failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judge(df: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """(key, lang, FEATURES, bits, low, high, base_failed, kept) for each row of df."""
    spark = df.sparkSession
    rows = df.select(F.col(key), F.col(lang).cast("string").alias("_lang"), F.col(text).cast("string").alias("_text"))
    grams = materialise(counts(rows, "_lang", "_text"), "kn-grams")
    folder = shared_dir(spark, "kn-model")
    store(model(grams), folder)
    scored = materialise(score(rows, folder, "_lang", "_text").withColumn("base_failed", failed()), "quality-scores")
    quartiles = scored.where(~F.col("base_failed")).groupBy("_lang").agg(F.percentile_approx("bits", [0.25, 0.75], 10_000).alias("q"))
    width = F.greatest(F.get("q", F.lit(1)) - F.get("q", F.lit(0)), F.lit(FLOOR / SPREAD * 2)) * SPREAD
    bands = quartiles.select(F.col("_lang").alias("_b"), (F.get("q", F.lit(0)) - width).alias("low"), (F.get("q", F.lit(1)) + width).alias("high"))
    joined = scored.join(bands, F.col("_lang").eqNullSafe(F.col("_b")), "left").drop("_b")
    inside = F.coalesce(F.col("bits").between(F.col("low"), F.col("high")), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & inside).withColumnRenamed("_lang", "lang")
