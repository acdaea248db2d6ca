"""Token ids as length-delimited binary records.

A data file is a sequence of records::

    u64 length | u32 masked checksum of the length's 8 bytes | payload | u32 masked checksum of the payload

and a payload is ``i64 document id | u8 flags (1: the id is null, 2: tokens are 16 bits wide) | tokens``,
all little-endian. A checksum is the CRC-32 of zlib, rotated right by 15 bits and added to 0xA282EAD8,
so that data which holds checksums itself can't pass for a frame. Tokens are 16 bits wide if the vocabulary permits.

Beside the data files lies an offset index, a Parquet table (file, offset, length, doc_id, n_tokens), by
which a reader gets records in any order without scanning; see read().

Documents are written in ascending order of their ids (nulls first, ties by a hash of the text): range
partitions in order, each sorted and written by one task into a file named by its number. A file appears only when
it is whole, so a rerun task replaces it.

Null texts are empty: their record holds the end id alone. Rows that are equal give equal records, one each. Very long texts are encoded whole, in
chunks. An empty table gives an empty index. Only the key and the text of the input are used, whatever its other columns are called.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.bpe import LETTERS, NUMBERS, SETTLED, Bounded, blocks, byte_alphabet, chunks
from spanloom.llm.common import atomic_file, filesystem

_HEAD, _META = struct.Struct("<QI"), struct.Struct("<qB")
INDEX_SCHEMA = "file string, part int, offset long, length long, doc_id long, n_tokens long"
#: Byte ranges of one file that lie at most so far apart are read at once, up to READ_BYTES.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordBPE:
    """Encodes with a word-end BPE file of the tokenizers library (such as word_bpe_49k.json).

    Its normalizer and pre-tokenizer never look across white space. Texts of characters whose Unicode classes never
    change are cut into pre-tokens here, and each distinct one goes to the library's merges once per worker; the
    words of all other texts, and of those with special tokens, go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        steps = [(s["type"], s.get("content")) for s in (spec["normalizer"] or {}).get("normalizers", [])]
        pre = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self._plain = steps == [("NFC", None), ("Replace", " "), ("Lowercase", None)] and pre[0].get("pattern") == {"Regex": _SPLIT} and pre[0].get("behavior") == "Removed" and pre[0].get("invert") is True
        if not self._plain:
            raise ValueError(f"{path}: a lower-casing word BPE tokenizer is needed")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens that strip, hold spaces or need word bounds aren't supported")
        self._special = [t["content"] for t in spec["added_tokens"]]
        self.vocab_size = self._tokenizer.get_vocab_size(with_added_tokens=True)
        self._model, self._char = self._tokenizer.model, dict(enumerate(byte_alphabet()))
        self._pieces = Bounded(self._piece)
        self._words = Bounded(self._word)

    def _piece(self, piece: str) -> bytes:
        mapped = piece.encode().decode("latin-1").translate(self._char)
        return array("I", [t.id for t in self._model.tokenize(mapped)]).tobytes()

    def _word(self, word: str) -> bytes:
        return array("I", self._tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        out = []
        for chunk in chunks(text):
            # Lower-casing U+0130 makes a combining character, so such texts take the other way.
            if SETTLED.fullmatch(chunk) and "\u0130" not in chunk and not any(s in chunk for s in self._special):
                out += map(self._pieces.__getitem__, _PIECES.findall(chunk.lower()))
            else:
                out += map(self._words.__getitem__, _WORDS.findall(chunk))
        return np.frombuffer(b"".join(out), np.uint32)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordBPE:
    return WordBPE(path)


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, narrow: bool) -> bytes:
    flags = (doc_id is None) | narrow << 1
    payload = _META.pack(doc_id or 0, flags) + ids.astype("<u2" if narrow else "<u4").tobytes()
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked(size)) + payload + struct.pack("<I", masked(payload))


def unframe(data: memoryview, at: int = 0) -> tuple[int | None, np.ndarray, int]:
    """(document id, ids, where the next record starts); ValueError if a checksum is wrong or the record is cut short."""
    if len(data) < at + _HEAD.size:
        raise ValueError("record cut short")
    size, crc = _HEAD.unpack_from(data, at)
    if masked(bytes(data[at:at + 8])) != crc:
        raise ValueError("checksum of a record's length is wrong")
    start = at + _HEAD.size
    payload = bytes(data[start:start + size])
    if len(payload) < size or len(data) < start + size + 4:
        raise ValueError("record cut short")
    if masked(payload) != struct.unpack_from("<I", data, start + size)[0]:
        raise ValueError("checksum of a record is wrong")
    doc_id, flags = _META.unpack_from(payload)
    ids = np.frombuffer(payload, "<u2" if flags & 2 else "<u4", offset=_META.size).astype(np.uint32)
    return None if flags & 1 else doc_id, ids, start + size + 4


def write(df: DataFrame, folder: str, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes every text, appends end_id, and writes data files and the index into folder; returns the index."""

    def run(batches):
        from pyspark import TaskContext

        coder, part = encoder(path), TaskContext.get().partitionId()
        narrow = max(coder.vocab_size - 1, end_id) < 1 << 16
        end = np.array([end_id], np.uint32)
        name, at, rows = f"part-{part:06d}.rec", 0, []
        with atomic_file(f"{folder}/data", name) as stream:
            for batch in batches:
                for block in blocks(batch, text):
                    out = []
                    for doc_id, x in zip(block.column(0).to_pylist(), block.column(1).to_pylist()):
                        ids = np.concatenate([coder.encode(x or ""), end])
                        record = frame(doc_id, ids, narrow)
                        rows.append((at, len(record), doc_id, len(ids)))
                        at += len(record)
                        out.append(record)
                    stream.write(b"".join(out))
        for i in range(0, len(rows), 10_000):
            offset, length, doc_id, n = zip(*rows[i:i + 10_000])
            m = len(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * m), pa.array([part] * m, pa.int32()), pa.array(offset, pa.int64()), pa.array(length, pa.int64()), pa.array(doc_id, pa.int64()), pa.array(n, pa.int64())], names=["file", "part", "offset", "length", "doc_id", "n_tokens"])

    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered.mapInArrow(run, INDEX_SCHEMA).write.parquet(f"{folder}/index")
    return df.sparkSession.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index")


def ranges(offsets, lengths):
    """Coalesces sorted byte ranges: (start, length, number of records) for each read."""
    start = end = count = 0
    for offset, length in zip(offsets, lengths):
        if count and offset - end <= GAP_BYTES and offset + length - start <= READ_BYTES:
            end, count = max(end, offset + length), count + 1
        else:
            if count:
                yield start, end - start, count
            start, end, count = offset, offset + length, 1
    if count:
        yield start, end - start, count


def read(spark: SparkSession, folder: str, index: DataFrame | None = None) -> DataFrame:
    """The records of an index (all by default): file, part, offset, doc_id, ids (array<long>).

    Each file's records are read by one task, in order of their offsets, neighbouring ranges at once.
    """
    index = spark.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index") if index is None else index
    files = index.select("file").distinct().count()
    schema = "file string, part int, offset long, doc_id long, ids array<long>"

    def run(batches):
        for batch in batches:
            data = batch.to_pydict()
            names = data["file"]
            cut = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for i, j in zip(cut, cut[1:]):
                if i == j:
                    continue
                system, root = filesystem(f"{folder}/data")
                with system.open_input_file(f"{root}/{names[i]}") as source:
                    at = i
                    for start, length, count in ranges(data["offset"][i:j], data["length"][i:j]):
                        view = memoryview(source.read_at(length, start))
                        got = [unframe(view, data["offset"][k] - start)[:2] for k in range(at, at + count)]
                        bounds = np.zeros(count + 1, np.int32)
                        np.cumsum([len(x) for _, x in got], out=bounds[1:])
                        ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([x for _, x in got]).astype(np.int64)))
                        yield pa.RecordBatch.from_arrays([pa.array(names[at:at + count]), pa.array(data["part"][at:at + count], pa.int32()), pa.array(data["offset"][at:at + count], pa.int64()), pa.array([d for d, _ in got], pa.int64()), ids], names=["file", "part", "offset", "doc_id", "ids"])
                        at += count

    spread = index.repartition(max(1, files), "file").sortWithinPartitions("file", "offset")
    return spread.mapInArrow(run, schema)


def starts(index: DataFrame) -> DataFrame:
    """(part, before): the tokens of all earlier files. One row per file, so one task can sum them up."""
    from pyspark.sql import Window

    per = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return per.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))


def digest(records: DataFrame) -> DataFrame:
    """(file, part, offset, doc_id, n_tokens, ids_crc32) of records read back."""
    schema = T.StructType([*records.drop("ids").schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.names.index("ids"))
            at = ids.offsets.to_numpy()
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(at, at[1:])]
            kept = [i for i, n in enumerate(batch.schema.names) if n != "ids"]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], names=[*[batch.schema.names[i] for i in kept], "n_tokens", "ids_crc32"])

    return records.mapInArrow(run, schema)
