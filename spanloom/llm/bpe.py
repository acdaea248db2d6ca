"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be bridged by a merge, so the text may be cut
between its two bytes and the fragments encoded one by one. The table of these pairs (256 x 256) is read off the vocabulary. A text's
bytes are looked up in it all at once; the cuts that it gives, and those of the tokenizer's pre-tokens, part the text into
fragments. Each fragment is encoded by itself, whatever its length, and the ids are joined. Fragments recur, so the ids of each distinct short one
are kept in a worker's look-up table, which CACHE_ENTRIES bounds.

Pre-tokens are found as the tokenizers library finds them (its own pre-tokenizer does it wherever characters occur whose Unicode class
depends on the version of the tables). Very long texts are worked off in chunks, cut before ASCII white space that follows another
character: no token spans such a pair, and the pre-tokenizer parts the text there whatever comes after.

Nulls encode and decode like the empty text, to no ids. Very long texts are cut like any other. There are no ties: rows are coded one by one, and
rows that are equal give equal ids. Empty tables give empty results. Extra columns are kept; a column that has the name of an output is replaced.
"""

from __future__ import annotations

import functools
import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spanloom.llm.common import tidy

CACHE_ENTRIES = 250_000
#: Longer fragments are encoded each time they occur, as they seldom recur.
CACHE_CHARS = 24
#: Longer texts are cut into chunks of about so many characters, at the next certain cut.
CHUNK_CHARS = 1_000_000

_SPACE = "\t-\r " + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_FRAGMENT = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_CUT = re.compile(f"(?<=[^{_SPACE}])(?=[\\t-\\r ])")
#: Characters whose Unicode classes are the same in every version of the tables, and the letters and numbers among them.
SETTLED = re.compile(r"[ \t\n\r!-~\xa1-\u024f]*")
LETTERS, NUMBERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc\xbd\xbe"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else U+0100 and up."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def forced_pairs(tokens) -> np.ndarray:
    """256 x 256 booleans: whether the byte pair occurs inside none of the tokens (bytes)."""
    forced = np.ones((256, 256), bool)
    for token in tokens:
        forced[list(token[:-1]), list(token[1:])] = False
    return forced


def byte_offsets(text: str) -> np.ndarray:
    """The UTF-8 byte offset of each character of the text, and of its end."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out = np.zeros(len(c) + 1, np.int64)
    np.cumsum(1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000), out=out[1:])
    return out


class Bounded(dict):
    """A look-up table from texts or bytes that computes what it lacks and starts afresh when full."""

    def __init__(self, compute):
        super().__init__()
        self._compute = compute

    def __missing__(self, key):
        value = self._compute(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[key] = value
        return value


def chunks(text: str):
    """The text in pieces of about CHUNK_CHARS, cut only before ASCII white space that follows another character."""
    at = 0
    while len(text) - at > CHUNK_CHARS and (cut := _CUT.search(text, at + CHUNK_CHARS)):
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class ByteBPE:
    """Encoder and decoder for a byte-level tokenizers file without normalizer (such as byte_bpe_50k.json)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["model"].get("dropout"):
            raise ValueError(f"{path}: a plain byte-level BPE tokenizer is needed")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens that strip or need word bounds aren't supported")
        self._tokenizer = Tokenizer.from_file(path)
        self._model, self._pre = self._tokenizer.model, self._tokenizer.pre_tokenizer
        alphabet = byte_alphabet()
        self._char = dict(enumerate(alphabet))
        back = {c: b for b, c in self._char.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self._bytes = {i: bytes(back[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.forced = forced_pairs(b for i, b in self._bytes.items() if i not in self.special.values())
        # Every pair of a character and ASCII white space after it must be forced for the cuts between chunks.
        space = [*range(9, 14), 32]
        wide = [b for b in range(256) if b not in space and not self.forced[b, space].all()]
        if any(b < 0x80 for b in wide):
            raise ValueError(f"{path}: tokens of the vocabulary run on into white space")
        self._fragments = Bounded(self._encoded)
        #: Fragments so far, and how many of their bounds were forced ones inside a pre-token.
        self.fragments = self.forced_cuts = 0

    def _encoded(self, fragment: bytes) -> bytes:
        """The ids of one fragment."""
        mapped = fragment.decode("latin-1").translate(self._char)
        return array("i", [t.id for t in self._model.tokenize(mapped)]).tobytes()

    def _pre_tokens(self, chunk: str, raw: bytes) -> np.ndarray:
        """Where the chunk's pre-tokens end, in bytes."""
        if SETTLED.fullmatch(chunk):
            ends = np.cumsum([len(x) for x in _PIECES.findall(chunk)])
            return ends if len(raw) == len(chunk) else byte_offsets(chunk)[ends]
        lengths = []
        for fragment in _FRAGMENT.findall(chunk):
            if SETTLED.fullmatch(fragment):
                lengths += [len(x.encode()) for x in _PIECES.findall(fragment)]
            else:  # the library shows each byte as one character
                lengths += [len(x) for x, _ in self._pre.pre_tokenize_str(fragment)]
        return np.cumsum(lengths)

    def cuts(self, chunk: str, raw: bytes) -> np.ndarray:
        """All bounds of fragments, 0 and the end included: of forced byte pairs and of pre-tokens."""
        data = np.frombuffer(raw, np.uint8)
        bound = np.zeros(len(raw) + 1, bool)
        bound[1:-1] = self.forced[data[:-1], data[1:]]
        forced = int(np.count_nonzero(bound))
        ends = self._pre_tokens(chunk, raw)
        self.forced_cuts += forced - int(np.count_nonzero(bound[ends]))
        bound[ends] = bound[0] = True
        return np.flatnonzero(bound)

    def _plain(self, text: str) -> bytes:
        out = []
        for chunk in chunks(text):
            if raw := chunk.encode():
                at = self.cuts(chunk, raw).tolist()
                self.fragments += len(at) - 1
                out += map(self._fragments.__getitem__, [raw[i:j] for i, j in zip(at, at[1:])])
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        """The ids (int32) that the library gives without special tokens of its own."""
        if self._special is None or not self._special.search(text):
            return np.frombuffer(self._plain(text), np.int32)
        parts = [array("i", [self.special[p]]).tobytes() if p in self.special else self._plain(p) for p in self._special.split(text)]
        return np.frombuffer(b"".join(parts), np.int32)

    def forget(self) -> None:
        """Empties the look-up table."""
        self._fragments.clear()

    def decode(self, ids) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD, unknown ids nothing."""
        get = self._bytes.get
        return b"".join([get(i, b"") for i in ids]).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> ByteBPE:
    """One codec for each file and worker process."""
    return ByteBPE(path)


def _replaced(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    keep = [i for i, n in enumerate(batch.schema.names) if n != name]
    return pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], values], names=[*[batch.schema.names[i] for i in keep], name])


#: Rows of a batch are worked off in blocks of about so many characters, which bounds a worker's memory.
BLOCK_CHARS = 2_000_000


def blocks(batch: pa.RecordBatch, column: str):
    """Slices of the batch of about BLOCK_CHARS bytes of the column, one row at least."""
    import pyarrow.compute as pc

    index = batch.schema.names.index(column)
    values = batch.column(index)
    if pa.types.is_list(values.type):
        size = np.asarray(pc.fill_null(pc.list_value_length(values), 0), dtype=np.int64) * 4
    else:
        size = np.asarray(pc.fill_null(pc.binary_length(values), 0), dtype=np.int64)
    total = np.cumsum(size + 64)
    start, n = 0, batch.num_rows
    while start < n:
        base = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, base + BLOCK_CHARS, "right")))
        yield batch.slice(start, end - start)
        start = end


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """df with the BPE ids of a text column as array<int>; with decoded, also a column of that name with the text that the ids decode to.

    Both in one pass keep one Python worker for each core; encode() and decode() in one stage keep two.
    """
    added = [T.StructField(out, T.ArrayType(T.IntegerType(), False), False), *([T.StructField(decoded, T.StringType(), False)] if decoded else [])]
    schema = T.StructType([*[f for f in df.schema if f.name not in (out, decoded)], *added])

    def run(batches):
        bpe = codec(path)
        for batch in batches:
            for part in blocks(batch, text):
                ids = [bpe.encode(x or "") for x in part.column(part.schema.names.index(text)).to_pylist()]
                at = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=at[1:])
                flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
                result = _replaced(part, out, pa.ListArray.from_arrays(pa.array(at), pa.array(flat, pa.int32())))
                yield _replaced(result, decoded, pa.array([bpe.decode(x.tolist()) for x in ids], pa.string())) if decoded else result
        bpe.forget()
        tidy()

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text of an id column."""
    schema = T.StructType([*[f for f in df.schema if f.name != out], T.StructField(out, T.StringType(), False)])

    def run(batches):
        bpe = codec(path)
        for batch in batches:
            for part in blocks(batch, ids):
                column = part.column(part.schema.names.index(ids))
                yield _replaced(part, out, pa.array([bpe.decode(x or ()) for x in column.to_pylist()], pa.string()))

    return df.mapInArrow(run, schema)
