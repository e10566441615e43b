"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The ranks come from a file that is a parameter; nothing is trained. A text is split by the pattern into pre-tokens.
Within a pre-token the next merge is that of the least rank, leftmost first. Positions wait in one bucket per rank; a
bitmap has a bit for each rank whose bucket holds any, in words of WORD bits, and a summary has a bit for each word in
use, so that the least rank is found by two find-first-set steps however long the pre-token is. Positions form a linked
list; entries of pairs that a merge has changed stay in their buckets and are skipped when they come up.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

RANKS_FILE = "byte_bpe_50k.tiktoken"
#: Pieces of text, pre-tokens among them, in each of a worker's two generations of kept ones.
CACHE_PIECES = 300_000
#: Longer pieces are encoded without being kept.
CACHE_CHARS = 64
#: Texts that are handled together.
TEXTS = 200

#: The white space of Unicode (property White_Space), as the pattern's \s has it.
_SPACE = "\t-\r \x85\xa0  -     　"
#: Cuts a text where no pre-token can reach across: before the last white-space character that precedes a word.
_PIECES = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Bits in a word of the bitmap: 1 << 8.
WORD = 256
_BIT = [1 << i for i in range(WORD)]


class Kept(dict):
    """Results of f for the keys met lately: when a generation is full, the one before it goes."""

    def __init__(self, f, most: int):
        self.f, self.most, self.before = f, most, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.f(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= self.most:
                self.before = dict(self)
                self.clear()
            self[key] = value
        return value


class Vocabulary:
    """Ranks of byte strings, and the encoding of texts by them. Ids are kept as 32-bit numbers laid end to end."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(self.ranks.values()) + 1
        self.bytes_of = [b""] * self.size
        for part, rank in self.ranks.items():
            self.bytes_of[rank] = part
        self.pattern = regex.compile(pattern.replace(r"\s\p{L}", _SPACE + r"\p{L}").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]"))
        self.single = [self.ranks[bytes((x,))] for x in range(256)]
        self.pairs = [self.ranks.get(bytes((x, y)), -1) for x in range(256) for y in range(256)]
        self.words = [0] * -(-self.size // WORD)
        self.known = Kept(self.encode_piece, CACHE_PIECES)

    def encode_piece(self, piece: str) -> bytes:
        """Ids of a piece, of one pre-token or more."""
        if not (piece.isalpha() or (piece[0] == " " and piece[1:].isalpha())):  # else it is one: a space and letters
            parts = self.pattern.findall(piece)
            if len(parts) > 1:
                return b"".join(map(self.known.__getitem__, parts))
        return self.merge(piece.encode())

    def merge(self, data: bytes) -> bytes:
        """Ids of one pre-token."""
        get, n = self.ranks.get, len(data)
        if (whole := get(data)) is not None:
            return whole.to_bytes(4, "little")
        end = list(range(1, n + 1))  # of the part that begins at each position
        before = list(range(-1, n - 1))
        part = list(map(self.single.__getitem__, data))  # id of the part that begins at each position
        pair = self.pairs
        now = [pair[x << 8 | y] for x, y in zip(data, data[1:])]  # rank of the pair that begins at each position, or -1
        now.append(-1)
        words, used, buckets = self.words, 0, {}  # the bitmap is empty between calls
        for i, r in enumerate(now):
            if r >= 0:
                if r in buckets:
                    buckets[r].append(i)  # in order, which is a heap
                else:
                    buckets[r] = [i]
                    words[r >> 8] |= _BIT[r & 255]
                    used |= 1 << (r >> 8)
        while used:
            w = (used & -used).bit_length() - 1
            word = words[w]
            low = word & -word
            rank = (w << 8) + low.bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                words[w] = word = word ^ low
                if not word:
                    used ^= 1 << w
            if now[i] != rank:
                continue  # stale
            part[i] = rank
            j = end[i]
            end[i] = k = end[j]
            now[j] = now[i] = -1
            if k < n:
                before[k] = i
                r = get(data[i : end[k]])
                if r is not None:
                    now[i] = r
                    if r in buckets:
                        heappush(buckets[r], i)
                    else:
                        buckets[r] = [i]
                        words[r >> 8] |= _BIT[r & 255]
                        used |= 1 << (r >> 8)
            if i:
                b = before[i]
                r = get(data[b:k])
                if r is None:
                    now[b] = -1
                else:
                    now[b] = r
                    if r in buckets:
                        heappush(buckets[r], b)
                    else:
                        buckets[r] = [b]
                        words[r >> 8] |= _BIT[r & 255]
                        used |= 1 << (r >> 8)
        out, i = array("i"), 0
        while i < n:
            out.append(part[i])
            i = end[i]
        return out.tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, _PIECES.findall(text)))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One for each worker process."""
    return C.keep_in_worker(("bpe", path, pattern), lambda: Vocabulary(path, pattern))


def encode(docs: DataFrame, *keep: str, path: str | None = None, pattern: str = public_tokenizers.PATTERN, decoded: bool = False) -> DataFrame:
    """The kept columns and ids (array<int>) of each row's whole text; a null text is empty and has no ids. decoded:
    also the bytes that the ids decode to, as decode() gives them, by the same worker.

    Texts need no other row, so rows are encoded where they are read: no shuffle, however long a text or however often
    one is repeated. path: the ranks' file, at the same place on every machine.
    """
    path = path or public_tokenizers.path(RANKS_FILE)
    C.short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for whole in batches:
            last = whole.num_columns - 1
            for at in range(0, len(whole), TEXTS):
                batch = whole.slice(at, TEXTS)
                ids = [v.encode(text or "") for text in batch.column(last).to_pylist()]
                each = np.array([len(x) // 4 for x in ids], np.int64)
                back = [pa.array([v.decode(np.frombuffer(x, "<i4")) for x in ids], pa.binary())] if decoded else []
                ids = C.list_column(np.frombuffer(b"".join(ids), "<i4"), each, pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns[:last], ids, *back], [*batch.schema.names[:last], "ids", "decoded"][: last + 1 + decoded])

    narrow = docs.select(*keep, F.col("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema[:-1])
    return narrow.mapInArrow(run, f"{schema}, ids array<int>" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """All columns and decoded (binary): the bytes that ids stand for. Null ids decode to no bytes."""
    path = path or public_tokenizers.path(RANKS_FILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, none = vocabulary(path, pattern), np.empty(0, np.int32)
        for whole in batches:
            for at in range(0, len(whole), TEXTS):
                batch = whole.slice(at, TEXTS)
                ids = batch.column(batch.schema.get_field_index("ids"))
                out = [v.decode(x.values.to_numpy() if x.is_valid else none) for x in ids]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{schema}, decoded binary")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode(docs, "doc_id", decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(C.table(spark, sf_dir, "documents"))


def op2_byte_bpe_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op2_byte_bpe that SQL can tell: decoding what was encoded gives the text."""
    return op2_byte_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


ORACLE_DECODED = "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents"
