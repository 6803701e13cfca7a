"""Token ids in files of directly addressable codes.

An id is split into chunks of CHUNK bits, least first. Level k holds the k-th chunks of all ids that have one,
in order, and a bitmap that says which of them go on to level k + 1; a rank directory counts the ones before
each word of 64 bits. So token i is found by following ranks: no other token is decoded.

A file is a table of containers of about TOKENS ids, written by Spark in ascending order of the documents.
Documents are range-partitioned by id and encoded where they land; a partition's first position is the sum
over the partitions before it, so only one number a partition is gathered.

Null and empty texts are just the end id. Null ids come first; rows with equal ids are in order of their
texts. An empty table gives an empty file. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medlode.llm.common import EXACT, batches, chunks, partitions, prepared, same_spans, shared_dir, span_hashes

CHUNK = 8
TOKENS = 1 << 20
#: Bytes of text that a partition of the file encodes, about.
PART_BYTES = 64 << 20
#: Pieces whose ids a worker remembers; beyond that it starts anew.
REMEMBERED = 1_000_000
END = 0

#: Byte classes: letters and all of non-ASCII, digits, white space, others, and the mark between texts.
_LETTER, _DIGIT, _SPACE, _OTHER, _MARK = range(5)
_CLASS = np.array([_MARK if c == 255 else _LETTER if c >= 128 or 65 <= c <= 90 or 97 <= c <= 122 else _DIGIT if 48 <= c <= 57 else _SPACE if c == 32 or 9 <= c <= 13 else _OTHER for c in range(256)], np.uint8)
#: Texts with these are left to the tokenizer as a whole: characters outside U+00C0 to U+024F, two of those
#: that are no letters, contractions, and what may be a special token.
_ODD = re.compile(rb"[\xc2\xca-\xff]|\xc3[\x97\xb7]|'[sdtmrvl]|<\|")


class Encoder:
    """Encodes texts with a tokenizers file of the byte-level kind.

    Such a tokenizer cuts a text into pieces (a run of letters, digits or others with a space before it, or
    white space) and merges inside each alone. So each different piece is encoded once and then looked up, by
    a hash of which the bytes are compared. Files of any other kind are left to the tokenizer as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_piece = cuts_into_pieces(json.load(f))
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.rows = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.first = np.zeros(1, np.int64)
        self.bytes = np.zeros(0, np.uint8)
        self.begin = np.zeros(1, np.int64)

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        """Encodes new pieces, in the order of their hashes."""
        marks = [k for k, p in enumerate(pieces) if p == b"\xff"]
        words = [p.decode() for p in pieces if p != b"\xff"]
        got = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        n, ids = np.bincount(np.array(got.word_ids, np.int64), minlength=len(words)), np.array(got.ids, np.uint32)
        for k in marks:
            ids, n = np.insert(ids, n[:k].sum(), END), np.insert(n, k, 1)
        at = np.searchsorted(self.keys, keys)
        self.rows = np.insert(self.rows, at, len(self.first) - 1 + np.arange(len(keys)))
        self.keys = np.insert(self.keys, at, keys)
        self.flat = np.concatenate([self.flat, ids])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(n)])
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(pieces), np.uint8)])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum([len(p) for p in pieces])])

    def _whole(self, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same by the tokenizer alone."""
        got = self.tokenizer.encode_batch_fast([b.decode("utf-8", "replace") for b in blobs], add_special_tokens=False)
        ids = [np.array([*e.ids, END], np.uint32) for e in got]
        return np.concatenate(ids), np.array([len(x) for x in ids])

    def encode(self, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (UTF-8), each followed by END, and how many each has."""
        out = [self._encode(blobs[i:j]) for i, j in chunks(blobs)]
        return np.concatenate([x for x, _ in out]), np.concatenate([n for _, n in out])

    def _encode(self, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_piece:
            return self._whole(blobs)
        if len(self.keys) > REMEMBERED:
            self._forget()
        odd = [k for k, b in enumerate(blobs) if _ODD.search(b)]
        plain = list(blobs)
        for k in odd:
            plain[k] = b""
        data = b"\xff".join([*plain, b""])
        arr = np.frombuffer(data, np.uint8)
        kind = _CLASS[arr]
        starts = np.empty(len(arr), bool)
        starts[0] = True
        starts[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _MARK)
        after = np.flatnonzero(starts[1:] & (kind[1:] != _MARK) & (kind[:-1] == _SPACE)) + 1
        starts[after - 1] = True
        starts[after[arr[after - 1] == 32]] = False
        begin = np.flatnonzero(starts)
        end = np.append(begin[1:], len(arr))
        keys, first, piece = np.unique(span_hashes(arr, begin, end), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)
        if not known.all():
            new = first[~known]
            self._learn(keys[~known], [data[a:z] for a, z in zip(begin[new].tolist(), end[new].tolist(), strict=True)])
            at = np.searchsorted(self.keys, keys)
        # where hashes aren't the bytes themselves, the bytes decide
        long = np.flatnonzero(end - begin > EXACT)
        known = self.rows[at][piece[long]]
        if not same_spans(arr, begin[long], end[long], self.bytes, self.begin[known], self.begin[known + 1]).all():
            return self._whole(blobs)
        row = self.rows[at][piece]
        n = self.first[row + 1] - self.first[row]
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(self.first[row] - ends + n, n) + np.arange(ends[-1])]
        sizes = np.diff(ends[arr[begin] == 255], prepend=0)
        if odd:
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for k, e in zip(odd, self.tokenizer.encode_batch_fast([blobs[k].decode("utf-8", "replace") for k in odd], add_special_tokens=False), strict=True):
                parts[k] = np.array([*e.ids, END], np.uint32)
                sizes[k] = len(parts[k])
            ids = np.concatenate(parts)
        return ids, sizes


def cuts_into_pieces(file: dict) -> bool:
    """Whether a tokenizers file cuts texts as Encoder does: plain byte-level, nothing before it."""
    cut = file.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    added = all(re.fullmatch(r"<\|.*", t["content"]) and not t.get("lstrip") and not t.get("rstrip") for t in file.get("added_tokens", []))
    return bool(plain) and not file.get("normalizer") and added


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for this file; what it has looked up serves later tasks too."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pack(ids: np.ndarray) -> bytes:
    """The levels of ids: for each its number of chunks, the chunks, the bitmap, and the rank directory."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> CHUNK > 0
        bits = np.packbits(more, bitorder="little").tobytes()
        bits += b"\0" * (-len(bits) % 8)
        ones = np.bitwise_count(np.frombuffer(bits, np.uint64)).astype(np.uint32)
        ranks = (np.cumsum(ones) - ones).astype(np.uint32)
        levels.append(struct.pack("<I", len(rest)) + (rest & ((1 << CHUNK) - 1)).astype(np.uint8).tobytes() + bits + ranks.tobytes())
        if not more.any():
            return struct.pack("<I", len(levels)) + b"".join(levels)
        rest = rest[more] >> CHUNK


class Codes:
    """Reads tokens of packed ids at any places."""

    def __init__(self, data: bytes):
        at, self.levels = 4, []
        for _ in range(struct.unpack_from("<I", data)[0]):
            (n,) = struct.unpack_from("<I", data, at)
            words = -(-n // 64)
            chunks = np.frombuffer(data, np.uint8, n, at + 4)
            bits = np.frombuffer(data[at + 4 + n : at + 4 + n + 8 * words], np.uint64)
            ranks = np.frombuffer(data[at + 4 + n + 8 * words : at + 4 + n + 12 * words], np.uint32)
            self.levels.append((chunks, bits, ranks))
            at += 4 + n + 12 * words

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def at(self, places: np.ndarray) -> np.ndarray:
        """The ids at these places."""
        places = np.asarray(places, np.int64)
        out, who = np.zeros(len(places), np.uint32), np.arange(len(places))
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            if not len(who):
                break
            out[who] |= chunks[places].astype(np.uint32) << np.uint32(CHUNK * k)
            word, bit = places >> 6, (places & 63).astype(np.uint64)
            own = bits[word] if len(bits) else np.zeros(0, np.uint64)
            more = (own >> bit) & np.uint64(1) > 0
            below = own & ((np.uint64(1) << bit) - np.uint64(1))
            places = (ranks[word] + np.bitwise_count(below))[more].astype(np.int64)
            who = who[more]
        return out


_FILE = "part int, seq int, doc_ids array<bigint>, sizes array<bigint>, start_in_part bigint, n_tokens bigint, codes binary"
_COLS = ["part", "seq", "doc_ids", "sizes", "start_in_part", "n_tokens", "codes"]


def _encode(path: str, tokens: int):
    def encode(source):
        from pyspark import TaskContext

        part, seq, start = TaskContext.get().partitionId(), 0, 0
        coder = encoder(path)
        ids, sizes, keys, held = [], [], [], 0

        def container():
            nonlocal seq, start, ids, sizes, keys, held
            values = ([part], [seq], [keys], [np.concatenate(sizes).tolist()], [start], [held], [pack(np.concatenate(ids))])
            kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary())
            seq, start = seq + 1, start + held
            ids, sizes, keys, held = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=_COLS)

        for b, texts in batches(source):
            got, n = coder.encode(texts)
            ids.append(got), sizes.append(n), keys.extend(b.column(0).to_pylist())
            held += len(got)
            if held >= tokens:
                yield container()
        if keys:
            yield container()

    return encode


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", tokens: int = TOKENS) -> None:
    """Writes the documents' ids to path, in ascending order of id."""
    spark = prepared(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = partitions(spark, size, PART_BYTES)
    dealt = own.repartitionByRange(count, F.col("id")).sortWithinPartitions("id", "text")
    dealt.mapInArrow(_encode(tokenizer, tokens), _FILE).write.parquet(path)


def read_containers(spark: SparkSession, path: str) -> DataFrame:
    """The containers of a file, with the position of their first token in the whole."""
    file = spark.read.schema(_FILE).parquet(path)
    parts = file.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    return file.join(F.broadcast(offsets), "part").withColumn("start", F.col("offset") + F.col("start_in_part"))


def _documents(source):
    for b in source:
        for keys, sizes, start, data in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            codes, ends = Codes(data), np.cumsum(sizes)
            firsts = ends - sizes
            crcs = [zlib.crc32(codes.at(np.arange(a, z)).astype("<u4").tobytes()) for a, z in zip(firsts, ends, strict=True)]
            kinds = pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(keys, kinds), pa.array(start + firsts, kinds), pa.array(sizes, kinds), pa.array(crcs, kinds)], names=["id", "start", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document of a file: id, start, n_tokens, ids_crc32."""
    own = read_containers(spark, path).select("doc_ids", "sizes", "start", "codes")
    return own.mapInArrow(_documents, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint").withColumnRenamed("id", id_col)


def _tokens(source):
    for b in source:
        for places, start, data in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(Codes(data).at(np.array(places) - start).astype(np.int64))], names=["place", "token"])


def read_tokens(spark: SparkSession, path: str, places: list[int]) -> DataFrame:
    """The tokens at these places of the whole: place, token. Only their containers are read out."""
    own = read_containers(spark, path)
    at = F.filter(F.array(*[F.lit(p).cast("long") for p in places]), lambda p: (p >= F.col("start")) & (p < F.col("start") + F.col("n_tokens")))
    return own.select(at.alias("places"), "start", "codes").where(F.size("places") > 0).mapInArrow(_tokens, "place bigint, token bigint")


def fresh_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
