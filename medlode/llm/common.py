"""What the text operators share: the shared folder, Arrow batches and vectorised words."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of an Arrow batch; with texts of a few KB a batch is a few MB.
BATCH_ROWS = 512
#: Bytes of text that are worked on at once inside a task.
CHUNK_BYTES = 1 << 21

_LOWER_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PRIME = 0x9E3779B97F4A7C15
_U = np.uint64


def prepared(spark: SparkSession) -> SparkSession:
    """Keeps the session's Arrow batches small, so that a worker's memory is bounded by texts, not rows.

    How Spark cuts files depends on the cores it has at that time, unless a least number of pieces is set. It
    is set here: row numbers by place in a scan must stay the same when executors are lost between two scans.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", spark.conf.get("spark.sql.shuffle.partitions"))
    # a join of few rows with all texts drops the other texts before the shuffle
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "10MB")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, one in the warehouse.

    A warehouse on a local disk is shared only if driver and executors are one machine, else this is an error.
    """
    own = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own
    house = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and (":" not in house or house.startswith("file:")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return house + "/_medlode"


_stashed: list[str] = []


def stash(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/stash/{name}-{uuid.uuid4().hex}"
    _stashed.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Deletes all that this process has stashed. Only for callers that have written their results."""
    while _stashed:
        delete(spark, _stashed.pop())


def text_bytes(text: str = "text") -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(text).cast("string").cast("binary"), F.lit(b""))


def extended(schema: StructType, without: tuple[str, ...], more: str) -> StructType:
    """The fields of a schema but those named, whatever their names, and then more, given as DDL."""
    return StructType([f for f in schema if f.name not in without] + StructType.fromDDL(more).fields)


def partitions(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions for so many rows, at least as many as the session shuffles into."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def lower_words(data: bytes) -> bytes:
    """A-Z lower-cased; each byte that is no digit, letter or part of a non-ASCII character becomes a space."""
    return data.translate(_LOWER_WORDS)


def lower_ascii(data: bytes) -> bytes:
    return data.translate(_LOWER)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
        return h ^ (h >> _U(31))


#: Two primes below 2^31 and a base for each: words are hashed modulo both, which no fixed pattern of bytes defeats
#: as it does arithmetic modulo 2^64.
_LANES = ((2147483647, 1103515245), (2147483629, 1566083941))
_STRETCH = 1 << 16
_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(n: int, lane: int, down: bool) -> np.ndarray:
    """The first n powers of a lane's base, or of its inverse."""
    have = _powers.get((lane, down))
    if have is None or len(have) < n:
        prime, base = _LANES[lane]
        step, have = pow(base, -1, prime) if down else base, np.ones(1, _U)
        while len(have) < max(n, 1 << 16):
            have = np.concatenate([have, have * _U(pow(step, len(have), prime)) % _U(prime)])
        _powers[lane, down] = have
    return have[:n]


#: Spans of so many bytes at most have different hashes.
EXACT = 7


def span_hashes(arr: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each arr[start:end].

    Those of short spans are their bytes, spread. Equal hashes of different longer spans are unlikely, not
    impossible: where it matters, same_spans compares them.
    """
    size = ends - starts
    key = np.minimum(size, EXACT).astype(_U) << _U(56)
    padded = np.concatenate([arr, np.zeros(EXACT, np.uint8)])
    for k in range(EXACT):
        key |= (padded[starts + k] * (size > k)).astype(_U) << _U(8 * k)
    long = np.flatnonzero(size > EXACT)
    if len(long):
        key[long] = _long_hashes(arr, starts[long], size[long])
    return mix(key)


def _flat(starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the bytes of spans are, one span after the other, and where each begins there."""
    first = np.cumsum(size) - size
    return np.repeat(starts - first, size) + np.arange(size.sum()), first


def _long_hashes(arr: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """From prefix sums modulo two primes; the highest bit is set."""
    at, first = _flat(starts, size)
    data, lanes = arr[at].astype(_U) + _U(1), []
    for lane, (prime, _) in enumerate(_LANES):
        up, carry = _power(len(data), lane, False), _U(0)
        prefix = np.zeros(len(data) + 1, _U)
        for k in range(0, len(data), _STRETCH):
            part = np.cumsum(data[k : k + _STRETCH] * up[k : k + _STRETCH]) + carry
            prefix[k + 1 : k + 1 + len(part)] = part
            carry = part[-1] % _U(prime)
        span = (prefix[first + size] % _U(prime) + _U(prime) - prefix[first] % _U(prime)) % _U(prime)
        lanes.append(span * _power(len(data) + 1, lane, True)[first] % _U(prime))
    with np.errstate(over="ignore"):
        return mix((lanes[0] << _U(31) | lanes[1]) ^ (size.astype(_U) * _U(_PRIME))) | _U(1 << 63)


def same_spans(a: np.ndarray, a_starts: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Which spans a[start:end] have the same bytes as b[start:end] at the same place of the lists."""
    size = a_ends - a_starts
    same = size == b_ends - b_starts
    for part in np.array_split(np.flatnonzero(same & (size > 0)), max(1, int(size.sum()) >> 20)):
        if len(part):
            at, first = _flat(a_starts[part], size[part])
            differ = a[at] != b[_flat(b_starts[part], size[part])[0]]
            same[part] = ~np.logical_or.reduceat(differ, first)
    return same


def chunks(blobs: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of blobs with about `most` bytes each; a larger blob is a range of its own."""
    first = size = 0
    for i, b in enumerate(blobs):
        if i > first and size + len(b) > most:
            yield first, i
            first, size = i, 0
        size += len(b)
    if len(blobs) > first:
        yield first, len(blobs)


def _pieces(blob: bytes, most: int) -> list[bytes]:
    """Cuts a long blob after separators, so that no word is cut."""
    out, at = [], 0
    while len(blob) - at > most:
        cut = blob.rfind(b" ", at, at + most) + 1 or (blob.find(b" ", at + most) + 1 or len(blob))
        out.append(blob[at:cut])
        at = cut
    return [*out, blob[at:]]


def word_hashes(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all blobs (already cut by lower_words), and the first word of each blob.

    Returns (hashes, offsets): blob i has hashes[offsets[i]:offsets[i + 1]].
    """
    hashes, counts = [], []
    for i, j in chunks(blobs):
        parts = [(k, p) for k in range(i, j) for p in _pieces(blobs[k], 2 * CHUNK_BYTES)]
        n = np.zeros(j - i, dtype=np.int64)
        for a, b in chunks([p for _, p in parts], 2 * CHUNK_BYTES):
            arr, starts, ends, firsts = word_spans([p for _, p in parts[a:b]])
            hashes.append(span_hashes(arr, starts, ends))
            np.add.at(n, np.array([k for k, _ in parts[a:b]]) - i, np.diff(firsts))
        counts.append(n)
    total = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return (np.concatenate(hashes) if hashes else np.zeros(0, _U)), np.concatenate([[0], np.cumsum(total)])


def word_spans(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All blobs as one array of bytes, where each word begins and ends in it, and the first word of each blob."""
    arr = np.frombuffer(b" ".join([b"", *blobs, b""]), np.uint8)
    is_word = arr != 32
    edges = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
    begins = np.cumsum([1, *(len(b) + 1 for b in blobs)])
    return arr, edges[::2], edges[1::2], np.searchsorted(edges[::2], begins)


def word_numbers(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word of all blobs, equal only for equal words, and the first word of each blob."""
    arr, starts, ends, offsets = word_spans(blobs)
    _, first, number = np.unique(span_hashes(arr, starts, ends), return_index=True, return_inverse=True)
    long = np.flatnonzero(ends - starts > EXACT)
    kept = first[number[long]]
    if not same_spans(arr, starts[long], ends[long], arr, starts[kept], ends[kept]).all():
        data, known = arr.tobytes(), {}
        number = np.array([known.setdefault(data[a:z], len(known)) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
    return number, offsets


def gram_numbers(numbers: np.ndarray, n: int) -> np.ndarray:
    """A number for each n-gram of consecutive numbers, equal only for equal n-grams."""
    if len(numbers) < n:
        return np.zeros(0, np.int64)
    own, width = numbers.astype(np.int64), 1
    while width < n:
        step = min(width, n - width)
        size = len(own) - step
        own = np.unique(own[:size] * (int(own.max()) + 1) + own[step:], return_inverse=True)[1]
        width += step
    return own


def gram_hashes(words: np.ndarray, n: int, firsts: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the n-grams of consecutive word hashes: of all, or of those that begin at firsts."""
    if len(words) < n:
        return np.zeros(0, _U)
    part = lambda k: words[k : len(words) - n + 1 + k] if firsts is None else words[firsts + k]
    with np.errstate(over="ignore"):
        h = part(0).copy()
        for k in range(1, n):
            h = h * _U(0x100000001B3) + part(k)
        return mix(h)


def batches(source: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches with rows, and the bytes of their column `text`."""
    for b in source:
        if b.num_rows:
            yield b, b.column(b.schema.get_field_index("text")).to_pylist()
