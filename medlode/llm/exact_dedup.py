"""Exact deduplication over a cuckoo-filter index of live digests.

Texts are equal when identical after lower-casing A-Z. Each task combines its rows to one entry a digest before
the shuffle, so a digest that a third of all rows share reaches its bucket as an entry a task. A bucket of
digests is absorbed by a CuckooIndex. What it decided meets the rows by digest; the few digests that more than
one row in HOT_SHARE has are broadcast, so that no task gets all rows of one.

Nulls and empty texts are one group. Null ids rank below all others; of repeated rows with the largest id
one stays. Empty tables give empty results. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medlode.llm.common import batches, lower_ascii, partitions, prepared, stash, text_bytes

SLOTS = 4
KICKS = 200
#: Digests that one task's index holds, about.
BUCKET_ROWS = 500_000
#: Digests of more than a share of 1 / HOT_SHARE of all rows, at most so many, are broadcast.
HOT_SHARE = 10_000
#: Entries that a task combines at once.
COMBINED = 200_000


class CuckooIndex:
    """Live digests with a payload each: a cuckoo filter before bucketed content.

    A lookup reads the two filter buckets of a digest; only if its fingerprint is there is the content bucket
    read, and whole digests compared. Deletion takes the fingerprint out again. When an insertion can't place a
    fingerprint, the filter doubles and is filled anew from the stored keys. `reads` counts content reads.
    """

    def __init__(self, buckets: int = 1024):
        self.size = self.reads = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.buckets = buckets
        self.table = [0] * (buckets * SLOTS)
        self.content: list[list[tuple[bytes, list]]] = [[] for _ in range(buckets)]
        self.spin = 1

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:10], "little") & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995) & (self.buckets - 1))

    def maybe(self, digest: bytes) -> bool:
        """Whether the filter holds the digest's fingerprint: never false for a live digest."""
        mark, a, b = self._places(digest)
        t = self.table
        return mark in t[a * SLOTS : a * SLOTS + SLOTS] or mark in t[b * SLOTS : b * SLOTS + SLOTS]

    def _find(self, digest: bytes) -> int:
        """The digest's place in its content bucket, -1 if it isn't live; the filter answers most misses."""
        if not self.maybe(digest):
            return -1
        self.reads += 1
        return next((k for k, (d, _) in enumerate(self.content[self._places(digest)[1]]) if d == digest), -1)

    def get(self, digest: bytes) -> list | None:
        """The payload of a live digest; a hit of the filter is verified against the content."""
        k = self._find(digest)
        return None if k < 0 else self.content[self._places(digest)[1]][k][1]

    def insert(self, digest: bytes, payload: list) -> None:
        home, k = self.content[self._places(digest)[1]], self._find(digest)
        if k >= 0:
            home[k] = (digest, payload)
            return
        home.append((digest, payload))
        self.size += 1
        if not self._place(digest):
            self.resize(self.buckets * 2)

    def delete(self, digest: bytes) -> bool:
        """Takes a live digest out; False if it isn't live."""
        k = self._find(digest)
        if k < 0:
            return False
        mark, *places = self._places(digest)
        del self.content[places[0]][k]
        self.size -= 1
        for bucket in places:
            for k in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.table[k] == mark:
                    self.table[k] = 0
                    return True
        raise AssertionError("a live digest has no fingerprint")

    def _place(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        for bucket in (a, b):
            for k in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.table[k]:
                    self.table[k] = mark
                    return True
        bucket = b
        for _ in range(KICKS):
            self.spin = (self.spin * 1103515245 + 12345) & 0x7FFFFFFF
            k = bucket * SLOTS + (self.spin >> 16) % SLOTS
            mark, self.table[k] = self.table[k], mark
            bucket = self._other(bucket, mark)
            for k in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.table[k]:
                    self.table[k] = mark
                    return True
        return False

    def resize(self, buckets: int) -> None:
        """A filter of at least so many buckets, filled from the stored keys."""
        stored = list(self.items())
        while True:
            self._clear(buckets)
            for entry in stored:
                self.content[self._places(entry[0])[1]].append(entry)
            if all(self._place(d) for d, _ in stored):
                return
            buckets *= 2

    def absorb(self, digest: bytes, row: tuple, n: int) -> None:
        """Merges n more rows of a digest; the largest row stays."""
        live = self.get(digest)
        if live is None:
            self.insert(digest, [row, n])
        else:
            live[1] += n
            if row > live[0]:
                live[0] = row

    def items(self) -> Iterator[tuple[bytes, list]]:
        for home in self.content:
            yield from home


_LOW = -(1 << 63)
_ENTRY = "digest binary, keep_id bigint, keep_row bigint, n bigint"


def _digests(source):
    for b, texts in batches(source):
        got = [hashlib.sha256(lower_ascii(t)).digest() for t in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.binary())], names=["row", "id", "digest"])


def _entries(found) -> pa.RecordBatch:
    rows = [(d, None if v[0][0] == _LOW else v[0][0], v[0][1], v[1]) for d, v in found]
    cols = list(zip(*rows, strict=True)) or [[], [], [], []]
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["digest", "keep_id", "keep_row", "n"])


def _combine(source):
    found: dict[bytes, list] = {}
    for b in source:
        for row, key, digest in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            rank = (_LOW if key is None else key, row)
            if (v := found.get(digest)) is None:
                found[digest] = [rank, 1]
            else:
                v[1] += 1
                v[0] = max(v[0], rank)
        # a digest that most rows share is there again soon, others seldom
        if len(found) > COMBINED:
            yield _entries(found.items())
            found = {}
    if found:
        yield _entries(found.items())


def _absorb(source):
    index = CuckooIndex()
    for b in source:
        for digest, key, row, n in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            index.absorb(digest, (_LOW if key is None else key, row), n)
    found = list(index.items())
    for at in range(0, len(found), 20_000):
        yield _entries(found[at : at + 20_000])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    spark = prepared(docs.sparkSession)
    slim = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text")
    )
    slim = stash(slim.mapInArrow(_digests, "row bigint, id bigint, digest binary"), "digests")
    rows = slim.count()
    found = slim.mapInArrow(_combine, _ENTRY).repartition(partitions(spark, rows, BUCKET_ROWS), F.col("digest")).mapInArrow(_absorb, _ENTRY)
    copies = stash(found.where("n > 1"), "copies")
    most = max(1, rows // HOT_SHARE)
    hot = F.broadcast(copies.where(F.col("n") > most).select("digest", *[F.col(c).alias(f"hot_{c}") for c in ("keep_id", "keep_row", "n")]))
    joined = slim.join(hot, "digest", "left")
    # rows of hot digests have what they need: they go to any task of the next join
    cold = copies.where(F.col("n") <= most).withColumnRenamed("digest", "d")
    key = F.when(F.col("hot_n").isNull(), F.col("digest")).otherwise(F.unhex(F.sha2(F.concat("digest", F.col("row").cast("string").cast("binary")), 256)))
    joined = joined.withColumn("key", key).join(cold, (F.col("key") == F.col("d")) & F.col("hot_n").isNull(), "left")
    joined = joined.select("row", "id", "digest", *[F.coalesce(f"hot_{c}", c).alias(c) if c != "keep_id" else F.when(F.col("hot_n").isNull(), F.col(c)).otherwise(F.col(f"hot_{c}")).alias(c) for c in ("keep_id", "keep_row", "n")])
    return joined.select(
        F.col("id").alias(id_col),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def apply_changes(live: DataFrame, inserted: DataFrame, deleted: DataFrame) -> DataFrame:
    """The live digests after deletions, then insertions; each frame has a column `digest` (binary).

    The three sides meet by digest; a task's index takes them in that order. Deleting a digest that isn't
    live, and inserting one that is, change nothing.
    """
    step = lambda df, k: df.select(F.col("digest"), F.lit(k).alias("step")).distinct()
    every = step(live, 0).unionByName(step(deleted, 1)).unionByName(step(inserted, 2))
    return every.repartition(F.col("digest")).sortWithinPartitions("step").mapInArrow(_change, "digest binary")


def _change(source):
    index = CuckooIndex()
    for b in source:
        for digest, step in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if step == 1:
                index.delete(digest)
            elif index.get(digest) is None:
                index.insert(digest, [(0, 0), 1])
    yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in index.items()], pa.binary())], names=["digest"])
