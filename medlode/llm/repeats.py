"""Removal of repeated byte strings by per-shard suffix arrays.

Each byte covered by a string of LENGTH bytes that also starts elsewhere (same text included) is removed.

1. Of the GRAM-byte hashes inside each LENGTH-byte window the least is the window's anchor (the leftmost of
   equals). Equal windows have equal anchors at equal places, so only anchors whose hash occurs twice matter,
   and the windows of one hash meet. Equal texts are one class, of which one row goes on.
2. Candidate texts give a context for each such anchor: the bytes of the windows it stands for. Equal contexts
   of a hash are combined, by a digest of 128 bits, to one with a count; one that occurs twice repeats as a
   whole. Hashes with several different contexts go on, with one of each.
3. Contexts are dealt to tasks by hash and cut into shards of about SHARD_BYTES. A shard becomes a suffix array by
   Larsson-Sadakane refinement in numpy: ranks of 7 bytes, then doubled, of which only groups that are still
   tied are sorted again, until all are told apart. Kasai's scan gives the common prefixes of neighbours, for
   all contexts at once, a byte further each step; those of LENGTH bytes or more are repeats. A hash that lies
   in several shards is merged by binary search of each one's sorted windows in the others'.
4. A hash with more than LIMIT different contexts isn't left to one task. The places that a window can have
   around its anchor are cut in two, and the bytes that all windows of a half share become the key under which
   they meet, again and again; in the end a key is a window's whole bytes. So a hash of any number of contexts
   is spread, and nothing is decided by hash alone.

Null texts are empty; texts shorter than LENGTH keep all. Repeated rows are copies. Empty tables give none.
Positions are bytes of UTF-8, so what is kept of a character may be a part. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medlode.llm.common import batches, mix, partitions, prepared, stash, text_bytes

LENGTH = 200
GRAM = 48
#: Different contexts of a hash up to which one task gets them all.
LIMIT = 2048
#: Rows of spare copies that are broadcast (8 bytes each); more of them meet the anchors by shuffle.
SPARE = 1_000_000
#: Bytes of contexts that one suffix array holds, about; bytes of text whose windows are hashed at once.
SHARD_BYTES = 1 << 20
PART_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        steps = np.full(PART_BYTES + 2 * LENGTH + 2, base, dtype=np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _spans_hash(arr: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of all arr[s:s + length]. Only anchors are chosen by them; contents decide."""
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(arr) + 1, np.uint64)
        np.cumsum((arr.astype(np.uint64) + np.uint64(1)) * _UP[: len(arr)], out=prefix[1:])
        return mix((prefix[length:] - prefix[:-length]) * _DOWN[: len(arr) - length + 1])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Hash, place, and first and last window (by where it starts) of each anchor."""
    parts = []
    width = length - gram + 1
    for at in range(0, max(len(text) - length + 1, 0), PART_BYTES):
        arr = np.frombuffer(text[at : at + PART_BYTES + length - 1], np.uint8)
        h = _spans_hash(arr, gram)
        place = _least((h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), width) & np.uint64(0xFFFFFFFF)
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        spot = place[first].astype(np.int64)
        last = np.append(first[1:], len(place)) - 1
        parts.append((h[spot].astype(np.int64), spot + at, first + at, last + at))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def suffix_array(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The suffixes of texts laid end to end, each to the end of its own text, in order.

    Of equal suffixes that of the later text comes first, and a suffix before those it begins.
    """
    n = len(data)
    who, left = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.cumsum(sizes), sizes) - np.arange(n)
    # the first 7 bytes, 0 beyond the end, and how many of them there are
    key = _words(data, n) & ~np.uint64(0xFF)
    last = np.flatnonzero(left < 7)
    key[last] &= ~np.uint64(0) << (np.uint64(64) - np.uint64(8) * left[last].astype(np.uint64))
    key |= np.minimum(left, 7).astype(np.uint64)
    order = np.argsort(key)
    rank = np.empty(n, np.int64)
    rank[order] = _first_of_equals(key[order])
    have, spots = 7, np.arange(n)
    while len(spots):
        # spots of `order` whose suffixes share a rank with a neighbour
        own = rank[order[spots]]
        same = own[1:] == own[:-1]
        spots = spots[np.append(same, False) | np.append(False, same)]
        at = order[spots]
        more = left[at] > have
        further = np.where(more, rank[np.where(more, at + have, 0)], -1) + len(sizes)
        further[~more] = len(sizes) - 1 - who[at[~more]]
        key = rank[at] * (n + len(sizes)) + further
        again = np.argsort(key)
        order[spots] = at[again]
        key = key[again]
        rank[at[again]] = spots[_first_of_equals(key)]
        have *= 2
    return order


def _words(data: np.ndarray, n: int) -> np.ndarray:
    """The 8 bytes from each of n places on as a number, 0 beyond the end."""
    padded, out = np.zeros(n + 8, np.uint8), np.zeros(n, np.uint64)
    padded[: len(data)] = data
    for k in range(8):
        out <<= np.uint64(8)
        out |= padded[k : n + k]
    return out


def _first_of_equals(keys: np.ndarray) -> np.ndarray:
    """For each of some keys in order the place of the first that equals it."""
    return np.maximum.accumulate(np.where(np.append(True, keys[1:] != keys[:-1])[: len(keys)], np.arange(len(keys)), 0))


def common_prefixes(data: np.ndarray, sizes: np.ndarray, order: np.ndarray, most: int, scan: np.ndarray) -> np.ndarray:
    """For each suffix how many bytes it shares with the one before it in order, `most` at most.

    Kasai's scan: a suffix shares at least one byte less with its neighbour than the suffix a byte before it.
    All texts are scanned at once, 8 bytes at a time, the first `scan` suffixes of each; others stay 0.
    """
    n = len(data)
    out, before = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    left = np.minimum(np.repeat(np.cumsum(sizes), sizes) - np.arange(n), most)
    words = _words(data, n + most)
    texts = np.argsort(-scan, kind="stable")
    firsts, ends = (np.cumsum(sizes) - sizes)[texts], scan[texts]
    shared = np.zeros(len(texts), np.int64)
    for step in range(int(ends[0]) if len(ends) else 0):
        live = np.searchsorted(-ends, -step)
        i = firsts[:live] + step
        j = before[i]
        bound = np.where(j >= 0, np.minimum(left[i], left[j]), 0)
        size = np.minimum(np.maximum(shared[:live] - 1, 0), bound)
        at = np.flatnonzero(size < bound)
        own, other, reach, end = i[at], j[at], size[at], bound[at]
        open_ = np.arange(len(at))
        while len(open_):
            open_ = open_[words[own[open_] + reach[open_]] == words[other[open_] + reach[open_]]]
            reach[open_] += 8
            open_ = open_[reach[open_] < end[open_]]
        short = np.flatnonzero(reach < end)
        differ = words[own[short] + reach[short]] ^ words[other[short] + reach[short]]
        for k in range(1, 8):
            reach[short] += differ >> np.uint64(8 * k) == 0
        size[at] = np.minimum(reach, end)
        shared[:live] = size
        out[i] = size
    return out


_PLACE = ("h", "at", "lo", "hi")
_ANCHORS = "array<struct<h:bigint,at:bigint,lo:bigint,hi:bigint>>"


def _lists(sizes: list[int], cols: list[np.ndarray]) -> pa.Array:
    inner = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], names=list(_PLACE))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), inner)


def _slim(length: int):
    def slim(source):
        for b, texts in batches(source):
            found = [anchors(t, length, min(GRAM, length)) for t in texts]
            cols = [np.concatenate([f[k] for f in found]) for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), _lists([len(f[0]) for f in found], cols)],
                names=["row", "id", "n_bytes", "sha", "anchors"],
            )

    return slim


_MARKS = "row bigint, h bigint, at bigint, lo bigint, hi bigint, n bigint, digest binary"


def _digest(size: int, *parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=size).digest()


def _marks(length: int, halves: list[tuple[int, int]] | None):
    """The anchors of texts, with a digest of each context.

    With halves (least and largest place of the anchor in a window) contexts are cut into those, and each
    part's key is made from the old one and the bytes that all windows of the half share.
    """

    def marks(source):
        for b, texts in batches(source):
            out = [[] for _ in range(7)]
            for row, own, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts, strict=True):
                for x in own:
                    h, at = x["h"], x["at"]
                    parts = [(h, x["lo"], x["hi"])]
                    if halves is not None:
                        parts = [(d, e, max(x["lo"], at - e), min(x["hi"], at - d)) for d, e in halves]
                        parts = [(int.from_bytes(_digest(8, b"%d,%d:" % (h, d), t[at - d : at - e + length]), "little", signed=True), lo, hi) for d, e, lo, hi in parts if lo <= hi]
                    for key, lo, hi in parts:
                        # where the anchor lies in the context counts too
                        values = (row, key, at, lo, hi, x.get("n", 1), _digest(16, b"%d:" % (at - lo), t[lo : hi + length]))
                        for o, v in zip(out, values, strict=True):
                            o.append(v)
            if out[0]:
                kinds = [pa.int64()] * 6 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=["row", *_PLACE, "n", "digest"])

    return marks


def _contexts(length: int):
    def contexts(source):
        for b, texts in batches(source):
            out = [[], [], [], []]
            for row, own, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts, strict=True):
                for x in own:
                    out[0].append(x["h"]), out[1].append(row), out[2].append(x["lo"]), out[3].append(t[x["lo"] : x["hi"] + length])
            if out[0]:
                kinds = [pa.int64()] * 3 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=["h", "row", "lo", "text"])

    return contexts


def _runs(rows: np.ndarray, starts: np.ndarray, length: int) -> pa.RecordBatch:
    """Covered spans of windows of equal length, joined where neighbours touch."""
    order = np.lexsort((starts, rows))
    rows, starts = rows[order], starts[order]
    new = np.append(True, (rows[1:] != rows[:-1]) | (starts[1:] > starts[:-1] + length)) if len(rows) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rows)) - 1 if len(first) else first
    return pa.RecordBatch.from_arrays([pa.array(rows[first]), pa.array(starts[first]), pa.array(starts[last] + length)], names=["row", "a", "z"])


class Shard:
    """A suffix array of contexts (key, row, place in the row, bytes), and which of its windows repeat."""

    def __init__(self, rows: list[tuple[int, int, int, bytes]], length: int):
        self.length, self.keys = length, np.array([r[0] for r in rows], np.int64)
        data = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
        sizes = np.array([len(r[3]) for r in rows])
        self.data = data
        order = suffix_array(data, sizes)
        equal = common_prefixes(data, sizes, order, length, sizes - length + 1)[order] >= length
        hit = np.zeros(len(data), bool)
        hit[order] = equal | np.append(equal[1:], False)
        self.firsts = np.cumsum(sizes) - sizes
        n = sizes - length + 1
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.who, self.starts = np.repeat(np.arange(len(rows)), n), np.repeat(self.firsts, n) + inner
        self.hit = hit[self.starts]
        self.row = np.array([r[1] for r in rows], np.int64)[self.who]
        self.place = np.array([r[2] for r in rows], np.int64)[self.who] + inner
        # windows in order, for the merge
        spot = np.full(len(data), -1, np.int64)
        spot[self.starts] = np.arange(len(self.starts))
        self.order = spot[order]
        self.order = self.order[self.order >= 0]

    def sorted_windows(self, key: int) -> tuple[np.ndarray, np.ndarray]:
        """The windows of a key, in order, and which they are."""
        own = self.order[self.keys[self.who[self.order]] == key]
        every = np.lib.stride_tricks.sliding_window_view(self.data, self.length)[self.starts[own]]
        return np.ascontiguousarray(every).view(f"S{self.length}").ravel(), own

    def merge(self, other: Shard, key: int) -> None:
        """Marks windows of a key that are in both shards, by binary search of the others' in the own order."""
        mine, own = self.sorted_windows(key)
        theirs, at = other.sorted_windows(key)
        spot = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
        both = mine[spot] == theirs
        other.hit[at[both]] = True
        self.hit[own[spot[both]]] = True

    def spans(self, keep: np.ndarray) -> pa.RecordBatch:
        """Covered spans of the repeated windows for which keep holds."""
        own = self.hit & keep
        return _runs(self.row[own], self.place[own], self.length)


def _shards(length: int, shard_bytes: int = SHARD_BYTES):
    """Spans of the repeated windows of contexts that come in order of keys."""

    def shards(source):
        held: list[Shard] = []  # shards that end with contexts of the key that is still open
        rows, size = [], 0

        def close(done: bool):
            nonlocal held, rows, size
            new = Shard(rows, length)
            first, last = rows[0][0], rows[-1][0]
            if held and held[0].keys[-1] == first:
                for k, old in enumerate(held):
                    old.merge(new, first)
                    # a window that repeats in the new shard marks all its equals there already
                    for older in held[:k]:
                        older.merge(old, first)
            if held and (done or last != held[0].keys[-1]):
                yield from (s.spans(s.keys[s.who] == s.keys[-1]) for s in held)
                held = []
            yield new.spans((new.keys[new.who] != last) | done)
            if not done:
                held.append(new)
            rows, size = [], 0

        for b, texts in batches(source):
            for h, row, lo, t in zip(*(b.column(n).to_pylist() for n in ("h", "row", "lo")), texts, strict=True):
                if size > shard_bytes:
                    yield from close(False)
                rows.append((h, row, lo, t))
                size += len(t)
        if rows:
            yield from close(True)
        yield from (s.spans(s.keys[s.who] == s.keys[-1]) for s in held)

    return shards


def _final(length: int):
    def final(source):
        for b, texts in batches(source):
            removed, runs, shas = [], [], []
            for spans, t in zip(b.column(1).to_pylist(), texts, strict=True):
                cover = np.zeros(len(t) + 1, np.int32)
                np.add.at(cover, np.array([s["a"] for s in spans]), 1)
                np.add.at(cover, np.array([s["z"] for s in spans]), -1)
                gone = np.cumsum(cover[:-1]) > 0
                removed.append(int(gone.sum()))
                runs.append(int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum()))
                shas.append(hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).digest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(shas, pa.binary())], names=["row", "n_removed", "n_spans", "kept"])

    return final


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, limit: int = LIMIT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256."""
    spark = prepared(docs.sparkSession)
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
    slim = stash(own.mapInArrow(_slim(length), f"row bigint, id bigint, n_bytes bigint, sha binary, anchors {_ANCHORS}"), "anchors")
    texts = slim.groupBy("sha").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("copies"))
    texts = stash(texts, "texts")
    copies = texts.where("copies > 1").select("sha", F.col("row").alias("kept"))
    spare = stash(slim.select("row", "sha").join(copies, "sha").where("row <> kept").select("row"), "spare")
    spare = F.broadcast(spare) if spare.count() <= SPARE else spare
    places = slim.where(F.size("anchors") > 0).select("row", "anchors").join(spare, "row", "left_anti").select("row", F.inline("anchors"))
    often = stash(places.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "often")
    met = places.join(often.select("h"), "h")
    listed = lambda df, *more: df.groupBy("row").agg(F.collect_list(F.struct(*_PLACE, *more)).alias("anchors"))
    several = stash(stash(listed(met), "met").where("row >= 0").join(own.select("row", "text"), "row").select("row", "anchors", "text"), "candidates")

    marks = stash(several.mapInArrow(_marks(length, None), _MARKS), "marks")
    halves, spans = [(0, length - min(GRAM, length))], None
    while True:
        # contexts that occur twice, and one of each for the keys that have several
        kinds = stash(marks.groupBy("h", "digest").agg(F.min(F.struct("row", "at", "lo", "hi")).alias("one"), F.sum("n").alias("n")), "kinds")
        found = marks.where("n = 1").join(kinds.where("n > 1").select("h", "digest"), ["h", "digest"], "left_semi").select("row", F.col("lo").alias("a"), (F.col("hi") + length).alias("z"))
        many = stash(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("different")).where("different > 1"), "many")
        open_ = stash(kinds.join(many, "h").select("h", "one.*", "n", "different"), "open")
        sizes = open_.agg(F.count(F.when(F.col("different") <= limit, 1)).alias("usual"), F.count(F.when(F.col("different") > limit, 1)).alias("over")).first()
        usual = listed(open_.where(F.col("different") <= limit)).join(several.select("row", "text"), "row").select("row", "anchors", "text")
        usual = usual.mapInArrow(_contexts(length), "h bigint, row bigint, lo bigint, text binary")
        usual = usual.repartition(partitions(spark, sizes.usual, 100_000), "h").sortWithinPartitions("h")
        found = found.unionByName(usual.mapInArrow(_shards(length, shard_bytes), "row bigint, a bigint, z bigint"))
        spans = found if spans is None else spans.unionByName(found)
        if not sizes.over:
            break
        halves = [(d, e) for a, z in halves for d, e in (((a, z),) if a == z else ((a, (a + z) // 2), ((a + z) // 2 + 1, z)))]
        over = listed(open_.where(F.col("different") > limit), "n").join(several.select("row", "text"), "row").select("row", "anchors", "text")
        marks = stash(over.mapInArrow(_marks(length, halves), _MARKS), "marks")
    spans = spans.groupBy("row").agg(F.collect_list(F.struct("a", "z")).alias("spans"))
    done = spans.join(several.select("row", "text"), "row").select("row", "spans", "text").mapInArrow(_final(length), "row bigint, n_removed bigint, n_spans bigint, kept binary")
    done = stash(done, "done")
    out = slim.select("row", "id", "n_bytes", "sha").join(texts.where("copies > 1").select("sha", "copies"), "sha", "left").join(done, "row", "left")
    whole = F.col("copies").isNotNull() & (F.col("n_bytes") >= length)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, none).otherwise(F.lower(F.hex(F.coalesce("kept", "sha")))).alias("kept_sha256"),
    )
