"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets decide.

Two documents are linked when the Jaccard similarity of their sets of five-word shingles (A-Z lower-cased
words of digits, letters and non-ASCII characters; a shorter text is one shingle) is THRESHOLD or more.

1. Documents of equal words are one node. Each node has BANDS band hashes of ROWS MinHashes each, chosen so
   that a pair at the threshold shares a band with probability RECALL.
2. Band hashes are shuffled. Buckets are named by their least node, the pivot: a node lists the different
   pivots of its buckets, so two nodes that share a bucket have a pivot in common, and a bucket of any size
   gives no more rows than members. A pivot is left out if all who list it list a lesser one, too.
3. Nodes meet by pivot, with their texts. All pairs are counted exactly, on whole shingle sets of compared
   words; a pair with several pivots in common is counted at the least of them. So no links chain nodes
   together before they are verified. Where a pivot has more than BLOCK nodes or BLOCK_GRAMS shingles, these are
   cut into blocks, and each pair of blocks is a task of its own: no group is ever in one task. Tasks give the
   number of links of each node, weighted by copies, and a spanning forest of the links they saw.
4. Components of the forests are the classes of near duplicates.

Null, empty and wordless texts have no shingles, no links, and are classes of their own. Repeated rows are
copies of each other. Null ids rank as the least id. Empty tables give none. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medlode.llm.common import batches, chunks, gram_hashes, gram_numbers, lower_words, partitions, prepared, stash, text_bytes, word_hashes, word_numbers
from medlode.llm.components import components

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
#: A pair this similar should share a band this often at most.
UNLIKE, NOISE = 0.3, 0.01
#: Nodes, and shingles, of a block; a task works on two.
BLOCK, BLOCK_GRAMS = 1024, 1 << 19
#: Shingles (0/1 columns) of two blocks that are multiplied at once.
WIDTH = 4096
#: Pairs up to which plain sets are quicker than matrices.
FEW = 24


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, unlike: float = UNLIKE, noise: float = NOISE) -> tuple[int, int]:
    """The least bands and rows with which pairs at the threshold meet by recall and unlike ones by noise."""
    for rows in range(1, 40):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if 1 - (1 - unlike**rows) ** bands <= noise:
            return bands, rows
    raise ValueError("no such bands")


def shingles(texts: list[bytes], n: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    words, offsets = word_hashes([lower_words(t) for t in texts])
    grams = gram_hashes(words, n)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        else:
            out.append(gram_hashes(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


class Hasher:
    def __init__(self, bands: int, rows: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.times = (rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1))[:, None]
        self.plus = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)[:, None]

    def bands_of(self, grams: np.ndarray) -> np.ndarray:
        """One 64-bit hash a band."""
        x = (grams >> np.uint64(32)).astype(np.uint32)[None, :]
        least = np.full(self.bands * self.rows, 0xFFFFFFFF, np.uint32)
        with np.errstate(over="ignore"):
            for at in range(0, x.shape[1], 512):
                part = x[:, at : at + 512] * self.times
                part += self.plus
                np.minimum(least, part.min(axis=1), out=least)
            mins = least.reshape(self.bands, self.rows).astype(np.uint64)
            h = np.arange(self.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for k in range(self.rows):
                h = (h ^ mins[:, k]) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
        return h.astype(np.int64)


def _node_key(words: bytes) -> bytes | None:
    """A digest of a text's words in order; None without words."""
    own = words.split()
    return hashlib.blake2b(b" ".join(own), digest_size=16).digest() if own else None


def _signed(hasher: Hasher):
    def signed(source):
        for b, texts in batches(source):
            for i, j in chunks(texts):
                keys = [_node_key(lower_words(t)) for t in texts[i:j]]
                first = {k: n for n, k in reversed(list(enumerate(keys))) if k is not None}
                own = dict(zip(first, shingles([texts[i + n] for n in first.values()]), strict=True))
                bands = {k: hasher.bands_of(g).tolist() for k, g in own.items()}
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(n).slice(i, j - i) for n in ("row", "id")),
                        pa.array(keys, pa.binary()),
                        pa.array([bands.get(k) for k in keys], pa.list_(pa.int64())),
                        pa.array([len(own[k]) if k in own else 0 for k in keys], pa.int64()),
                    ],
                    names=["row", "id", "set", "bands", "grams"],
                )

    return signed


def _forest(links: np.ndarray, names_a: np.ndarray, names_b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a 0/1 matrix of links between two lists of names."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, a in enumerate(names_a.tolist()):
        for b in names_b[np.flatnonzero(links[i])].tolist():
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((min(a, b), max(a, b)))
    return out


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each left and right set of values have in common, as products of 0/1 matrices."""
    both = np.zeros((len(left), len(right)), np.float32)
    flat = [np.concatenate(side) if side else np.zeros(0, np.int64) for side in (left, right)]
    values, number = np.unique(np.concatenate(flat), return_inverse=True)
    at = number[: len(flat[0])], number[len(flat[0]) :]
    counts = [np.bincount(x, minlength=len(values)) for x in at]
    # a value of one set says nothing of pairs in a list with itself; a value of all is a constant
    same = left is right
    useful = (counts[0] > 1) if same else (counts[0] > 0) & (counts[1] > 0)
    whole = (counts[0] == len(left)) & (counts[1] == len(right))
    both += int(whole.sum())
    column = np.cumsum(useful & ~whole) - 1
    spots = []
    for x, side in zip(at, (left, right), strict=True):
        who = np.repeat(np.arange(len(side)), [len(s) for s in side])
        ok = (useful & ~whole)[x]
        spot, who = column[x[ok]], who[ok]
        order = np.argsort(spot, kind="stable")
        spots.append((spot[order], who[order]))
    width = int((useful & ~whole).sum())
    for lo in range(0, width, WIDTH):
        dense = []
        for (spot, who), n in zip(spots, both.shape, strict=True):
            a, z = np.searchsorted(spot, [lo, lo + WIDTH])
            m = np.zeros((n, min(WIDTH, width - lo)), np.float32)
            m[who[a:z], spot[a:z] - lo] = 1
            dense.append(m)
        both += dense[0] @ dense[1].T
    return both


def _links(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of a left and a right set are as similar as the threshold."""
    na, nb = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    both = _common(left, right)
    return both >= threshold * (na[:, None] + nb[None, :] - both) - 1e-6


def _plain_set(text: bytes, n: int = WORDS) -> set:
    words = lower_words(text).split()
    return set(zip(*(words[k:] for k in range(n)), strict=False)) if len(words) >= n else {tuple(words)}


def _number_sets(texts: list[bytes], n: int = WORDS) -> list[np.ndarray]:
    """The distinct shingles of each text as numbers, equal only for equal shingles."""
    words, offsets = word_numbers([lower_words(t) for t in texts])
    grams = gram_numbers(words, n)
    base = len(words) + 1
    short: dict[tuple, int] = {}
    out = []
    for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if z - a >= n:
            out.append(np.unique(grams[a : z - n + 1]))
        else:
            out.append(np.array([base + short.setdefault(tuple(words[a:z].tolist()), len(short))]))
    return out


_OUT = "node bigint, links bigint, copy_links bigint, a bigint, b bigint"


def _verify(threshold: float):
    def hits(pivot: int, sides: list[list[tuple]]) -> np.ndarray:
        """Which pairs are links that are counted here; rows are (node, copies, pivots, text)."""
        left, right = sides
        if len(left) * len(right) <= FEW:
            sets = {r[0]: _plain_set(r[3]) for side in sides for r in side}
            out = np.zeros((len(left), len(right)), bool)
            for i, a in enumerate(left):
                for j, b in enumerate(right):
                    both = len(sets[a[0]] & sets[b[0]]) if a[0] != b[0] else 0
                    alike = both and both >= threshold * (len(sets[a[0]]) + len(sets[b[0]]) - both) - 1e-6
                    out[i, j] = bool(alike) and min(set(a[2]) & set(b[2])) == pivot
            return out
        lesser = [[np.array([q for q in r[2] if q < pivot], np.int64) for r in side] for side in sides]
        if left is right:
            sets = _number_sets([r[3] for r in left])
            out = _links(sets, sets, threshold) & (_common(lesser[0], lesser[0]) == 0)
            np.fill_diagonal(out, False)
            return out
        sets = _number_sets([r[3] for side in sides for r in side])
        return _links(sets[: len(left)], sets[len(left) :], threshold) & (_common(*lesser) == 0)

    def result(pivot: int, rows: list[tuple]) -> list[tuple]:
        """rows: (side, node, copies, pivots, text); there is a second side only for pairs of different blocks."""
        sides = [[r[1:] for r in rows if r[0] == s] for s in (0, 1)]
        one = not sides[1]
        if one:
            sides[1] = sides[0]
        if not sides[0]:
            return []
        hit = hits(pivot, sides)
        names, copies = ([np.array([r[k] for r in side], np.int64) for side in sides] for k in (0, 1))
        out = [(n, int(k), int(c), None, None) for n, k, c in zip(names[0].tolist(), hit.sum(1), hit @ copies[1], strict=True) if k]
        if not one:
            out += [(n, int(k), int(c), None, None) for n, k, c in zip(names[1].tolist(), hit.sum(0), copies[0] @ hit, strict=True) if k]
        return out + [(None, None, None, a, b) for a, b in _forest(hit, *names)]

    def packed(rows):
        kinds = [pa.int64()] * 5
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(5)], names=["node", "links", "copy_links", "a", "b"])

    def verify(source):
        key, rows, out = None, [], []
        for b, texts in batches(source):
            cols = [b.column(n).to_pylist() for n in ("pivot", "x", "y", "side", "node", "copies", "pivots")]
            for pivot, x, y, side, node, copies, pivots, text in zip(*cols, texts, strict=True):
                if (pivot, x, y) != key:
                    if len(rows) > 1:
                        out += result(key[0], rows)
                    if len(out) > 5000:
                        yield packed(out)
                        out = []
                    key, rows = (pivot, x, y), []
                rows.append((side, node, copies, pivots, text))
        if len(rows) > 1:
            out += result(key[0], rows)
        if out:
            yield packed(out)

    return verify


def pivots_of(put: DataFrame) -> DataFrame:
    """From (row, bucket): the pivots of each row that shares a bucket, without needless ones, as (row, pivots)."""
    least = put.groupBy("bucket").agg(F.min("row").alias("least"), F.max("row").alias("most")).where("least < most").select("bucket", "least")
    listed = stash(put.join(least, "bucket").groupBy("row").agg(F.array_sort(F.collect_set("least")).alias("pivots")), "pivots")
    # all who list p list q, too: then q sees all pairs of p
    pairs = listed.select("pivots", F.explode("pivots").alias("p")).select("p", F.explode(F.filter("pivots", lambda q: q <= F.col("p"))).alias("q"))
    pairs = pairs.groupBy("p", "q").agg(F.count(F.lit(1)).alias("n"))
    size = pairs.groupBy("p").agg(F.max(F.when(F.col("q") == F.col("p"), F.col("n"))).alias("n"), F.max(F.when(F.col("q") < F.col("p"), F.col("n"))).alias("other"))
    kept = stash(size.where("other is null or other < n").select("p"), "kept")
    return listed.select("row", F.explode("pivots").alias("p")).join(kept, "p").groupBy("row").agg(F.array_sort(F.collect_list("p")).alias("pivots"))


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a number for each row, the same whenever the scan is read again; columns packed as `doc`."""
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return own.select("row", F.col(f"doc.`{id_col}`").cast("long").alias("id"), text_bytes(f"doc.`{text_col}`").alias("text"), "doc")


def classes(own: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """From numbered documents, one row each:

    row, id, class_id (the least id of all documents linked to it, directly or through others), copy_id (the
    least id with equal words), n_links (other documents that it is linked to, copies included), n_text_links
    (other texts that it is linked to), first (the one row of its class with the least id).
    """
    spark = prepared(own.sparkSession)
    bands, rows = choose_bands(threshold, recall)
    signs = stash(own.select("row", "id", "text").mapInArrow(_signed(Hasher(bands, rows)), "row bigint, id bigint, set binary, bands array<bigint>, grams bigint"), "signs")

    # equal words: one node each, named by the row of the least id
    who = F.struct(F.coalesce("id", F.lit(-(1 << 63)).cast("long")).alias("k"), "row", "id")
    sets = stash(signs.where("set is not null").groupBy("set").agg(F.min(who).alias("w"), F.count(F.lit(1)).alias("copies")).select("set", F.col("w.row").alias("node"), F.col("w.id").alias("node_id"), "copies"), "sets")
    reps = signs.join(sets.select(F.col("node").alias("row"), "copies"), "row")
    put = reps.select("row", F.posexplode("bands").alias("band", "hash")).select("row", F.xxhash64("band", "hash").alias("bucket"))
    listed = stash(pivots_of(put), "listed")
    members = stash(listed.join(reps.select("row", "copies", "grams"), "row"), "members")

    # a large pivot is cut into as many blocks as it needs, by hash; each pair of them is a task
    weights = members.select("grams", F.explode("pivots").alias("pivot")).groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.sum("grams").alias("grams"))
    many = F.greatest(F.ceil(F.col("n") / float(block)), F.ceil(F.col("grams") / float(BLOCK_GRAMS)))
    large = stash(weights.where("n > 1").select("pivot", many.cast("int").alias("blocks")), "blocks")
    places = members.select("row", F.explode("pivots").alias("pivot")).join(large, "pivot")
    places = places.withColumn("own", F.pmod(F.xxhash64("row", F.lit(29)), F.col("blocks")).cast("int"))
    places = stash(places.groupBy("row").agg(F.collect_list(F.struct("pivot", "own", "blocks")).alias("places")).join(members, "row").select(F.col("row").alias("node"), "copies", "pivots", "places"), "places")
    size = places.agg(F.coalesce(F.sum(F.aggregate("places", F.lit(0).cast("long"), lambda s, p: s + p["blocks"])), F.lit(0))).first()[0]
    texts = own.select(F.col("row").alias("node"), "text")
    # by shuffle at any size: a table of members grows with the input
    met = places.join(texts.hint("merge"), "node").select("node", "copies", "pivots", "text", F.inline("places"))
    met = met.select("node", "copies", "pivots", "text", "pivot", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    side = F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side")
    met = met.select("pivot", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), side, "node", "copies", "pivots", "text")
    met = met.repartition(partitions(spark, size, 20_000), "pivot", "x", "y").sortWithinPartitions("pivot", "x", "y", "side", "node")
    found = stash(met.mapInArrow(_verify(threshold), _OUT), "links")

    linked = found.where("node is not null").groupBy("node").agg(F.sum("links").alias("links"), F.sum("copy_links").alias("copy_links"))
    joined = components(found.where("a is not null").select("a", "b"))
    nodes = sets.join(linked, "node", "left").join(joined, "node", "left").select("set", "node", "node_id", "copies", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("copy_links", F.lit(0)).alias("copy_links"))
    # a class is named by its least id
    rank = F.struct(F.coalesce("node_id", F.lit(-(1 << 63)).cast("long")).alias("k"), F.col("node").alias("row"), F.col("node_id").alias("id"))
    nodes = stash(nodes, "nodes")
    heads = stash(nodes.groupBy("root").agg(F.min(rank).alias("head")), "heads")
    nodes = stash(nodes.join(heads, "root").select("set", "node_id", "copies", "links", "copy_links", "head"), "nodes")
    return signs.select("row", "id", "set").join(nodes, "set", "left").select(
        "row",
        "id",
        F.when(F.col("head").isNull(), F.col("id")).otherwise(F.col("head.id")).alias("class_id"),
        F.when(F.col("head").isNull(), F.col("id")).otherwise(F.col("node_id")).alias("copy_id"),
        F.coalesce(F.col("copies") - 1 + F.col("copy_links"), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_text_links"),
        (F.col("head").isNull() | (F.col("row") == F.col("head.row"))).alias("first"),
    )


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per document: id, class_id, copy_id, n_links, n_text_links, kept (one of each class)."""
    found = classes(numbered(docs, id_col, text_col), threshold, recall, block)
    return found.select(F.col("id").alias(id_col), "class_id", "copy_id", "n_links", "n_text_links", F.col("first").alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each class."""
    own = numbered(docs, id_col, text_col)
    dropped = classes(own).where(~F.col("first")).select("row")
    return own.select("row", "doc").hint("merge").join(dropped, "row", "left_anti").select("doc.*")
