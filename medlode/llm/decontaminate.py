"""Benchmark decontamination by winnowing.

Of every six consecutive hashes of 5-grams of words the least is a fingerprint, so any two texts that share
ten consecutive words share a fingerprint inside that span. Fingerprints of documents meet those of benchmark
items; each meeting is extended in both directions to all windows around it, and those that meet an item's window
are hits, once their words have been compared. Windows of equal words are one, with the set of their items. Items of fewer than ten words are one window each and meet all n-grams of their length.

The items' fingerprints are broadcast if their texts stay within about ITEM_WORDS words. Those of a larger
benchmark are joined by shuffle: documents' fingerprints that equal an item's are extended to all windows around
them, and those windows meet the items' windows by SHA-256 of their words. There, items of fewer than ten words have
fingerprints of their own length. Windows that the same items hold share one list of them, and so do documents
that hit the same lists: copies on both sides do not multiply. Such a benchmark never passes through the driver.

Null and empty texts have no words and no hits; repeated rows get equal results; items without words are left
out; an empty benchmark finds nothing. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medlode.llm.common import batches, chunks, extended, gram_hashes, gram_numbers, lower_words, partitions, prepared, same_spans, stash, text_bytes, word_hashes, word_numbers, word_spans

WINDOW = 10
GRAM = 5
#: Words of benchmark items that one broadcast holds (about 50 bytes each with their windows).
ITEM_WORDS = 4_000_000
#: A word of a text, for counts in Spark; the same words as lower_words cuts.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Windows of one record batch.
BATCH_WINDOWS = 1 << 16
#: Sets of items whose names a task remembers.
KNOWN_NAMES = 10_000
#: About how many bytes of a large benchmark a task gets.
ITEM_BYTES = 16 << 20


def fingerprints(words: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the n-grams that are least in some window of consecutive ones."""
    h = gram_hashes(words, gram)
    span = window - gram + 1
    if len(h) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = h[: len(h) - span + 1].copy()
    for k in range(1, span):
        np.minimum(least, h[k : len(h) - span + 1 + k], out=least)
    chosen = np.zeros(len(h), bool)
    for k in range(span):
        chosen[k : len(h) - span + 1 + k] |= h[k : len(h) - span + 1 + k] == least
    at = np.flatnonzero(chosen)
    return at, h[at]


class ItemIndex:
    """Windows of benchmark items, each once with the set of its items, and the items' fingerprints.

    A set that several windows have is held once, so a passage of all items is no list of them a window.
    """

    def __init__(self, ids: list[str], texts: list[bytes]):
        lowered = [lower_words(t) for t in texts]
        words, offsets = word_hashes(lowered)
        numbers = word_numbers(lowered)[0]
        self.spans = word_spans(lowered)[:3]
        self.ids, self.sets, self.names = ids, [], {}
        self.marks = np.unique(fingerprints(words)[1])
        sizes, known = np.diff(offsets), {}
        #: by length: hashes in order, the first word of a window with that hash, and its set
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted({min(int(s), WINDOW) for s in sizes} - {0}):
            own = np.flatnonzero(np.minimum(sizes, WINDOW) == n)
            count = sizes[own] - n + 1
            item = np.repeat(own, count)
            firsts = np.repeat(offsets[own] - np.cumsum(count) + count, count) + np.arange(count.sum())
            kind = gram_numbers(numbers, n)[firsts]
            one = np.unique(kind, return_index=True)[1]
            pairs = np.unique(np.stack([kind, item], 1), axis=0)
            held = np.split(pairs[:, 1], np.flatnonzero(np.diff(pairs[:, 0])) + 1)
            sets = np.array([known.setdefault(x.tobytes(), len(known)) for x in held], np.int64)
            self.sets += [None] * (len(known) - len(self.sets))
            for k, x in zip(sets.tolist(), held, strict=True):
                self.sets[k] = x
            keys = gram_hashes(words, n, firsts[one])
            order = np.argsort(keys, kind="stable")
            self.windows[n] = keys[order], firsts[one][order], sets[order]

    def named(self, sets: np.ndarray) -> tuple[int, str]:
        """How many ids the items of some sets have, and the SHA-256 of them in order."""
        key = sets.tobytes()
        if key not in self.names:
            if len(self.names) >= KNOWN_NAMES:
                self.names.clear()
            ids = {self.ids[k] for k in np.unique(np.concatenate([self.sets[s] for s in sets.tolist()])).tolist()}
            joined = ",".join(sorted(x for x in ids if x is not None))
            self.names[key] = len(ids), hashlib.sha256(joined.encode()).hexdigest()
        return self.names[key]


def _meet(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with keys[i] == table[j]; table is in order."""
    if not len(table) or not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lo = np.searchsorted(table, keys)
    found = np.flatnonzero(table[np.minimum(lo, len(table) - 1)] == keys)
    lo, hi = lo[found], np.searchsorted(table, keys[found], "right")
    n = hi - lo
    return np.repeat(found, n), np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())


def hits(words: np.ndarray, offsets: np.ndarray, index: ItemIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of documents with hashes as in items: their first words, lengths, and the items' first words and sets."""
    firsts, lengths, others, sets = ([np.zeros(0, np.int64)] for _ in range(4))
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for n, (keys, first, own) in index.windows.items():
        if n < WINDOW:
            at = np.arange(max(len(words) - n + 1, 0))
        else:
            # all windows that a shared fingerprint can lie in
            at, marks = fingerprints(words)
            at = np.unique(at[_meet(marks, index.marks)[0]][:, None] - np.arange(WINDOW - GRAM + 1))
            at = at[(at >= 0) & (at + WINDOW <= len(words))]
        at = at[owner[at] == owner[at + n - 1]]
        i, j = _meet(gram_hashes(words, n, at), keys)
        firsts.append(at[i]), lengths.append(np.full(len(i), n)), others.append(first[j]), sets.append(own[j])
    return np.concatenate(firsts), np.concatenate(lengths), np.concatenate(others), np.concatenate(sets)


def compared(blobs: list[bytes], offsets: np.ndarray, found: tuple[np.ndarray, ...], index: ItemIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those windows whose words are the same: their first words, lengths and sets of items. blobs are lower_words'."""
    firsts, lengths, others, sets = found
    if not len(firsts):
        return firsts, lengths, sets
    # only documents with such windows are cut into words again
    doc = np.searchsorted(offsets, firsts, "right") - 1
    docs, place = np.unique(doc, return_inverse=True)
    arr, starts, ends, begins = word_spans([blobs[d] for d in docs])
    ends_of = np.cumsum(lengths)
    step = np.arange(ends_of[-1]) - np.repeat(ends_of - lengths, lengths)
    own = np.repeat(begins[:-1][place] + firsts - offsets[doc], lengths) + step
    item, other_starts, other_ends = index.spans
    other = np.repeat(others, lengths) + step
    pairs, which = np.unique(np.stack([own, other], 1), axis=0, return_inverse=True)
    same = same_spans(arr, starts[pairs[:, 0]], ends[pairs[:, 0]], item, other_starts[pairs[:, 1]], other_ends[pairs[:, 1]])
    ok = np.logical_and.reduceat(same[which.ravel()], ends_of - lengths)
    return firsts[ok], lengths[ok], sets[ok]


def _runs(words: np.ndarray, offsets: np.ndarray, firsts: np.ndarray, lengths: np.ndarray, sets: np.ndarray, index: ItemIndex):
    """Per document with hits: runs of hit words, and what its items are named."""
    if not len(firsts):
        return {}
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, firsts, 1), np.add.at(cover, firsts + lengths, -1)
    hit = np.cumsum(cover[:-1]) > 0
    doc = np.searchsorted(offsets, firsts, "right") - 1
    found = {}
    order = np.argsort(doc, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1):
        d = doc[part[0]]
        own = np.concatenate([[0], hit[offsets[d] : offsets[d + 1]].astype(np.int8), [0]])
        ends = np.flatnonzero(np.diff(own)).tolist()
        found[int(d)] = [{"a": a, "b": b} for a, b in zip(ends[::2], ends[1::2], strict=True)], index.named(np.unique(sets[part]))
    return found


_NONE = hashlib.sha256(b"").hexdigest()
_RUNS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _scan(index):
    def scan(source):
        known = index.value
        for b, texts in batches(source):
            for i, j in chunks(texts):
                lowered = [lower_words(t) for t in texts[i:j]]
                words, offsets = word_hashes(lowered)
                found = _runs(words, offsets, *compared(lowered, offsets, hits(words, offsets, known), known), known)
                own = [found.get(k, ([], (0, _NONE))) for k in range(j - i)]
                kept = [n for n in b.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(n).slice(i, j - i) for n in kept), pa.array(np.diff(offsets)), pa.array([x[0] for x in own], _RUNS), pa.array([x[1][0] for x in own], pa.int64()), pa.array([x[1][1] for x in own], pa.string())],
                    names=[*kept, "n_words", "runs", "n_items", "items_sha256"],
                )

    return scan


def _merged(runs):
    """Hit words of runs in any order, overlapping or not."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(x["b"] - F.greatest(x["a"], s["end"]), F.lit(0).cast("long"))).alias("n"), F.greatest(s["end"], x["b"]).alias("end"))
    return F.aggregate(F.array_sort(runs), start, step)["n"]


def _gram(window: int) -> int:
    """The n-grams that mark windows of so many words; GRAM for WINDOW."""
    return (window + 1) // 2


def _mark_rows(lengths: list[int] | None):
    """Fingerprints as rows: of windows of all the given lengths, or of each text's own one."""

    def rows(source):
        for b, texts in batches(source):
            own_rows = b.column(b.schema.get_field_index("row")).to_numpy()
            for i, j in chunks(texts):
                words, offsets = word_hashes([lower_words(t) for t in texts[i:j]])
                sizes = np.diff(offsets)
                for n in lengths or range(1, WINDOW + 1):
                    at, marks = fingerprints(words, n, _gram(n))
                    doc = np.searchsorted(offsets, at, "right") - 1
                    inside = at + _gram(n) <= offsets[doc + 1]
                    if not lengths:
                        inside &= np.minimum(sizes[doc], WINDOW) == n
                    doc, at, marks = doc[inside], at[inside], marks[inside]
                    columns = own_rows[i:j][doc], np.full(len(at), n, np.int32), marks.view(np.int64), at - offsets[doc]
                    for k in range(0, len(at), BATCH_WINDOWS):
                        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + BATCH_WINDOWS]) for c in columns], names=["row", "n", "mark", "place"])

    return rows


def _window_rows(source):
    """Windows as rows, by the SHA-256 of their words: those around the given fingerprints, or each text's own ones.

    A fingerprint in column `spots` is its place times 16 plus the length of its windows.
    """
    for b, texts in batches(source):
        own_rows = b.column(b.schema.get_field_index("row")).to_numpy()
        spots = b.column(b.schema.get_field_index("spots")) if "spots" in b.schema.names else None
        for t, text in enumerate(texts):
            arr = np.frombuffer(lower_words(text), np.uint8)
            # one space between words, so that equal windows are equal bytes
            arr = arr[(arr != 32) | (np.concatenate([[np.uint8(32)], arr[:-1]]) != 32)]
            arr, starts, ends, _ = word_spans([arr.tobytes()])
            if spots is None:
                n = min(WINDOW, len(starts))
                todo = [(n, np.arange(len(starts) - n + 1) if n else np.zeros(0, np.int64))]
            else:
                own = spots[t].values.to_numpy()
                todo = []
                for n in np.unique(own % 16).tolist():
                    firsts = np.unique((own[own % 16 == n] // 16)[:, None] - np.arange(n - _gram(n) + 1))
                    todo.append((n, firsts[(firsts >= 0) & (firsts + n <= len(starts))]))
            data = arr.tobytes()
            for n, firsts in todo:
                for k in range(0, len(firsts), BATCH_WINDOWS):
                    part = firsts[k : k + BATCH_WINDOWS]
                    digests = [hashlib.sha256(data[a:z]).digest() for a, z in zip(starts[part].tolist(), ends[part + n - 1].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), own_rows[t])), pa.array(np.full(len(part), n, np.int32)), pa.array(part.astype(np.int64)), pa.array(digests, pa.binary())],
                        names=["row", "n", "first", "digest"],
                    )


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """row, n_hit, n_items and items_sha256 of the documents with hits, from docs (row, text) and items (row, id, text)."""
    marks, windows = "row bigint, n int, mark bigint, place bigint", "row bigint, n int, first bigint, digest binary"
    texts = items.select("row", "text")
    lengths = sorted(r.n for r in items.select(F.least("words", F.lit(WINDOW)).cast("int").alias("n")).distinct().collect())
    known = texts.mapInArrow(_mark_rows(None), marks).select("n", "mark").distinct()
    met = docs.mapInArrow(_mark_rows(lengths), marks).join(known, ["n", "mark"], "left_semi")
    spots = stash(met.groupBy("row").agg(F.collect_list(F.col("place") * 16 + F.col("n")).alias("spots")), "spots")
    around = docs.join(spots, "row").select("row", "text", "spots").mapInArrow(_window_rows, windows)
    own = texts.mapInArrow(_window_rows, windows).join(items.select("row", "id"), "row").select("digest", "id").distinct()
    own = stash(own, "item_windows")
    # windows of the same items have the same sums of the items' hashes: one set of items, listed once
    name = F.sha2(F.coalesce(F.concat(F.lit("i"), "id"), F.lit("")), 256)
    sums = [F.sum(F.conv(F.substring(name, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)]
    sets = stash(own.groupBy("digest").agg(F.sha2(F.concat_ws(",", F.count(F.lit(1)).cast("string"), *sums), 256).alias("set")), "sets")
    members = own.join(sets.groupBy("set").agg(F.min("digest").alias("digest")), "digest").select("set", "id")
    # documents that meet the same sets have the same items
    run = F.struct(F.col("first").alias("a"), (F.col("first") + F.col("n")).alias("b"))
    hit = around.join(sets, "digest").groupBy("row").agg(_merged(F.collect_list(run)).alias("n_hit"), F.array_sort(F.collect_set("set")).alias("sets"))
    hit = stash(hit.withColumn("kind", F.sha2(F.array_join("sets", ","), 256)), "hits")
    kinds = hit.groupBy("kind").agg(F.first("sets").alias("sets")).select("kind", F.explode("sets").alias("set"))
    # an item's id may be null, which a list leaves out unless it is inside a struct
    names = kinds.join(members, "set").select("kind", F.struct("id").alias("item")).distinct().groupBy("kind").agg(F.collect_list("item").alias("items"))
    names = names.select("kind", F.array_sort(F.transform("items", lambda x: x["id"])).alias("names"))
    names = names.select("kind", F.size("names").cast("long").alias("n_items"), F.sha2(F.array_join("names", ","), 256).alias("items_sha256"))
    return hit.select("row", "n_hit", "kind").join(names, "kind")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", item_words: int = ITEM_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, then the columns `keep`."""
    spark = prepared(docs.sparkSession)
    items = benchmark.select(F.col(item_col).cast("string").alias("id"), text_bytes(item_text).alias("text"), F.regexp_count(F.col(item_text).cast("string"), F.lit(WORD)).alias("words")).where("words > 0")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("id"), F.lit(0))), F.lit(0))).first()[0]
    own = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"), *[F.col(c).alias(f"kept_{k}") for k, c in enumerate(keep)])
    if size > 6 * item_words:
        # rows get numbers that have to be the same in each of several scans
        count = partitions(spark, size, ITEM_BYTES)
        items = stash(items.repartition(count).withColumn("row", F.monotonically_increasing_id()), "items")
        own = stash(own.withColumn("row", F.monotonically_increasing_id()), "docs")
        n_words = F.regexp_count(F.col("text").cast("string"), F.lit(WORD)).cast("long")
        found = own.withColumn("n_words", n_words).drop("text").join(_joined(own.select("row", "text"), items), "row", "left")
        return found.select(
            F.col("id").alias(id_col),
            F.col("n_words"),
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
            F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
            F.col("n_hit").isNotNull().alias("contaminated"),
            *[F.col(f"kept_{k}").alias(c) for k, c in enumerate(keep)],
        )
    rows = items.select("id", "text").orderBy("id").collect()
    index = ItemIndex([r.id for r in rows], [bytes(r.text) for r in rows])
    schema = extended(own.schema, ("text",), "n_words bigint, runs array<struct<a:bigint,b:bigint>>, n_items bigint, items_sha256 string")
    found = own.mapInArrow(_scan(spark.sparkContext.broadcast(index)), schema)
    return found.select(
        F.col("id").alias(id_col),
        F.col("n_words"),
        _merged(F.col("runs")).alias("n_hit"),
        "n_items",
        "items_sha256",
        (F.size("runs") > 0).alias("contaminated"),
        *[F.col(f"kept_{k}").alias(c) for k, c in enumerate(keep)],
    )
