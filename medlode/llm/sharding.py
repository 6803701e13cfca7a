"""Sharding by sampled splitters, in DataFrame functions.

The key of a row is a hash of its text, inside a text one of its id, and inside an id one of the row's place in
the scan: equal texts are neighbours, and even equal rows can be cut anywhere. A sample of keys, each in
proportion to its size, gives quantiles as splitters: a range for each RANGE_BYTES of the input, RANGES at
least and MOST_RANGES at most (their tables are broadcast, and hold 32 bytes a range). Records are
range-partitioned by them: the splitters are grouped by the first bits of the text's hash, so a row meets only
the few of its group. A splitter moves to the beginning of its text unless that text holds several splitters;
so a text lies in one range unless it is as large as ranges are.

Sizes of ranges (one row each) give the bytes before each range; inside its range each record counts on. A
shard is the records whose middle lies in its share of all bytes: shards differ by a record's size at most,
or by a small group of equal texts, which stays together. Ranges that cross a boundary are thereby subdivided.
All of this is done with slim rows (keys and sizes); texts are shuffled only where the caller wants them, once.

Null and empty texts have size 1 and one key. Null ids are keys like others; equal rows get different slots.
An empty table gives none. The law is `bytes`: sizes are near equal. Where all columns are carried, those of the
documents that are named like a result (in any case of letters) are called doc_ and their name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medlode.llm.common import prepared, stash

SHARDS = 16
#: Ranges at least and at most, the bytes that one should hold, and sampled keys a range on average.
RANGES, MOST_RANGES = 1024, 1 << 17
RANGE_BYTES = 128 << 20
SAMPLED = 12
RESULTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def keyed(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs' columns packed as `doc`, with the row's place in the scan, size, crc, and the key (a, b, c)."""
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    text = F.col(f"doc.{text_col}").cast("string")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    filled = F.coalesce(text, F.lit(""))
    keys = F.xxhash64(filled).alias("a"), F.xxhash64(F.col(f"doc.{id_col}"), F.lit(17)).alias("b"), F.xxhash64("row").alias("c")
    return own.select("row", "doc", size.alias("size"), F.crc32(filled.cast("binary")).alias("crc"), *keys)


_KEY = "array<struct<a:bigint,b:bigint,c:bigint>>"


def splitters(keys: DataFrame, ranges: int = RANGES, sampled: int = SAMPLED) -> DataFrame:
    """One row: `cuts`, the splitters in order, from a sample of about ranges * sampled keys by size."""
    total = keys.agg(F.sum("size").alias("total"))
    hit = F.pmod(F.xxhash64("a", "b", "c", F.lit(23)), F.lit(1 << 40)) / float(1 << 40) * F.col("total") < F.col("size") * float(ranges * sampled)
    # a key of more than a sampling step counts once for each step in it
    times = F.greatest(F.round(F.col("size") * float(ranges * sampled) / F.col("total")), F.lit(1)).cast("int")
    sample = keys.crossJoin(F.broadcast(total)).where(hit).select("a", "b", "c", times.alias("times"))
    listed = sample.agg(F.array_sort(F.collect_list(F.struct("a", "b", "c", "times"))).alias("all"))
    # each step is written, or Spark would work it out again for every element of the next
    flat = F.flatten(F.transform("all", lambda x: F.array_repeat(F.struct(x["a"].alias("a"), x["b"].alias("b"), x["c"].alias("c")), x["times"])))
    n = F.size("flat")
    picked = F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda k: F.get("flat", (k * n / ranges).cast("int")))
    cuts = F.array_distinct(F.filter(F.when(n > 0, picked).otherwise(F.array().cast(_KEY)), lambda x: x.isNotNull()))
    row = stash(stash(listed.select(flat.alias("flat")), "sample").select(cuts.alias("cuts")), "cuts")
    several = F.transform("cuts", lambda x, i: (F.get("cuts", i - 1)["a"] == x["a"]) | (F.get("cuts", i + 1)["a"] == x["a"]))
    least = F.lit(-(1 << 63)).cast("long")
    moved = F.transform(F.arrays_zip(F.col("cuts").alias("x"), several.alias("many")), lambda z: F.when(F.coalesce(z["many"], F.lit(False)), z["x"]).otherwise(F.struct(z["x"]["a"].alias("a"), least.alias("b"), least.alias("c"))))
    return stash(row.select(moved.alias("cuts")), "cuts")


def grouped(cuts: DataFrame, bits: int) -> DataFrame:
    """The splitters by the first bits of `a`: group, base (splitters in lesser groups), inside (those of the group).

    All groups are there, 2 ** bits rows: a window over them is a bounded task.
    """
    own = cuts.select(F.explode("cuts").alias("x")).groupBy(F.shiftright("x.a", 64 - bits).alias("g")).agg(F.array_sort(F.collect_list("x")).alias("inside"))
    groups = cuts.sparkSession.range(-(1 << bits - 1), 1 << bits - 1).withColumnRenamed("id", "group")
    own = groups.join(own, F.col("group") == F.col("g"), "left").select("group", F.coalesce("inside", F.array().cast(_KEY)).alias("inside"))
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    return own.select("group", F.coalesce(F.sum(F.size("inside")).over(before), F.lit(0)).cast("int").alias("base"), "inside")


def ranged(keys: DataFrame, ranges: int) -> DataFrame:
    """keys with the range of each row: the number of splitters that aren't above its key."""
    bits = min(max(1, ranges.bit_length()), 17)
    table = stash(grouped(splitters(keys, ranges), bits), "splitters")
    met = keys.join(F.broadcast(table), F.shiftright("a", 64 - bits) == F.col("group"))
    own = F.struct("a", "b", "c")
    return met.withColumn("range", F.col("base") + F.size(F.filter("inside", lambda x: x <= own))).drop("group", "base", "inside")


def _carried(columns: list[str]) -> list[tuple[str, str]]:
    """The documents' columns and what they are called beside the results."""
    used, out = {*RESULTS, *(c.lower() for c in columns)}, []
    for c in columns:
        name = c
        while name.lower() in used and (name != c or c.lower() in RESULTS):
            name = f"doc_{name}"
        used.add(name.lower())
        out.append((c, name))
    return out


def shards(docs: DataFrame, count: int = SHARDS, ranges: int | None = None, text_col: str = "text", id_col: str = "doc_id", carry: bool = False) -> DataFrame:
    """One row per record: id (or, with carry, all columns), size, text_crc32, law, shard, slot, grown_shard."""
    prepared(docs.sparkSession)
    own = keyed(docs, text_col, id_col)
    slim = ["row", "size", "crc", "a", "b", "c"]
    keys = stash(own.select(*slim, *([] if carry else [F.col(f"doc.{id_col}").alias("id")])), "keys")
    if ranges is None:
        total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        ranges = min(max(RANGES, -(-total // RANGE_BYTES)), MOST_RANGES)
    placed = stash(ranged(keys, ranges), "ranged")
    held = placed.groupBy("range").agg(F.sum("size").alias("bytes"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(F.col("range").alias("r"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("before"), F.sum("bytes").over(Window.partitionBy()).alias("total"), F.col("bytes"))
    placed = placed.join(F.broadcast(held), F.col("range") == F.col("r")).drop("r")
    inside = Window.partitionBy("range").orderBy("a", "b", "c")
    run = placed.withColumn("place", F.row_number().over(inside)).withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    group = Window.partitionBy("range", "a")
    run = run.withColumn("first", F.min(F.col("upto") - F.col("size")).over(group)).withColumn("last", F.max("upto").over(group))
    small = (F.col("last") - F.col("first")) * float(ranges) <= 2 * F.col("total")
    middle = F.col("before") + F.when(small, (F.col("first") + F.col("last")) / 2).otherwise(F.col("upto") - F.col("size") / 2)
    run = run.withColumn("shard", F.least(F.floor(middle * count / F.col("total")), F.lit(count - 1)).cast("int"))
    # the records of a range are in order of shards, so a slot is a place in the range and what came before
    run = run.withColumn("from", F.min("place").over(Window.partitionBy("range", "shard")))
    run = stash(run.drop("a", "b", "c", "before", "total", "bytes", "first", "last", "upto"), "placed")
    counts = run.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("shard").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    done = run.join(F.broadcast(counts), (F.col("shard") == F.col("s")) & (F.col("range") == F.col("r")))
    done = done.withColumn("slot", (F.col("ahead") + F.col("place") - F.col("from")).cast("long"))
    if carry:
        done = own.select(F.col("row").alias("o"), "doc").hint("merge").join(done.select("row", "size", "crc", "shard", "slot"), F.col("o") == F.col("row"))
    fields = [F.col(f"doc.`{c}`").alias(n) for c, n in _carried(docs.columns)] if carry else [F.col("id").alias(id_col)]
    more = F.col("size"), F.col("crc").cast("long"), F.lit("bytes"), F.col("shard"), F.col("slot"), F.lit(None).cast("int")
    return done.select(*fields, *[c.alias(n) for c, n in zip(more, RESULTS, strict=True)])
