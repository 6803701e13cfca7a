"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame functions.

Targets are shares of all words by weight; a source that can't reach its share with REPEATS copies stops
there, and the rest is shared anew (solved exactly from the order in which sources stop). The rows of a
source are dealt by a hash into blocks of about total / BLOCKS words; the hash takes in the row's place in the
scan, so equal rows lie in different blocks. A source draws whole passes over its blocks and, for the rest of
its target, the first blocks of a permuted order; these draws are its quota.

The tree splits the draws of all sources between the two halves of a range of output shards, again and again:
at each node draws are put in an order of chance, and the left half gets the first of them, a number in
proportion to its shards. So what each source gives is a multivariate hypergeometric sample, and two shards
never get the same draw. What a row's block was drawn for, less what the last block is cut, is what is taken:
that block is taken row by row until the target is met within half a row, and one row that fits what is left
best evens it out.

Plan tables hold a row a source and a row a draw, at most BLOCKS + 4 a source: they are broadcast only while
sources number MAX_SOURCES at most, else joined by shuffle. Sources in order, and all draws at the tree's root,
are sorted in one task: slim rows, as many as sources and draws. For the plan no documents are shuffled
but the rows (size) of the one block a source that is cut; `mix` shuffles each copy once to its shard.

Null sources are a source of their own; null and empty texts have size 0; with no words at all every target
is 0. Rows of size 0 are taken with their block but weigh nothing. Which of equal rows are taken depends on
their places alone, so reruns over the same files agree. An empty table gives none. Other columns may have any
names in `mix`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medlode.llm.common import partitions, prepared, stash

WORD = r"[^\x20\x09-\x0D]+"
REPEATS = 3
BLOCKS = 4096
SHARDS = 16
MAX_SOURCES = 5_000
#: About how many rows a partition of the mixture has.
PART_ROWS = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """From source and source_size: weight and target of each source, and the total.

    Sources that stop are those of least room for their weight. If the k first of these stop, the others get
    level = (total - what those take) / (weights of the others) times their weight; k is the least number for
    which the next source stays within its room.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    own = sizes.withColumn("weight", (F.pmod(F.row_number().over(every) - 1, F.lit(3)) + 1).cast("double")).withColumn("room", F.col("source_size") * float(REPEATS))
    by = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after, whole = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    own = own.withColumn("total", F.sum("source_size").over(whole))
    level = (F.col("total") - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    own = own.withColumn("fits", F.when(level * F.col("weight") <= F.col("room"), level))
    # the first level that fits is also the least of those that do not stop anyone after it
    own = own.withColumn("level", F.first("fits", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("room"), F.coalesce(F.col("level") * F.col("weight"), F.col("room")))
    return own.select("source", "source_size", "weight", "total", target.alias("target"))


def split(draws: DataFrame, shards: int) -> DataFrame:
    """draws with a shard for each row, by the tree."""
    nodes = draws.withColumns({"lo": F.lit(0), "hi": F.lit(shards)})
    for _ in range(max(0, math.ceil(math.log2(shards)))):
        node = Window.partitionBy("lo", "hi")
        order = node.orderBy(F.xxhash64("lo", "hi", *[F.col(c) for c in draws.columns]), *draws.columns)
        mid = ((F.col("lo") + F.col("hi")) / 2).cast("int")
        left = F.round(F.count(F.lit(1)).over(node) * (mid - F.col("lo")) / (F.col("hi") - F.col("lo")))
        nodes = nodes.withColumn("goes_left", F.row_number().over(order) <= left).withColumn("mid", mid)
        inner = F.col("hi") - F.col("lo") > 1
        nodes = nodes.withColumns({"lo": F.when(inner & ~F.col("goes_left"), F.col("mid")).otherwise(F.col("lo")), "hi": F.when(inner & F.col("goes_left"), F.col("mid")).otherwise(F.col("hi"))})
        nodes = nodes.drop("goes_left", "mid")
    return nodes.withColumnRenamed("lo", "shard").drop("hi")


def plan(sized: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """From source and size: each source's target, number of blocks, whole passes and the rest."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    own = targets(sizes.select("source", "source_size")).join(sizes.select(F.col("source").alias("s"), "rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    unit = F.greatest(F.col("total") / float(blocks), F.lit(1.0))
    own = own.withColumn("blocks", F.greatest(F.least(F.ceil(F.col("source_size") / unit), F.col("rows")), F.lit(1)).cast("int"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    own = own.withColumn("passes", F.floor(ratio + 1e-12).cast("int")).withColumn("rest", F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0)))
    return own


def ranked(sized: DataFrame, *key: str) -> DataFrame:
    """sized with `rank`, a hash of the key columns and the row's place in the scan."""
    prepared(sized.sparkSession)
    return sized.withColumn("rank", F.xxhash64(*key, F.monotonically_increasing_id(), F.lit(11)))


def drawn(sized: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS) -> DataFrame:
    """sized (with source, size and rank) and for each row: source_size, target, copies, taken, shards (array<int>)."""
    return _drawn(sized, shards, blocks)[0]


def _drawn(sized: DataFrame, shards: int, blocks: int) -> tuple[DataFrame, DataFrame]:
    """What `drawn` returns, and about how many rows and words each shard gets."""
    # one pass counts the words; all plans are made from its slim table
    slim = stash(sized.select("source", "size", "rank"), "sizes")
    sources = stash(plan(slim.select("source", "size"), blocks), "sources")
    few = (lambda df: F.broadcast(df)) if sources.count() <= MAX_SOURCES else (lambda df: df)
    own = sources.select(F.col("source").alias("s"), "source_size", "target", "blocks", "passes", "rest")

    def place(df: DataFrame) -> DataFrame:
        df = df.join(few(own), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        return df.withColumn("block", F.pmod(F.xxhash64("rank", F.lit(3)), F.col("blocks")).cast("int"))

    # words and rows of each block, in the permuted order in which the source's rest is drawn
    held = place(slim).groupBy("source", "block").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"), F.first("rest").alias("rest"), F.first("passes").alias("passes"))
    order = Window.partitionBy("source").orderBy(F.xxhash64("block", F.coalesce("source", F.lit("")), F.lit(5)), "block")
    before = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.withColumn("need", F.col("rest") - before)
    held = held.withColumn("part", F.when(F.col("need") <= 0, 0).when(F.col("words") <= F.col("need"), 2).otherwise(1))
    held = stash(held.withColumn("quota", F.col("passes") + F.when(F.col("part") > 0, 1).otherwise(0)), "blocks")

    # the tree deals the draws of all sources to the shards
    draws = held.where("quota > 0").select("source", "block", F.explode(F.sequence(F.lit(1), F.col("quota"))).alias("draw"))
    tree = split(draws, shards).groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("draw", "shard"))).alias("spots"))
    tree = tree.select(F.col("source").alias("s"), F.col("block").alias("b"), F.transform("spots", lambda x: x["shard"]).alias("spots"))
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))
    held = held.join(tree, same, "left").select(F.col("source").alias("s"), F.col("block").alias("b"), "need", "part", "rows", "words", F.coalesce("spots", F.array().cast("array<int>")).alias("spots"))
    held = stash(held, "draws")
    loads = held.select("rows", "words", F.explode("spots").alias("shard")).groupBy("shard").agg(F.sum("rows").alias("rows"), F.sum("words").alias("words"))
    held = held.drop("rows", "words")
    cut = place(slim).join(few(held), same).where("part = 1").select("source", "rank", "size", "need")
    cut = cut.withColumn("sum", F.sum("size").over(Window.partitionBy("source").orderBy("rank", "size").rangeBetween(Window.unboundedPreceding, 0)))
    # ranks up to the last that is in
    cut = cut.withColumn("in", F.col("sum") - F.col("size") / 2 <= F.col("need")).where("in").groupBy("source").agg(F.max("rank").alias("upto"))
    cut = stash(cut, "cuts")

    def deal(df: DataFrame) -> DataFrame:
        """Rows with what their block was drawn for (spots) and whether the last of these draws leaves them out."""
        df = place(df).join(few(held), same).drop("s", "b").join(few(cut.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        out = (F.col("part") == 1) & ~F.coalesce(F.col("rank") <= F.col("upto"), F.lit(False))
        return df.withColumn("copies", F.size("spots") - out.cast("int")).withColumn("extra", (F.col("part") > 0) & ~out)

    # what whole rows still leave of a source's target goes to the row, of all others, that fits it best
    short = deal(slim).groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("short"))
    short = stash(short.withColumnRenamed("source", "s"), "short")
    off = F.abs(F.abs("short") - F.col("size"))
    fit = deal(slim).join(few(short), F.col("source").eqNullSafe(F.col("s"))).where((F.col("extra") == (F.col("short") < 0)) & (off < F.abs("short")))
    fit = stash(fit.groupBy("s").agg(F.min(F.struct(off.alias("off"), "rank")).alias("best")).select("s", F.col("best.rank").alias("flipped")), "fit")
    dealt = deal(sized).join(few(fit), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    flip = F.when(F.coalesce(F.col("rank") == F.col("flipped"), F.lit(False)), F.when(F.col("extra"), -1).otherwise(1)).otherwise(0)
    out = dealt.withColumn("copies", F.col("copies") + flip).withColumn("taken", F.col("copies") * F.col("size"))
    spare = F.array(F.pmod("rank", F.lit(shards)).cast("int"))
    out = out.withColumn("shards", F.slice(F.concat("spots", spare), F.lit(1), F.col("copies")))
    return out.drop("blocks", "passes", "rest", "block", "need", "part", "spots", "upto", "extra", "flipped"), loads


def mix(docs: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The mixture itself: docs' columns, a row for each copy that is taken, in its shard's shuffled order.

    Each partition holds rows of one shard; a shard has several where it is large, each in shuffled order.

    The columns are packed in one before the work, so their names can't clash.
    """
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    own = own.select("doc", F.col(f"doc.{source_col}").cast("string").alias("source"), word_count(F.col(f"doc.{text_col}")).alias("size"), F.col(f"doc.{id_col}").alias("doc_id"))
    out, loads = _drawn(ranked(own, "doc_id", "size"), shards, blocks)
    copies = out.where("copies > 0").select("doc", "rank", F.posexplode("shards").alias("copy", "shard"))
    # a shard has partitions of its own, as many as its share of rows or words asks for
    loads = {r.shard: (r.rows, r.words) for r in loads.collect()}
    rows, words = (max(1, sum(x[k] for x in loads.values())) for k in (0, 1))
    count = partitions(docs.sparkSession, rows, PART_ROWS)
    pieces = [max(1, math.ceil(count * max(loads.get(k, (0, 0))[0] / rows, loads.get(k, (0, 0))[1] / words))) for k in range(shards)]
    place = lambda of: F.get(F.array(*map(F.lit, of)), F.col("shard"))
    # by the row's place, as equal rows may be a large share of a shard
    piece = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(13)), place(pieces))
    copies = copies.withColumn("part", (place([sum(pieces[:k]) for k in range(shards)]) + piece).cast("int"))
    return copies.repartitionById(sum(pieces), "part").sortWithinPartitions("shard", F.xxhash64("rank", "copy", "shard")).select("doc.*")
