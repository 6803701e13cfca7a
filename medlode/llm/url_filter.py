"""URL filters by a path-template tree, in DataFrame functions.

Rules come first: a rule fits its host and all its subdomains if the path begins with the rule's; the longest
fitting rule decides. All urls that rules decide are the labelled ones from which the tree learns.

Segments with digits are variable: they become wildcards at once (with their ending, as in *.html). The tree of
a host then grows level by level, as deep as its paths and only where a node's urls differ in label, or some
have one and others none. In a node
- labelled branches whose share of blocks does not differ from that of their labelled siblings by Z standard
  errors are alike, and are merged into a wildcard `*`; others stay by themselves;
- unlabelled branches are alike the labelled ones (those that are alike each other, or the only one) if they
  look like those together: neither the share of urls that go on with a variable segment nor of those that end
  there differs by Z standard errors. They are merged into a wildcard `**`, which has the labelled urls of those
  as evidence; so what is known of labelled branches reaches them, and they don't water it down.

A template is judged by its labelled purity: blocked urls of labelled ones, smoothed by WEIGHT urls as its parent
node is judged, and by its unlabelled urls, of which each counts as much as UNLABELLED allowed ones. At the top
are the domain (the last two labels of the host) and the host; above them PRIOR. A url is blocked when its
template's purity is THRESHOLD or more. So an unlabelled branch is blocked with the siblings it looks like, if
what is known to be blocked outweighs what nobody has labelled.

Null urls and urls without `://` have an empty host and path, and are judged as such. With no labelled urls
purity is the prior or less, and all are allowed. Repeated rows get equal results, an empty table none. Equal
hosts and generalised paths are one row before any shuffle of the tree; windows are not used, so a hot host is
not one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlode.llm.common import stash

#: The rules of the stated query.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
Z = 2.0
PRIOR, WEIGHT, UNLABELLED = 0.2, 4.0, 0.25
THRESHOLD = 0.5


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The name and verdict of the longest rule that fits, else null."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, f"{h}{p}").otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def general(path: Column) -> Column:
    """The path with each segment that has a digit as a wildcard; empty segments are left out."""
    wild = lambda s: F.when(s.rlike("[0-9]"), F.concat(F.lit("*"), F.regexp_extract(s, r"\.[A-Za-z]+$", 0))).otherwise(s)
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), wild)


def _purity(above: Column, seen: Column | int = 0, seen_blocked: Column | int = 0) -> Column:
    """The purity of a template, with evidence besides its own."""
    return (F.col("blocked") + seen_blocked + WEIGHT * above) / (F.col("labelled") + seen + WEIGHT + UNLABELLED * (F.col("n") - F.col("labelled")))


def _apart(part: str, size: str, all_part: str, all_size: str) -> Column:
    """By how many standard errors a branch's share of something differs from a group's."""
    a, n, b, m = (F.col(c) for c in (part, size, all_part, all_size))
    pooled = (a + b + 1) / (n + m + 2)
    return F.abs(a / n - b / m) / F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))


_COUNTS = ("n", "labelled", "blocked")


def _sums(*more: str) -> list[Column]:
    return [F.sum(c).alias(c) for c in (*_COUNTS, *more)]


def _mixed() -> Column:
    """Whether urls of a node differ in label, or in whether they have one."""
    return (F.col("labelled") > 0) & ((F.col("labelled") < F.col("n")) | ((F.col("blocked") > 0) & (F.col("blocked") < F.col("labelled"))))


def branches(urls: DataFrame, level: int, z: float = Z) -> DataFrame:
    """The branches of all open nodes at a level: node, segment, counts, and the name they get (`merged`)."""
    segment, after = F.get("segments", F.lit(level)), F.get("segments", F.lit(level + 1))
    own = urls.where(F.col("open") & segment.isNotNull()).withColumn("segment", segment)
    own = own.withColumns({"wild": F.when(after.startswith("*"), F.col("n")).otherwise(0), "ends": F.when(after.isNull(), F.col("n")).otherwise(0)})
    own = stash(own.groupBy("node", "purity", "segment").agg(*_sums("wild", "ends")), "branches")
    known = own.where("labelled > 0")
    # of several labelled branches each is compared with the others
    whole = known.groupBy(F.col("node").alias("w")).agg(F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"), F.count(F.lit(1)).alias("of"))
    met = known.join(whole, F.col("node") == F.col("w")).drop("w").withColumns({"other_labelled": F.col("all_labelled") - F.col("labelled"), "other_blocked": F.col("all_blocked") - F.col("blocked")})
    alike = (F.col("of") == 1) | (_apart("blocked", "labelled", "other_blocked", "other_labelled") <= z)
    known = met.withColumn("alike", alike).withColumn("merged", F.when(F.col("alike") & (F.col("of") > 1), "*").otherwise(F.col("segment")))
    known = stash(known.select(*own.columns, "alike", "merged"), "known")
    # what the alike ones look like together, and which unlabelled ones look like that
    look = known.where("alike").groupBy(F.col("node").alias("w")).agg(
        F.sum("n").alias("all_n"), F.sum("wild").alias("all_wild"), F.sum("ends").alias("all_ends"), F.sum("labelled").alias("seen"), F.sum("blocked").alias("seen_blocked")
    )
    open_ = own.where("labelled = 0").join(look, F.col("node") == F.col("w"), "left").drop("w")
    same = F.col("all_n").isNotNull() & (_apart("wild", "n", "all_wild", "all_n") <= z) & (_apart("ends", "n", "all_ends", "all_n") <= z)
    open_ = open_.withColumn("merged", F.when(same, "**").otherwise(F.col("segment")))
    open_ = open_.withColumns({c: F.when(same, F.col(c)).otherwise(0) for c in ("seen", "seen_blocked")})
    none = {c: F.lit(0).cast("long") for c in ("seen", "seen_blocked")}
    kept = ["node", "purity", "segment", *_COUNTS, "merged", "seen", "seen_blocked"]
    return known.withColumns(none).select(*kept).unionByName(open_.select(*kept))


def templates(urls: DataFrame, z: float = Z) -> DataFrame:
    """urls (host, segments and counts n, labelled, blocked) with the template of each and its purity."""
    domain = F.substring_index("host", ".", -2)
    above = urls.groupBy(domain.alias("d")).agg(*_sums()).select("d", _purity(F.lit(PRIOR)).alias("above"))
    hosts = urls.groupBy("host").agg(*_sums()).join(above, F.substring_index("host", ".", -2) == F.col("d"))
    hosts = hosts.select(F.col("host").alias("h"), F.col("host").alias("node"), _purity(F.col("above")).alias("purity"), _mixed().alias("open"))
    urls = stash(urls.join(hosts, F.col("host") == F.col("h")).drop("h"), "hosts")
    level = 0
    while not urls.where(F.col("open") & F.get("segments", F.lit(level)).isNotNull()).isEmpty():
        found = stash(branches(urls, level, z), "merged")
        nodes = found.groupBy("node", "purity", "merged").agg(*_sums(), F.max("seen").alias("seen"), F.max("seen_blocked").alias("seen_blocked"))
        nodes = nodes.select(F.col("node").alias("w"), F.col("merged").alias("m"), F.concat("node", F.lit("/"), "merged").alias("next"), _purity(F.col("purity"), F.col("seen"), F.col("seen_blocked")).alias("next_purity"), _mixed().alias("next_open"))
        names = found.select(F.col("node").alias("v"), "segment", "merged").join(nodes, (F.col("v") == F.col("w")) & (F.col("merged") == F.col("m"))).drop("w", "m", "merged")
        on = F.col("open") & (F.col("node") == F.col("v")) & (F.get("segments", F.lit(level)) == F.col("segment"))
        urls = urls.join(names, on, "left")
        # urls that end here, or whose node isn't open, have their template
        now = F.coalesce("next", "node").alias("node"), F.coalesce("next_purity", "purity").alias("purity"), F.coalesce("next_open", F.lit(False)).alias("open")
        urls = stash(urls.select("host", "segments", *_COUNTS, *now), "tree")
        level += 1
    return urls.withColumnRenamed("node", "template").drop("open")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, z: float = Z) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, template, purity."""
    url = F.col(url_col).cast("string")
    own = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = own.withColumns({"rule": name, "ruled": verdict, "segments": general(F.col("path"))})
    flag = lambda c: F.sum(F.when(c, 1).otherwise(0))
    seen = own.groupBy("host", "segments").agg(F.count(F.lit(1)).alias("n"), flag(F.col("ruled").isNotNull()).alias("labelled"), flag(F.col("ruled") == "block").alias("blocked"))
    found = templates(stash(seen, "urls"), z).select(F.col("host").alias("h"), F.col("segments").alias("s"), "template", "purity")
    found = own.join(found, (F.col("host") == F.col("h")) & (F.col("segments") == F.col("s")), "left")
    return found.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", F.when(F.col("purity") >= THRESHOLD, "block").otherwise("allow")).alias("verdict"), "template", "purity")
