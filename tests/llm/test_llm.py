"""Each operator against brute force, an exact round trip or held-out accuracy, on small and odd tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from medlode.llm import components, decontaminate, exact_dedup, language_id, mixing, ngram_join, queries, repeats, sharding, token_file, toxicity, url_filter
from medlode.llm.common import gram_hashes, lower_words, stash, word_hashes

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, `rank` int, row int, `doc` int"


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows and clashing names."""
    base = " ".join(f"w{k % 97}x{k % 13}" for k in range(400))
    near = base.replace("w50x", "q50x", 1)
    texts = [base, base, base.upper(), near, None, "", "é" * 300, "a b", "long " * 30_000, base + " tail", " \t\n", "x", "日本語 тест <|endoftext|>"]
    rows = [(k, t, "en" if k % 2 else None, None if k % 3 == 0 else f"s{k % 3}", 1, 2, 3, 4, 5) for k, t in enumerate(texts)]
    rows += [rows[0], (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return queries.table(spark, SF, "documents").cache()


def test_words():
    texts = ["Ab c-d é1", "", "x" * 10, "a\x7fb"]
    h, at = word_hashes([lower_words(t.encode()) for t in texts])
    assert np.diff(at).tolist() == [len(WORD.findall(low(t))) for t in texts]
    again, _ = word_hashes([lower_words(b"zz ab")])
    assert again[1] == h[0] and len(gram_hashes(h, 3)) == len(h) - 2


def test_exact_dedup(spark, odd, none):
    rows = exact_dedup.exact_groups(odd).collect()
    src = odd.select("doc_id", "text").collect()
    groups = collections.defaultdict(list)
    for r in src:
        groups[low(r.text)].append(r.doc_id)
    by = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    assert len(rows) == len(src) and sum(r.kept for r in rows) == len(by)
    for r in rows:
        own = by[r.text_sha256]
        assert r.group_size == len(own) and r.keep_id == max((x for x in own if x is not None), default=None)
    assert exact_dedup.exact_groups(none).count() == 0


def test_cuckoo_index():
    index, live = exact_dedup.CuckooIndex(2), {}
    rng = np.random.default_rng(1)
    for k in range(3000):
        d = hashlib.sha256(str(rng.integers(0, 900)).encode()).digest()
        if k % 3 == 2:
            assert index.delete(d) == (live.pop(d, None) is not None)
        else:
            index.insert(d, [k])
            live[d] = [k]
        assert index.get(d) == live.get(d)
    assert dict(index.items()) == live and index.size == len(live) and all(index.maybe(d) for d in live)


def test_apply_changes(spark):
    f = lambda *xs: spark.createDataFrame([(bytes([x]) * 32,) for x in xs], "digest binary")
    got = exact_dedup.apply_changes(f(1, 2, 3), f(2, 4, 4), f(2, 3, 9)).collect()
    assert sorted(r.digest[0] for r in got) == [1, 2, 4]


def _shingles(t):
    w = WORD.findall(low(t))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("block", [2, 128])
def test_ngram_join(spark, odd, docs, block):
    for table in (odd, docs.select("doc_id", "text")):
        src = table.select("doc_id", "text").collect()
        sets = [_shingles(r.text) for r in src]
        want, root = [0] * len(src), list(range(len(src)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a in range(len(src)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if both and both >= 0.8 * len(sets[a] | sets[b]):
                    want[a] += 1
                    want[b] += 1
                    root[find(a)] = find(b)
        got = ngram_join.linked(table, block=block).collect()
        key = lambda x: -1 if x is None else x
        assert sorted((key(r.doc_id), r.n_links) for r in got) == sorted((key(r.doc_id), n) for r, n in zip(src, want, strict=True))
        assert sum(r.kept for r in got) == len({find(k) for k in range(len(src))})


def test_bands():
    bands, rows = ngram_join.choose_bands()
    assert (1 - 0.8**rows) ** bands <= 1e-4 and bands * 0.3**rows < 0.02


def test_components(spark):
    path = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(path, "a bigint, b bigint")).collect()}
    assert all(got.get(k, 0) == 0 for k in range(41)) and {got[k] for k in range(101, 130)} == {100}


def test_suffix_array():
    rng = np.random.default_rng(3)
    for _ in range(100):
        sizes = rng.integers(1, 40, int(rng.integers(1, 6)))
        data = rng.integers(0, int(rng.integers(1, 4)), sizes.sum()).astype(np.uint8)
        ends, who = np.repeat(np.cumsum(sizes), sizes), np.repeat(np.arange(len(sizes)), sizes)
        suffix = lambda k: data[k : ends[k]].tobytes()  # noqa: B023, E731
        order = repeats.suffix_array(data, sizes)
        assert order.tolist() == sorted(range(len(data)), key=lambda k: (suffix(k), -who[k]))  # noqa: B023
        shared = repeats.common_prefixes(data, sizes, order, 20, sizes)[order]
        for k in range(1, len(order)):
            x, y = suffix(order[k - 1])[:20], suffix(order[k])[:20]
            assert shared[k] == next((i for i, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))


@pytest.mark.parametrize(("limit", "shard_bytes"), [(1, 1 << 20), (3, 300), (2048, 2000), (2048, 1 << 20)])
def test_repeats(spark, odd, docs, limit, shard_bytes):
    for table, length in ((odd, 20), (docs.where("doc_id < 60"), 200)):
        src = table.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
        texts = [r.text.encode() for r in src]
        seen = collections.Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
        want = []
        for r, t in zip(src, texts, strict=True):
            gone = bytearray(len(t))
            for k in range(len(t) - length + 1):
                if seen[t[k : k + length]] > 1:
                    gone[k : k + length] = b"\1" * length
            kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
            runs = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
            want.append((str(r.doc_id), len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
        got = repeats.without_repeats(table, length=length, limit=limit, shard_bytes=shard_bytes).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)


def test_mixing(spark, odd, docs, none):
    for table in (odd, docs):
        sized = mixing.ranked(table.select("doc_id", F.col("source").cast("string").alias("source"), mixing.word_count(F.col("text")).alias("size")), "doc_id", "size")
        rows = mixing.drawn(sized).collect()
        sizes = collections.Counter()
        for r in rows:
            sizes[r.source] += r["size"]
        names = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight, total, want, left = {s: k % 3 + 1 for k, s in enumerate(names)}, sum(sizes.values()), {}, set(names)
        while True:
            rest = total - sum(want.values())
            level = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
            over = {s for s in left if level[s] > 3 * sizes[s] + 1e-9}
            if not over:
                want |= level
                break
            want |= {s: 3 * sizes[s] for s in over}
            left -= over
        taken = collections.Counter()
        for r in rows:
            taken[r.source] += r.taken
            assert r.target == pytest.approx(want[r.source]) and r.taken == len(r.shards) * r["size"] <= 3 * r["size"]
        for s in names:
            largest = max(r["size"] for r in rows if r.source == s)
            assert abs(taken[s] - want[s]) <= largest / 2 + 1
    assert sorted(r.taken for r in mixing.drawn(sized).collect()) == sorted(r.taken for r in rows)
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(none).count() == 0
    assert mixing.mix(odd).count() == sum(len(r.shards) for r in mixing.drawn(mixing.ranked(odd.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")), "doc_id", "size")).collect())


def test_mixing_deals_shards(spark):
    """Each partition of the mixture holds rows of one shard, and a shard rows of all sources, though the input is clustered."""
    rows = [(k, f"s{k // 2000}", f"word{k}") for k in range(6000)]
    table = stash(spark.createDataFrame(rows, "doc_id int, source string, text string").repartitionByRange(3, "source"))
    sized = mixing.drawn(mixing.ranked(table.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")), "doc_id", "size"), shards=4, blocks=64)
    shards = {r.doc_id: r.shards for r in sized.collect()}
    held = collections.defaultdict(list)
    for r in mixing.mix(table, shards=4, blocks=64).withColumn("part", F.spark_partition_id()).collect():
        held[r.part].append(r)
    assert sorted(r.doc_id for x in held.values() for r in x) == sorted(k for k, x in shards.items() for _ in x)
    for x in held.values():
        assert set.intersection(*(set(shards[r.doc_id]) for r in x)) and len({r.source for r in x}) == 3


def test_mixing_equal_rows(spark):
    """A source of equal rows meets its target like any other."""
    rows = [(1, "a", 10)] * 1000 + [(k, "b", 10) for k in range(2, 1002)] + [(None, None, 7)] * 300
    table = mixing.ranked(spark.createDataFrame(rows, "doc_id int, source string, size bigint").repartition(4), "doc_id", "size")
    taken, target = collections.Counter(), {}
    for r in mixing.drawn(table).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[k] - v) <= 6 for k, v in target.items()) and len(target) == 3


def test_splitting_tree(spark):
    """Each source's draws are spread over shards as a hypergeometric law has it, and shards have equal loads."""
    draws = spark.createDataFrame([(f"s{k % 3}", k) for k in range(1200)], "source string, draw int")
    got = collections.Counter((r.source, r.shard) for r in mixing.split(draws, 5).collect())
    loads = [sum(n for (_, x), n in got.items() if x == k) for k in range(5)]
    assert sum(loads) == 1200 and max(loads) - min(loads) <= 2
    # mean 80, variance 80 * (2/3) * (4/5) of such a count
    assert len(got) == 15 and all(abs(n - 80) < 5 * 6.6 for n in got.values()) and len(set(got.values())) > 3


def test_sharding_equal_rows(spark):
    """Equal rows, also without id and text, are cut like others."""
    rows = spark.createDataFrame([(None, None)] * 3000 + [(1, "same text")] * 3000 + [(k, f"text {k}") for k in range(100)], "doc_id int, text string").repartition(3)
    got = sharding.shards(rows).collect()
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert len(got) == 6100 and max(sizes.values()) - min(sizes.values()) <= 40 and len(sizes) == 16
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_sharding_brute_force(spark, odd, docs):
    """Shards are those of a plain walk over all records in order of their keys."""
    for table in (docs, odd):
        own = sharding.keyed(table).select("row", "size", "a", "b", "c").collect()
        total, at, want = sum(r["size"] for r in own), 0, {}
        groups = collections.Counter()
        for r in own:
            groups[r.a] += r["size"]
        order = sorted(own, key=lambda r: (r.a, r.b, r.c))
        first = {}
        for r in order:
            first.setdefault(r.a, at)
            small = groups[r.a] * sharding.RANGES <= 2 * total
            middle = first[r.a] + groups[r.a] / 2 if small else at + r["size"] / 2
            want[r.row] = min(int(middle * 16 / total), 15)
            at += r["size"]
        got = sharding.shards(table.withColumn("row", F.monotonically_increasing_id()), carry=True).collect()
        # a splitter may cut a text that is nearly as large as a range
        off = [r for r in got if r.shard != want[r.row]]
        assert len(got) == len(want) and all(groups[k.a] * sharding.RANGES > total / 2 for k in own if k.row in {r.row for r in off})


def test_sharding(spark, odd, docs, none):
    for table in (odd, docs):
        rows = sharding.shards(table).collect()
        assert len(rows) == table.count() and {r.law for r in rows} <= {"bytes"}
        slots, sizes = collections.defaultdict(list), collections.Counter()
        for r in rows:
            slots[r.shard].append(r.slot)
            sizes[r.shard] += r["size"]
        assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(16))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r["size"] == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in rows) + sum(sizes.values()) / 100
    assert sharding.shards(none).count() == 0 and sharding.shards(docs, carry=True).count() == len(rows)


def test_token_file(spark, odd, docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    for table in (odd.where("doc_id is not null"), docs):
        out = token_file.fresh_path(spark)
        token_file.write_tokens(table, out, path)
        at, want, flat = 0, [], []
        for r in sorted(table.select("doc_id", "text").collect(), key=lambda r: (r.doc_id, r.text or "")):
            ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]
            want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at, flat = at + len(ids), flat + ids
        assert sorted(map(tuple, token_file.read_documents(spark, out).collect())) == sorted(want)
        places = [0, len(flat) // 2, len(flat) - 1]
        assert {r.place: r.token for r in token_file.read_tokens(spark, out, places).collect()} == {p: flat[p] for p in places}
    ids = np.array([0, 255, 256, 65535, 65536, 2**31], np.uint32)
    assert (token_file.Codes(token_file.pack(ids)).at(np.array([5, 0, 3, 2, 1, 4])) == ids[[5, 0, 3, 2, 1, 4]]).all()
    out = token_file.fresh_path(spark)
    token_file.write_tokens(none, out, path)
    assert token_file.read_documents(spark, out).count() == 0


def _pair(n):
    """Two words of n letters that polynomials modulo 2^64 can't tell apart."""
    first = "".join("ab"[k.bit_count() % 2] for k in range(n))
    return first, first.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048])
def test_colliding_words(spark, n):
    import public_tokenizers

    x, y = _pair(n)
    enc = token_file.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    ids, _ = enc.encode([x.encode(), y.encode(), f"{x} {y}".encode()])
    assert ids.tolist() == [i for t in (x, y, f"{x} {y}") for i in [*enc.tokenizer.encode(t, add_special_tokens=False).ids, 0]]
    table = spark.createDataFrame([(1, x), (2, y), (3, f"k {x}")], "doc_id int, text string")
    items = spark.createDataFrame([(7, y), (8, f"k {y}")], "item_id int, text string")
    for most in (4_000_000, 1):
        found = decontaminate.contamination(table, items, item_words=most).collect()
        assert {r.doc_id: (r.n_hit, r.n_items) for r in found} == {1: (0, 0), 2: (1, 1), 3: (0, 0)}
    assert {r.n_links for r in ngram_join.linked(table).collect()} == {0}


def test_hash_collisions(spark, monkeypatch):
    """With hashes that nearly all collide, results are still by content."""
    import public_tokenizers

    from medlode.llm import common

    bad = lambda arr, starts, ends: (arr[starts] % 3).astype(np.uint64) + np.uint64(1)
    texts = ["gigantically gargantuan", "gargantuan gigantically", "marvellously gargantuan words", "gigantically"]
    for module in (common, token_file):
        monkeypatch.setattr(module, "EXACT", 0)
        monkeypatch.setattr(module, "span_hashes", bad)
    enc = token_file.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    ids, _ = enc.encode([t.encode() for t in texts])
    assert ids.tolist() == [i for t in texts for i in [*enc.tokenizer.encode(t, add_special_tokens=False).ids, 0]]
    numbers, offsets = common.word_numbers([lower_words(t.encode()) for t in texts])
    words = [w for t in texts for w in t.split()]
    assert len(set(zip(words, numbers.tolist(), strict=True))) == len(set(words)) == len(set(numbers.tolist()))
    lowered = [lower_words(b"gargantuan gigantically"), lower_words(b"gigantically")]
    words, at = word_hashes(lowered)
    index = decontaminate.ItemIndex(["i"], [b"gigantically"])
    first, length, item = decontaminate.compared(lowered, at, decontaminate.hits(words, at, index), index)
    assert first.tolist() == [1, 2] and item.tolist() == [0, 0]


def test_other_tokenizers_are_left_whole(tmp_path):
    import json

    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        file = json.load(f)
    assert token_file.cuts_into_pieces(file) and not token_file.cuts_into_pieces({**file, "normalizer": {"type": "Lowercase"}})
    file["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "t.json").write_text(json.dumps(file))
    enc = token_file.Encoder(str(tmp_path / "t.json"))
    ids, n = enc.encode([b"ABC Def", b""])
    assert ids.tolist() == [*enc.tokenizer.encode("abc def", add_special_tokens=False).ids, 0, 0] and n.tolist()[-1] == 1


def test_pieces_equal_the_tokenizer():
    import public_tokenizers

    enc = token_file.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", " ", "  ", "a  b", "a \n b", "\n\n x", "x\n", "don't 't", "<|endoftext|>", "naïve × 3÷4", "\x1ca", "12ab3 ...!! ", "'", "\t\tx", "...\n...  ,,"]
    ids, n = enc.encode([t.encode() for t in texts])
    assert ids.tolist() == [i for t in texts for i in [*enc.tokenizer.encode(t, add_special_tokens=False).ids, 0]] and n.sum() == len(ids)


@pytest.mark.parametrize("most", [4_000_000, 20])
def test_decontaminate(spark, odd, docs, none, most):
    base = " ".join(f"w{k % 97}x{k % 13}" for k in range(20, 45))
    bench = spark.createDataFrame([(1, " ".join(f"w{k % 97}x{k % 13}" for k in range(30, 60))), (2, "a B"), (3, None), (4, ""), (10, "x"), (11, "long long long"), (12, base), (10, "x"), (None, "q r s x"), (None, base)], "item_id int, text string")
    real = queries.table(spark, SF, "benchmark")
    for table, items in ((odd, bench), (docs, real)):
        windows = collections.defaultdict(set)
        for r in items.collect():
            w = WORD.findall(low(r.text))
            for k in range(max(1, len(w) - 9) if w else 0):
                windows[tuple(w[k : k + 10])].add(r.item_id)
        sizes = {len(w) for w in windows}
        want = []
        for r in table.collect():
            w, found = WORD.findall(low(r.text)), set()
            hit = [False] * len(w)
            for n in sizes:
                for k in range(len(w) - n + 1):
                    if own := windows.get(tuple(w[k : k + n])):
                        found |= own
                        hit[k : k + n] = [True] * n
            want.append((str(r.doc_id), len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(str(i) for i in found if i is not None)).encode()).hexdigest(), any(hit)))
        got = decontaminate.contamination(table, items, item_words=most).collect()
        assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in got) == sorted(want)
    assert decontaminate.contamination(none, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(odd, bench.limit(0)).collect())


def test_language_id(spark, odd, docs, none):
    rows = queries.op9_language_id(spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in queries.table(spark, "/root/testdata/sf0.01", "documents").collect()}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    model = language_id.train(docs, F.lit(True))
    got = {r.doc_id: r for r in language_id.languages(odd, model).collect()}
    assert got[None].lang_pred == got[5].lang_pred == got[10].lang_pred == "und" and got[4].score == 0
    assert language_id.languages(none, model).count() == 0
    assert {r.lang_pred for r in language_id.languages(odd, language_id.train(none, F.lit(True))).collect()} == {"und"}
    code = language_id.codewords(12)
    assert min((code[i] != code[j]).sum() for i in range(12) for j in range(i)) > 10


def test_language_sample(spark, monkeypatch):
    """Copies of one text take one place of their language's share and none of the others'."""
    rows = [("aa", "hot text")] * 3000 + [("aa", f"aa {k}") for k in range(20)] + [(lang, f"{lang} {k}") for lang in ("bb", "cc") for k in range(40)] + [("dd", "one")]
    monkeypatch.setattr(language_id, "Model", lambda blobs, labels: list(zip(labels, blobs, strict=True)))
    got = language_id.train(spark.createDataFrame(rows, "lang string, text string").repartition(4), F.lit(True), sample=120)
    assert collections.Counter(x for x, _ in got) == {"aa": 21, "bb": 30, "cc": 30, "dd": 1} and len(set(got)) == len(got)
    got = language_id.train(spark.createDataFrame([(f"l{k}", f"text {k} {j}") for k in range(12) for j in range(30)], "lang string, text string"), F.lit(True), sample=12)
    assert len(got) == len({x for x, _ in got}) == 12


def test_toxicity(spark, odd, none):
    sf = "/root/testdata/sf0.1"
    rows = queries.op8_toxicity(spark, sf).collect()
    truth = {r.doc_id: r.toxic for r in queries.table(spark, sf, "labels").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    hit = [r.predicted for r in held if truth[r.doc_id]]
    false = [r.predicted for r in held if not truth[r.doc_id]]
    assert sum(hit) / len(hit) > 0.85 and sum(false) / len(false) < 0.05
    assert toxicity.scores(odd, toxicity.Model([b"a"], [1])).count() == odd.count() and toxicity.scores(none, toxicity.Model([], [])).count() == 0
    model = toxicity.train(queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels"), F.lit(True))
    assert all(0 <= r.score <= 1 for r in toxicity.scores(odd, model).collect())


def test_url_filter(spark):
    urls = ["http://A.net/x?q", "https://m.example.net/en/1", "http://example.net/en/", "http://b.org/fr/2", "http://b.org/en/2", "http://example.com/de/9", "nothing", None, "http://h.com#frag", "http://x.notnet/", "ftp://example.net"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = {r.page_id: r for r in url_filter.judge(rows).collect()}
    assert [got[k].rule for k in range(len(urls))] == ["net/", "example.net/en/", "example.net/en/", "org/fr/", None, "example.com/de/", None, None, None, None, None]
    assert [got[k].host for k in (0, 6, 7, 8)] == ["a.net", "", "", "h.com"] and got[0].path == "/x" and got[8].path == ""
    assert [got[k].verdict for k in range(6)] == ["block", "allow", "allow", "allow", "allow", "block"]
    assert url_filter.judge(rows.limit(0)).count() == 0


def _tree(rows, z=url_filter.Z):
    """Templates and purities of (host, path, label) by plain loops; label is block, allow or None."""
    W, U = url_filter.WEIGHT, url_filter.UNLABELLED

    def count(xs):
        return len(xs), sum(x[2] is not None for x in xs), sum(x[2] == "block" for x in xs)

    def purity(xs, above, seen=0, seen_blocked=0):
        n, known, blocked = count(xs)
        return (blocked + seen_blocked + W * above) / (known + seen + W + U * (n - known))

    def mixed(xs):
        n, known, blocked = count(xs)
        return known > 0 and (known < n or 0 < blocked < known)

    def apart(a, n, b, m):
        p = (a + b + 1) / (n + m + 2)
        return abs(a / n - b / m) / (p * (1 - p) * (1 / n + 1 / m)) ** 0.5

    def parts(path):
        return ["*" + re.search(r"(\.[A-Za-z]+)?$", s)[0] if re.search("[0-9]", s) else s for s in path.split("/") if s]

    out = {}

    def grow(node, above, xs, level):
        ends = [x for x in xs if len(x[1]) <= level]
        if not mixed(xs) or len(ends) == len(xs):
            ends = xs
        for x in ends:
            out[x[0], tuple(x[1])] = node, above
        by = collections.defaultdict(list)
        for x in xs if ends is not xs else []:
            if len(x[1]) > level:
                by[x[1][level]].append(x)
        known = {s: count(v) for s, v in by.items() if count(v)[1]}
        all_known, all_blocked = sum(c[1] for c in known.values()), sum(c[2] for c in known.values())
        alike = {s for s, (_, k, b) in known.items() if len(known) == 1 or apart(b, k, all_blocked - b, all_known - k) <= z}
        wild = lambda v: sum(len(x[1]) > level + 1 and x[1][level + 1].startswith("*") for x in v)
        last = lambda v: sum(len(x[1]) == level + 1 for x in v)
        pool = [x for s in alike for x in by[s]]
        groups, seen = collections.defaultdict(list), {}
        for s, v in by.items():
            if s in known:
                name = "*" if s in alike and len(known) > 1 else s
            elif pool and apart(wild(v), len(v), wild(pool), len(pool)) <= z and apart(last(v), len(v), last(pool), len(pool)) <= z:
                name, seen["**"] = "**", count(pool)[1:]
            else:
                name = s
            groups[name] += v
        for name, v in groups.items():
            grow(f"{node}/{name}", purity(v, above, *seen.get(name, ())), v, level + 1)

    rows = [(h, parts(p), label) for h, p, label in rows]
    domain = lambda h: ".".join(h.split(".")[-2:])
    for h in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == h]
        top = purity([r for r in rows if domain(r[0]) == domain(h)], url_filter.PRIOR)
        grow(h, purity(own, top), own, 0)
    return [out[h, tuple(p)] for h, p, _ in rows]


def test_url_tree(spark):
    """Templates, purities and verdicts as by plain loops, on pages and on made-up sites."""
    rng = np.random.default_rng(9)
    words = ["de", "en", "fr", "shop", "a", "b", "c12", "x7.html", "about.html", "9", "Ä", "very-" * 300]
    urls = [f"http://{'mw'[k % 2]}.site{k % 5}.{['com', 'net', 'org', 'co.uk'][k % 4]}/" + "/".join(words[i] for i in rng.integers(0, len(words), int(rng.integers(0, 6)))) for k in range(1500)]
    urls += [None, "", "no scheme", "http://", "http://h.com", "http://h.com#x", *urls[:40]]
    made = spark.createDataFrame([(k, u, 1, "x", "y", None) for k, u in enumerate(urls)], "page_id int, url string, n int, template string, host string, node int")
    rules = [*url_filter.RULES, ("site0.com", "/shop/", "allow"), ("site3.co.uk", "/a/b/", "block"), ("site1.net", "/a/", "allow"), ("w.site2.org", "/de/en/fr/", "block"), *[("site4.com", f"/{x}/", "block") for x in ("de", "en", "fr", "shop", "a")]]
    for table, own in ((queries.table(spark, "/root/testdata/sf0.01", "pages"), url_filter.RULES), (made, rules)):
        got = url_filter.judge(table, rules=own).collect()
        known = {n: v for h, p, v in own for n in [f"{h}{p}"]}
        want = _tree([(r.host, r.path, known.get(r.rule)) for r in got])
        for r, (template, purity) in zip(got, want, strict=True):
            assert r.template == template and r.purity == pytest.approx(purity)
            assert r.verdict == (known[r.rule] if r.rule else "block" if purity >= url_filter.THRESHOLD else "allow")
        assert len({r.verdict for r in got if r.rule is None}) == 2 or own is url_filter.RULES


def test_url_held_out(spark):
    """Of labelled urls half are hidden: the tree judges them as their rules do."""
    pages = queries.table(spark, "/root/testdata/sf0.1", "pages").select("page_id", "url", url_filter.host_of(F.col("url")).alias("host"), url_filter.path_of(F.col("url")).alias("path"))
    name, verdict = url_filter.rule_of(F.col("host"), F.col("path"))
    hidden = F.pmod(F.xxhash64("page_id"), F.lit(2)) == 0
    own = pages.select("page_id", "host", url_filter.general(F.col("path")).alias("segments"), verdict.alias("truth"), F.when(~hidden, verdict).alias("ruled"))
    flag = lambda c: F.sum(F.when(c, 1).otherwise(0))
    seen = own.groupBy("host", "segments").agg(F.count(F.lit(1)).alias("n"), flag(F.col("ruled").isNotNull()).alias("labelled"), flag(F.col("ruled") == "block").alias("blocked"))
    tree = url_filter.templates(seen).select("host", "segments", "purity")
    got = own.where("truth is not null and ruled is null").join(tree, ["host", "segments"]).select("truth", F.when(F.col("purity") >= url_filter.THRESHOLD, "block").otherwise("allow").alias("found")).collect()
    assert len(got) > 400 and sum(r.truth == r.found for r in got) / len(got) > 0.9


def test_url_evidence(spark):
    """Urls are blocked with the branches they look like, unless these are few or disagree."""
    rules = [("h.bad.com", f"/{x}/", "block") for x in "abcde"] + [(f"{x}.farm.com", "/", "block") for x in "abcde"] + [("one.org", "/de/", "block")] + [("mix.net", f"/{x}/", "block" if x < "d" else "allow") for x in "abcdef"]
    urls = [f"http://{h}{p}x" for h, p, _ in rules] * 20 + [f"http://one.org/de/{x}" for x in "abcdefgh"] + [f"http://one.org/en/{x}{y}" for x in "abcdefghij" for y in "abcdefghijklmnop"]
    open_ = {"http://h.bad.com/z/page": "block", "http://new.farm.com/q": "block", "http://one.org/en/": "allow", "http://mix.net/z/": "allow", "http://else.com/a/": "allow"}
    rows = spark.createDataFrame(list(enumerate([*open_, *urls])), "page_id int, url string")
    got = {r.page_id: r for r in url_filter.judge(rows, rules=rules).collect()}
    assert all(got[k].rule is None for k in range(len(open_))) and [got[k].verdict for k in range(len(open_))] == list(open_.values())


@pytest.mark.parametrize("n", [40, 120])
def test_url_fan_and_depth(spark, n):
    """Neither many branches nor long paths change what is known of a site."""
    rules = [("example.com", "/de/", "block"), ("deep.com", "/a/b/c/d/", "block")]
    names = [f"{'abcdefghijkl'[k % 12]}{'abcdefghijkl'[k // 12]}x" for k in range(n)]
    urls = [f"http://example.com/{x}/{k}.html" for x in names for k in range(3)] + [f"http://deep.com/a/b/c/e/{k}" for k in range(n)]
    ruled = [f"http://example.com/de/{k}.html" for k in range(n // 2)] + [f"http://deep.com/a/b/c/d/{k}" for k in range(n // 5)]
    rows = spark.createDataFrame(list(enumerate(urls + ruled)), "page_id int, url string")
    got = {r.page_id: r for r in url_filter.judge(rows, rules=rules).collect()}
    assert len(got) == len(urls + ruled) and {got[k].verdict for k in range(len(urls))} == {"allow"}
    assert {got[k].verdict for k in range(len(urls), len(got))} == {"block"}
    assert {r.template for r in got.values()} == {"example.com/de", "example.com/**", "deep.com/a/b/c/d", "deep.com/a/b/c/**"}


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = corpus_pipeline.run(spark, SF).collect()
    bench = {tuple(w[k : k + 10]) for r in queries.table(spark, SF, "benchmark").collect() for w in [WORD.findall(low(r.text))] for k in range(max(1, len(w) - 9))}
    for r in rows:
        w = WORD.findall(low(r.text))
        assert not any(tuple(w[k : k + 10]) in bench for k in range(len(w)))
    texts = list({r.doc_id: _shingles(r.text) for r in rows}.values())
    assert not any(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(texts) for b in texts[:i] if a & b)
    assert {r.shard for r in rows} == set(range(16))


def test_pipeline_stages(spark, odd, none, docs):
    """Nulls, empty and long texts, repeated rows, clashing names and empty tables, in each stage."""
    stages = dict(pytest.importorskip("corpus_pipeline").STAGES)
    names = ("lang_pred", "score", "ambiguous", "shard", "Slot", "bucket", "class_id", "n_hit", "taken", "copies", "a.b", "odd name")
    clash = lambda df: df.withColumns({n: F.lit(k) for k, n in enumerate(names)})
    columns = clash(odd).columns
    # documents of known languages, so that the first stage has something to learn
    some = docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(1).alias(c) for c in ("size", "rank", "row", "doc")])
    rows = stash(clash(odd.unionByName(some)), "odd")
    for name, stage in list(stages.items())[:4]:
        got = stage(spark, rows, SF)
        assert got.columns == columns, name
        kept = got.collect()
        assert kept and all(r[n] == k for r in kept for k, n in enumerate(names)), name
        assert stage(spark, clash(none), SF).count() == 0, name
        texts = collections.Counter((r.doc_id, r.text) for r in kept)
        before = collections.Counter((r.doc_id, r.text) for r in rows.collect())
        assert all(k in before for k in texts) and (name == "mixing" or all(texts[k] <= before[k] for k in texts)), name
        if name == "language ID":
            assert not any(r.text is None or not re.search(r"[^\W\d_]", r.text) for r in kept)
        if name == "n-gram join":
            held = [r.doc_id for r in kept if r.doc_id is not None and r.text and "w0x0" in r.text.lower()]
            assert held == [0]
    shard = stages["sharding"]
    got = shard(spark, rows, SF)
    sizes = collections.Counter()
    for r in got.collect():
        sizes[r.shard] += r["size"]
        assert r["size"] == len((r.text or "").encode()) + 1 and r.doc_shard == 3 and r.doc_Slot == 4 and 0 <= r.shard < 16
    assert got.count() == rows.count() and shard(spark, clash(none), SF).count() == 0
    stash(got, "sharded")


def _bucket(gram, bits):
    h = 0
    for c in gram:
        h = (h * 0x01000193 + c + 1) % 2**32
    return ((h ^ (h >> 15) ^ len(gram)) * 0x9E3779B1) % 2**32 >> (32 - bits)


def test_language_scores_brute_force(spark, odd, docs):
    """A plain walk over the n-grams of each text gives the scores of the trained model."""
    model = language_id.train(docs, F.lit(True), sample=200)
    for r in language_id.languages(odd.withColumn("t", F.col("text")), model, keep=("t",)).collect():
        if r.lang_pred == "und" or len(r.t) > 5000:
            continue
        body = b" " + bytes(32 if 48 <= c <= 57 else c for c in lower_words(r.t.encode())) + b" " * 8
        n, bits = len(r.t.encode()) + 1, np.array(model.b, float)
        for at in range(n):
            for k, size in enumerate(language_id.SIZES):
                bits += model.w[:, k, _bucket(body[at : at + size], language_id.BITS)] / n
        loss = [sum(t * np.log1p(np.exp(-f * c)) for t, f, c in zip(model.trust, bits, word, strict=True)) for word in model.code]
        best = int(np.argmin(loss))
        assert r.lang_pred == model.langs[best] and abs(r.score - 1 / sum(np.exp(loss[best] - x) for x in loss)) < 1e-3


def test_toxicity_scores_brute_force(spark, odd):
    """A plain walk over the words of each text gives the scores of the trained model."""
    sf = "/root/testdata/sf0.01"
    model = toxicity.train(queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels"), F.lit(True))
    assert model.z is not None
    for r in toxicity.scores(odd.withColumn("t", F.col("text")), model, keep=("t",)).collect():
        words = lower_words((r.t or "").encode()).split()
        words = [w for k, w in enumerate(words) if not k or w != words[k - 1]]
        worst = []
        for a in range(0, max(len(words) - toxicity.WINDOW + toxicity.STRIDE, 1) if words else 0, toxicity.STRIDE):
            bag = [_bucket(s[i : i + n], toxicity.BITS) for w in words[a : a + toxicity.WINDOW] for s in [b" " + w + b" "] for n in toxicity.SIZES for i in range(len(s) - n + 1)]
            worst.append(float(model.z[bag].astype(float).sum()) / max(len(bag), 1) + model.bias)
        want = 1 / (1 + np.exp(-(model.steep * max(worst, default=model.bias) + model.shift)))
        assert abs(r.score - want) < 1e-3


def test_decontaminate_common_passage(spark):
    """A passage that all items and documents hold is one window with one set of items, in both ways of joining."""
    shared = " ".join(f"c{k}" for k in range(12))
    items = spark.createDataFrame([(f"i{k % 900}", f"own{k} {shared} tail{k}") for k in range(1000)] + [(None, shared)], "item_id string, text string")
    table = spark.createDataFrame([(k, f"x{k} {shared} y") for k in range(300)] + [(300, "own5 " + shared), (301, "c0 c1 c2")], "doc_id int, text string")
    names = sorted(f"i{k}" for k in range(900))
    for most in (decontaminate.ITEM_WORDS, 10):
        got = {r.doc_id: r for r in decontaminate.contamination(table, items, item_words=most).collect()}
        assert all((got[k].n_hit, got[k].n_items) == (12, 901) for k in range(300)) and got[300].n_hit == 13 and got[301].n_items == 0
        assert {r.items_sha256 for k, r in got.items() if k < 301} == {hashlib.sha256(",".join(names).encode()).hexdigest()}
    index = decontaminate.ItemIndex([str(k) for k in range(1000)], [f"own{k} {shared} tail{k}".encode() for k in range(1000)])
    assert len(index.windows[10][0]) == 2003 and len(index.sets) == 1001
