"""Steps that bring rows together by key: a task's rows stay bounded as tables grow, with the same results."""

import glob
import json

import pyarrow.parquet as pq
import pytest

from medlode.operators import store
from medlode.operators.access import Access
from medlode.operators.audit import of_outcomes
from medlode.sources import fixtures as fx
from medlode.sources import tables
from pyspark.sql import functions as F

IDS = 600
KINDS = [[("t", "A")], [("t", "A"), ("t", "B")], [("t", "A"), ("u", "A")], [("t", "A"), ("u", "B")]]
ALL = [(t, k) for t in "tu" for k in "AB"]


@pytest.fixture
def small(spark, monkeypatch):
    """Few rows are many, and nothing is broadcast."""
    monkeypatch.setattr(tables, "TASK_ROWS", 100, raising=False)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


@pytest.fixture
def usual(spark, monkeypatch):
    """Few rows are many; partitions and broadcasts are Spark's usual ones."""
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    key = "spark.sql.shuffle.partitions"
    kept = spark.conf.get(key)
    spark.conf.set(key, "200")
    yield
    spark.conf.set(key, kept)


def _versions(at: int, i: int) -> tuple[int, bool]:
    """Latest version of an id of a tenant and type, and whether it is a tombstone; the same id differs between these."""
    return (0, False) if (i + at) % 7 == 0 else (1 + (i + at) % 3, (i + at) % 5 == 0)


def _history(spark):
    rows = [(*ALL[at], str(i), v, v == n and gone, json.dumps({"id": str(i), "status": f"{at}-{v}"})) for at in range(4) for i in range(IDS) for n, gone in [_versions(at, i)] for v in range(1, n + 1)]
    df = spark.createDataFrame(rows, "tenant_id string, resource_type string, id string, version_id bigint, deleted boolean, body string")
    return df.withColumn("last_updated", F.current_timestamp()).withColumn("resource", F.parse_json("body")).drop("body")


def _ops(spark, kinds):
    rows = [(*k, str(i)) for k in kinds for i in range(IDS)]
    df = spark.createDataFrame(rows, "tenant_id string, resource_type string, id string")
    if len(kinds) == 1:  # as constants, which Spark takes out of joins
        df = df.select(F.lit(kinds[0][0]).alias("tenant_id"), F.lit(kinds[0][1]).alias("resource_type"), "id")
    return df.withColumn("version_id", F.lit(2).cast("long")).withColumn("resource", F.parse_json(F.lit('{"status":"new"}')))


def _run(out):
    """Rows by key; no task may get more than a few."""
    rows = out.withColumn("task", F.spark_partition_id()).collect()
    by = {}
    for r in rows:
        by[r.task] = by.get(r.task, 0) + 1
    assert max(by.values()) <= 100
    return {(r.tenant_id, r.resource_type, r.id): r for r in rows}


def _want(kinds, outcome):
    return {(*k, str(i)): outcome(*_versions(ALL.index(k), i)) for k in kinds for i in range(IDS)}


def _live(n, gone):
    return n > 0 and not gone


OUTCOMES = {
    "create": lambda n, gone: ("exists", None) if n else ("created", 1),
    "upsert": lambda n, gone: ("updated" if _live(n, gone) else "created", n + 1),
    "update": lambda n, gone: ("updated", n + 1) if _live(n, gone) else ("not-found", None),
    "compare_and_update": lambda n, gone: ("updated", 3) if _live(n, gone) and n == 2 else ("mismatch", None),
    "delete": lambda n, gone: ("deleted", n + 1) if _live(n, gone) else ("not-found", None),
    "compare_and_delete": lambda n, gone: ("not-found", None) if not _live(n, gone) else ("deleted", 3) if n == 2 else ("mismatch", None),
}


def _check_outcomes(spark, name):
    for kinds in KINDS:
        out = getattr(store, name)(_history(spark), _ops(spark, kinds))
        assert out.columns[:3] == store.KEY
        got = _run(out)
        assert {k: (r.outcome, r.new_version) for k, r in got.items()} == _want(kinds, OUTCOMES[name]), kinds


def test_patch(spark, small):
    steps = F.when(F.col("id").cast("int") % 3 == 0, '[{"op":"test","path":"/id","value":"?"}]').otherwise('[{"op":"replace","path":"/status","value":"done"}]')
    for kinds in KINDS:
        ops = _ops(spark, kinds).drop("resource").withColumn("version_id", F.lit(None).cast("long")).withColumn("steps", steps)
        out = store.patch(_history(spark), ops)
        got = {k: (r.outcome, r.new_version, r.own) for k, r in _run(out.select(*store.KEY, "outcome", "new_version", F.to_json("resource").alias("own"))).items()}
        want = _want(kinds, lambda n, gone: n if _live(n, gone) else 0)
        assert got == {k: ("not-found", None, None) if not n else ("invalid", None, None) if int(k[2]) % 3 == 0 else ("patched", n + 1, json.dumps({"id": k[2], "status": "done"}, separators=(",", ":"))) for k, n in want.items()}, kinds


def test_appended(spark, small):
    for kinds in KINDS:
        h = _history(spark)
        rows = store.appended(h, store.delete(h, _ops(spark, kinds)), F.current_timestamp())
        got = {k: (r.version_id, r.deleted, r.status) for k, r in _run(rows.select(*store.KEY, "version_id", "deleted", F.expr("variant_get(resource, '$.status', 'string')").alias("status"))).items()}
        want = _want(kinds, lambda n, gone: n if _live(n, gone) else 0)
        assert got == {k: (n + 1, True, f"{ALL.index(k[:2])}-{n}") for k, n in want.items() if n}, kinds


def test_written_pieces(spark, tmp_path):
    """Rows of one tenant and type are cut to tasks' shares, each file in order of ids."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    rows = spark.range(0, 60000, 1, 16).select(F.lit("t").alias("tenant_id"), F.lit("A").alias("resource_type"), F.sha2(F.col("id").cast("string"), 256).alias("id"))
    kept = spark.conf.get(key)
    spark.conf.set(key, "64k")
    try:
        tables.write_resources(rows, str(tmp_path / "r"), "errorifexists")
    finally:
        spark.conf.set(key, kept)
    files = [pq.ParquetFile(f).read().column("id").to_pylist() for f in glob.glob(f"{tmp_path}/r/*/*/*.parquet")]
    assert sorted(x for f in files for x in f) == sorted(r.id for r in rows.select("id").collect())
    assert max(map(len, files)) < 6000 and all(f == sorted(f) for f in files)


def test_written_rows(spark, tmp_path, monkeypatch):
    """Rows are cut to tasks' shares however small they are on disk, versions of one id too; small types stay whole."""
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    kind = F.when(F.col("id") < 4000, "A").when(F.col("id") < 7000, "B").otherwise(F.concat(F.lit("C"), (F.col("id") % 5).cast("string")))
    name = F.when(F.col("id") < 2000, "hot").otherwise(F.sha2(F.col("id").cast("string"), 256))
    rows = spark.range(0, 7100, 1, 4).select(F.when(F.col("id") % 2 == 0, "t").alias("tenant_id"), kind.alias("resource_type"), name.alias("id"), F.col("id").alias("version_id"))
    tables.write_resources(rows, str(tmp_path / "r"), "errorifexists")
    want = rows.collect()
    assert sorted(map(str, spark.read.schema(rows.schema).parquet(str(tmp_path / "r")).select(*rows.columns).collect())) == sorted(map(str, want))
    files = {f: pq.ParquetFile(f).read().column("id").to_pylist() for f in glob.glob(f"{tmp_path}/r/*/*/*.parquet")}
    assert max(map(len, files.values())) <= 150 and all(f == sorted(f) for f in files.values())
    assert len(files) == 2 * (20 + 15 + 5)


def test_written_many_small(spark, tmp_path, monkeypatch):
    """Types that are all small share tasks; a table without rows is written too."""
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    rows = spark.range(0, 1200, 1, 4).select(F.lit("t").alias("tenant_id"), F.concat(F.lit("K"), (F.col("id") % 60).cast("string")).alias("resource_type"), F.col("id").cast("string").alias("id"))
    for name, own in (("many", rows), ("none", rows.where("id < 0"))):
        tables.write_resources(own, str(tmp_path / name), "errorifexists")
        assert spark.read.schema(rows.schema).parquet(str(tmp_path / name)).count() == own.count()
    assert len(glob.glob(f"{tmp_path}/many/*/*/*.parquet")) == 60


def test_committed(spark, small, tmp_path):
    """Deletes and their audit rows are written by tasks of few rows, and all are read back."""
    kinds, path, at = KINDS[0], str(tmp_path / "log"), F.lit("2024-05-01T00:00:00Z").cast("timestamp")
    h = _history(spark)
    outcomes = store.delete(h, _ops(spark, kinds))
    store.commit(path, store.appended(h, outcomes, at), of_outcomes(outcomes, "DELETE", Access("t"), at))
    live = sum(_want(kinds, _live).values())
    assert store.committed(spark, path, "history").count() == live and store.committed(spark, path, "audit").count() == IDS
    for table, n in (("history", live), ("audit", IDS)):
        rows = [pq.ParquetFile(f).metadata.num_rows for f in glob.glob(f"{path}/{table}/**/*.parquet", recursive=True)]
        assert sum(rows) == n and max(rows) <= 100, table


def test_history_windows(spark, small, monkeypatch):
    """Lines are ranked in tasks of few rows."""
    rows = lambda: fx.history(spark, "/root/testdata/sf0.001").select("id", "version_id", "last_updated", "deleted", F.spark_partition_id().alias("task")).collect()
    monkeypatch.setattr(tables, "TASK_ROWS", 50, raising=False)
    dealt = rows()
    monkeypatch.setattr(tables, "TASK_ROWS", 1 << 18, raising=False)
    assert sorted(r[:-1] for r in dealt) == sorted(r[:-1] for r in rows())
    tasks = [r.task for r in dealt]
    assert max(map(tasks.count, set(tasks))) <= 300


def test_compare_and_delete(spark, small):
    _check_outcomes(spark, "compare_and_delete")


def test_compare_and_update(spark, small):
    _check_outcomes(spark, "compare_and_update")


def test_delete(spark, small):
    _check_outcomes(spark, "delete")


def test_update(spark, small):
    _check_outcomes(spark, "update")


def test_upsert(spark, small):
    _check_outcomes(spark, "upsert")


def test_create(spark, small):
    _check_outcomes(spark, "create")


def _check_usual(spark, name):
    """Operations and heads meet in tasks of few rows, none of them broadcast, though Spark would take both for small."""
    out = getattr(store, name)(_history(spark), _ops(spark, KINDS[0]))
    assert {k: (r.outcome, r.new_version) for k, r in _run(out).items()} == _want(KINDS[0], OUTCOMES[name])
    rows = out.groupBy().count()
    rows.collect()
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()


def test_usual_compare_and_delete(spark, usual):
    _check_usual(spark, "compare_and_delete")


def test_usual_compare_and_update(spark, usual):
    _check_usual(spark, "compare_and_update")


def test_usual_delete(spark, usual):
    _check_usual(spark, "delete")


def test_usual_update(spark, usual):
    _check_usual(spark, "update")


def test_usual_upsert(spark, usual):
    _check_usual(spark, "upsert")


def test_dealt_unheld(spark, usual):
    """More than 200 tasks, at which those that read hold their rows, come only with many rows a task."""
    got = {n: tables.dealt(spark.range(1), n, "id").rdd.getNumPartitions() for n in (401, 20_000, 20_001, 160_000, 160_001, 1_000_000)}
    assert got == {401: 200, 20_000: 200, 20_001: 200, 160_000: 200, 160_001: 256, 1_000_000: 2048}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [tables.dealt(spark.range(1), n, "id").rdd.getNumPartitions() for n in (401, 15_000, 160_001)] == [8, 200, 256]


def _check_many(spark, name):
    """A session of more partitions doesn't make tasks that read hold their rows: none deals to over 200."""
    key = "spark.sql.shuffle.partitions"
    spark.conf.set(key, "600")
    for kinds in KINDS[:3]:
        out = getattr(store, name)(_history(spark), _ops(spark, kinds)).select(*store.KEY, "outcome", "new_version")
        assert {(r.tenant_id, r.resource_type, r.id): (r.outcome, r.new_version) for r in out.collect()} == _want(kinds, OUTCOMES[name]), kinds
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert ", 200)" in plan and ", 600)" not in plan, kinds


def test_many_delete(spark, usual):
    _check_many(spark, "delete")


def test_many_update(spark, usual):
    _check_many(spark, "update")


def test_dealt_many(spark, usual):
    spark.conf.set("spark.sql.shuffle.partitions", "600")
    got = {n: tables.dealt(spark.range(1), n, "id").rdd.getNumPartitions() for n in (401, 20_001, 160_000, 160_001)}
    assert got == {401: 200, 20_001: 200, 160_000: 200, 160_001: 256}
