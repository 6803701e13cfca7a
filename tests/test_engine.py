import json

import duckdb
import pytest

from medlode import queries
from medlode.errors import Conflict, Gone, Invalid, NotFound
from medlode.functions.dates import interval, matches, sought
from medlode.operators import bundle, search, store
from medlode.operators.access import Access
from medlode.operators.audit import AUDIT_SCHEMA
from medlode.plans import registry
from medlode.sources import tables
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages")


def test_queries_equal_sql(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    plain = lambda rows: sorted(tuple("NULL" if x is None else str(x) for x in r) for r in rows)
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, SF)
        cols = sorted(df.columns)
        want = con.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()
        assert plain(df.select(*cols).collect()) == plain(want), name


@pytest.mark.parametrize(
    ("stored", "yes", "no"),
    [
        ("1987-02", "ne1987-02-14 gt1987-02-14 ge1987-02-14 lt1987-02-14 le1987-02-14 eq1987", "eq1987-02-14 sa1987-02-14 eb1987-02-14 eq1986"),
        ({"start": "2019-12-28", "end": "2020-01-03"}, "sa2019-12-27 lt2020 ge2020 eb2020-01-04", "eq2019 eq2019-12 gt2020-01-03 eb2020-01-03"),
        ({"event": ["2017-03-31T23:59:59Z", "2017-04-01T00:00:00Z"]}, "eq2017 gt2017-03-31 lt2017-04 sa2017-03-30", "eq2017-03 eq2017-04-01"),
        ({"end": "2011-05-09"}, "le2011 ne2011 eb2011-05-10", "eq2011 gt2011-05-09"),
        ("2022-10-30T02:15+02:00", "eq2022-10-30T00:15Z eq2022-10-30", "eq2022-10-29 eq2022-10-30T02:15Z"),
        ("soon", "", "eq2022 ne2022"),
    ],
)
def test_date_truth(spark, stored, yes, no):
    v = F.parse_json(F.lit(json.dumps(stored)))
    row = spark.range(1).select(*[F.coalesce(matches(*interval(v), sought(q)), F.lit(False)).alias(q) for q in (yes + " " + no).split()]).first().asDict()
    assert row == {q: True for q in yes.split()} | {q: False for q in no.split()}


def _history(spark):
    rows = [("t", "Patient", "a", 1, False), ("t", "Patient", "a", 2, False), ("t", "Patient", "b", 1, False), ("t", "Patient", "b", 2, True)]
    df = spark.createDataFrame(rows, "tenant_id string, resource_type string, id string, version_id bigint, deleted boolean")
    return df.withColumn("last_updated", F.current_timestamp()).withColumn("resource", F.parse_json(F.lit('{"resourceType":"Patient"}')))


def test_pages_cover_all_rows_once(spark):
    rows = spark.range(6).select(F.lit("t").alias("tenant_id"), F.lit("Patient").alias("resource_type"), F.concat(F.lit("r"), "id").alias("id"), F.lit(1).alias("version_id"), F.timestamp_seconds(F.col("id") % 2).alias("last_updated"), F.parse_json(F.lit('{"active":true}')).alias("resource"))
    seen, after = [], ""
    while True:
        page = search.find(rows, Access("t"), "Patient", f"active=true&_sort=-_lastUpdated&_count=2{after}")
        seen += [r.id for r in page.rows]
        assert page.total == 6
        if not page.next:
            break
        after = f"&_after_id={page.next}"
    assert seen == ["r1", "r3", "r5", "r0", "r2", "r4"]
    assert search.find(rows, Access("other"), "Patient", "active=true").total == 0


def test_versions(spark):
    h = _history(spark)
    assert store.read(h, "t", "Patient", "a").version_id == 2
    with pytest.raises(Gone):
        store.read(h, "t", "Patient", "b")
    with pytest.raises(NotFound):
        store.read(h, "t", "Patient", "c")
    rows, after = store.versions(h, "t", "Patient", "b", "_count=1")
    assert [r.version_id for r in rows] == [2] and after == 2
    page = store.history_bundle(rows, "Patient", "b", "https://x/", "_count=1", after)
    assert page["entry"][0]["response"]["status"] == "410 Gone" and page["entry"][0]["fullUrl"] == "https://x/Patient/b/_history/2" and "total" not in page
    assert [x["url"] for x in page["link"]] == ["https://x/Patient/b/_history?_count=1", "https://x/Patient/b/_history?_count=1&_after_id=2"]
    for bad in ("_count=0", "_count=2049", "_sort=_id", "_after_id=0", "_after_id=", "_count=1&_count=2", "_offset=3"):
        with pytest.raises(Invalid):
            store.versions(h, "t", "Patient", "b", bad)


def test_bundles(spark):
    h = _history(spark)
    put = {"request": {"method": "PUT", "url": "Patient/b"}, "resource": {"resourceType": "Patient"}}
    out, rows, audit = bundle.process(h, Access("t"), "transaction", [put])
    assert out[0]["response"]["status"] == "201 Created" and rows.first().version_id == 3 and audit.count() == 2
    assert out[0]["response"]["etag"] == 'W/"3"' and out[0]["resource"]["id"] == "b" and out[0]["response"]["lastModified"].endswith("Z")
    with pytest.raises(Conflict):
        bundle.process(h, Access("t"), "transaction", [put, put])
    get = lambda key: {"request": {"method": "GET", "url": f"Patient/{key}"}}
    gone = {"request": {"method": "DELETE", "url": "Patient/zz", "ifMatch": 'W/"1"'}}
    other = {"request": {"method": "GET", "url": "Thing/1"}}
    out, rows, audit = bundle.process(h, Access("t"), "batch", [get("zz"), put, get("a"), gone, other])
    assert [r["response"]["status"] for r in out] == ["404 Not Found", "201 Created", "200 OK", "404 Not Found", "400 Bad Request"] and rows.count() == 1
    assert out[2]["resource"] == {"resourceType": "Patient"} and out[3]["response"]["outcome"]["issue"][0]["code"] == "not-found"
    assert sorted(r.http_status for r in audit.collect()) == [200, 200, 201, 400, 404, 404]
    with pytest.raises(Invalid):
        bundle.process(h, Access("t"), "message", [])


def test_commit_is_whole_or_nothing(spark, tmp_path):
    h, path = _history(spark), str(tmp_path / "log")
    empty = spark.createDataFrame([], AUDIT_SCHEMA)
    store.commit(path, h, empty)
    # a writer that died before its last write
    h.write.partitionBy("tenant_id", "resource_type").parquet(f"{path}/history/commit=dead")
    assert store.committed(spark, path, "history").count() == 4 and store.committed(spark, path, "audit").count() == 0


def test_plans(spark):
    """A search reads its tenant's and type's folders; operations read the history of their keys."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found = plan(queries.queries()["tenant_isolation"](spark, SF))
    assert "PartitionFilters: [isnotnull(tenant_id" in found.replace("\n", "") and "parse_json" not in found
    kept = queries._kept(queries.fx.history, spark, SF)
    assert "LeftSemi" in plan(store.upsert(kept, queries._ops(spark, SF)))
    assert "PushedFilters" in plan(queries.queries()["near_indexed"](spark, SF)) and "GreaterThanOrEqual(latitude" in plan(queries.queries()["near_indexed"](spark, SF))


def test_conditions_need_a_parameter():
    with pytest.raises(Invalid):
        search.conditional("Patient", "_count=1")


def test_ingest(spark, tmp_path):
    lines = ['{"resourceType":"Patient","id":"1"}', "nonsense", '{"id":"2"}', '{"resourceType":"Patient"}', '{"resourceType":"Patient","id":"3","x":"' + "y" * tables.LARGEST + '"}']
    (tmp_path / "in.json").write_text("\n".join(lines))
    assert [r.id for r in tables.ingest_json(spark, str(tmp_path / "in.json"), "t").select("id").collect()] == ["1"]
    got = {r.reason: r.lines for r in tables.refused_lines(spark, str(tmp_path / "in.json")).collect()}
    assert got == {"not JSON": 1, "no type": 1, "no id": 1, "too large": 1}


def test_load_definitions(spark, tmp_path):
    own = {"resourceType": "SearchParameter", "code": "serial", "type": "string", "base": ["Device"], "expression": "Device.serialNumber"}
    (tmp_path / "d.json").write_text(json.dumps({"resourceType": "Bundle", "entry": [{"resource": own}]}))
    assert registry.load(spark, str(tmp_path / "d.json"))["Device"]["serial"].path.segments == ("serialNumber",)
