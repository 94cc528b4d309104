import json
import logging
from datetime import UTC, date, datetime

import pytest
from pyspark.sql import functions as F

from facetloom import FacetDataset, FacetQuery, function_tool, load, query_schema, save
from facetloom.plans.manifest import Field, Manifest
from facetloom.plans.query import normalize
from facetloom.streaming.counts import stream_facet_counts, windowed_facet_counts

from .naive import facet_counts

ROWS = [
    (1, "open", ["a", "b", "a"], 5.0, "z1", "North", "2025-01-01T00:00:00Z"),
    (2, "closed", ["c"], 6.0, "z2", "North", "not a date"),
    (3, None, [], 5.0, "z1", "Upper", None),
    (4, "", None, float("nan"), None, "Nowhere", "2025-03-01T00:00:00Z"),
    (5, "open", ["a", None], None, "z3", None, "2025-02-01T00:00:00Z"),
]
SCHEMA = "id long, status string, tags array<string>, n double, zone string, zone_name string, made string"
CONFIG = {"dataset_id": "tickets", "facets": ["status", "tags", "zone"], "ranges": ["n", "made"], "aliases": {"zone_name": "zone"}}


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA).coalesce(1).cache()


@pytest.fixture(scope="module")
def ds(df):
    return FacetDataset.create(df, CONFIG)


@pytest.fixture(scope="module")
def compat(df):
    return FacetDataset.create(df, CONFIG, compat=True)


def ids(ds, **query):
    return sorted(r["id"] for r in ds.query(**query).items.collect())


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ({}, [1, 2, 3, 4, 5]),
        ({"equal": {"status": "open"}}, [1, 5]),
        ({"equal": {"status": ["open", "closed", "open"]}}, [1, 2, 5]),
        ({"equal": {"status": []}}, []),
        ({"equal": {"status": ""}}, [4]),
        ({"equal": {"status": None}}, [3]),
        ({"equal": {"status": [None, None]}}, [3]),
        ({"equal": {"status": ["open", None]}}, [1, 3, 5]),
        ({"equal": {"status": ["gone", None]}}, [3]),
        ({"equal": {"status": ["open", None], "zone": "z1"}}, [1, 3]),
        ({"equal": {"tags": "a"}}, [1, 5]),
        ({"equal": {"tags": ["b", "c"]}}, [1, 2]),
        ({"equal": {"tags": "null"}}, [5]),
        ({"equal": {"n": 5}}, []),
        ({"not_equal": {"status": "open"}}, [2, 3, 4]),
        ({"not_equal": {"status": None}}, [1, 2, 4, 5]),
        ({"not_equal": {"status": ["open", None]}}, [2, 4]),
        ({"not_equal": {"status": []}}, [1, 2, 3, 4, 5]),
        ({"not_equal": {"tags": "a"}}, [2, 3, 4]),
        ({"not_equal": {"tags": "c"}}, [1, 3, 4, 5]),
        ({"not_equal": {"n": 5}}, [2, 4, 5]),
        ({"ranges": {"n": {}}}, [1, 2, 3]),
        ({"ranges": {"n": {"min": 5, "max": 5}}}, [1, 3]),
        ({"ranges": {"n": {"min": float("nan")}}}, [1, 2, 3]),
        ({"ranges": {"made": {"min": 1735689600000, "max": 1738368000000}}}, [1, 5]),
        ({"ranges": {"made": None}}, [1, 4, 5]),
        ({"ranges": {"status": {}}}, []),
        ({"is_null": ["tags"]}, [4]),
        ({"is_null": ["status", "tags"]}, []),
        ({"is_not_null": ["tags", "status"]}, [1, 2, 5]),
        ({"is_not_null": ["made"]}, [1, 2, 4, 5]),
        ({"equal": {"nope": 1}}, []),
        ({"not_equal": {"nope": 1}}, []),
        ({"is_null": ["nope"]}, []),
        ({"equal": {"zone_name": "North"}}, [1, 2, 3]),
        ({"equal": {"zone_name": ["Upper", "gone"]}}, [1, 3]),
        ({"equal": {"zone_name": "gone"}}, []),
        ({"equal": {"zone_name": "North", "zone": "z2"}}, [2]),
        ({"equal": {"zone_name": ["Upper", None]}}, [1, 3, 5]),
        ({"equal": {"zone_name": None}}, [5]),
        ({"not_equal": {"zone_name": "Upper"}}, [2, 4, 5]),
        ({"not_equal": {"zone_name": "gone"}}, [1, 2, 3, 4, 5]),
        ({"is_null": ["zone_name"]}, [5]),
        ({"is_null": ["status"], "equal": {"status": ["open", None]}}, [3]),
        ({"isNotNull": ["status"], "notEqual": {"status": "open"}}, [2, 4]),
    ],
)
def test_filters(ds, query, expected):
    assert ids(ds, **query) == expected


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ({"equal": {"status": ["open", None], "zone": "z1"}}, [1, 3]),
        ({"equal": {"status": ["closed", None], "zone": "z1"}}, []),  # the values alone find nothing
        ({"equal": {"status": ["open", None], "zone": "z3"}}, [3, 5]),  # nulls join the whole set
        ({"equal": {"status": ["gone", None]}}, []),
        ({"is_null": ["status"], "equal": {"status": ["open", None]}}, [1, 3, 5]),
        ({"equal": {"zone": "z2", "zone_name": "Upper"}}, [1, 3]),  # the last filter on a target wins
    ],
)
def test_compat_corners(compat, query, expected):
    assert ids(compat, **query) == expected


def test_many_totals_from_one_scan(ds):
    asks = [{}, {"equal": {"status": "open"}}, {"equal": {"nope": 1}}, {"equal": {"zone_name": "North"}, "ranges": {"n": {}}}, {"not_equal": {"tags": "a"}}, {"is_null": ["tags"]}]
    assert ds.totals(asks) == [ds.total(a) for a in asks] == ds.totals(asks, at_once=2)
    assert ds.totals([]) == []


def test_keys_match_across_types(spark):
    df = spark.createDataFrame([(1, True, "5"), (2, False, "true"), (3, None, "5.0")], "k int, flag boolean, s string")
    ds = FacetDataset.create(df, {"dataset_id": "x", "facets": ["k", "flag", "s"]})
    assert ds.total(equal={"k": "1"}) == 1
    assert ds.total(equal={"k": "1.0"}) == 0
    assert ds.total(equal={"k": 1.0}) == 1
    assert ds.total(equal={"flag": "true"}) == 1
    assert ds.total(equal={"s": 5}) == 1
    assert ds.total(equal={"s": True}) == 1


def test_pages_are_in_order(ds):
    page = lambda **q: [r["id"] for r in ds.query(**q).items.collect()]
    assert page(limit=2) == [1, 2]
    assert page(limit=2, offset=3) == [4, 5]
    assert page(offset=-4, limit=1) == [1]
    assert page(limit=-1) == []
    assert page(limit=0) == []
    assert page(offset=3) == [4, 5]
    assert page(offset=99) == []
    assert ds.query(limit=0, equal={"status": "open"}).total == 2


def test_scan_order_without_id(spark):
    df = spark.createDataFrame([(x,) for x in "dbca"], "v string").coalesce(1)
    ds = FacetDataset.create(df, {"dataset_id": "x", "facets": ["v"]})
    assert [r["v"] for r in ds.query(limit=3, offset=1).items.collect()] == ["b", "c", "a"]
    assert ds.query(limit=1).items.columns == ["v"]


def test_select(ds):
    assert ds.query(select=["status", "nope", "id", "status"]).items.columns == ["status", "id"]
    assert ds.query(select=[]).items.columns == []
    assert ds.query(select=["id"], include_facet_counts=True).total == 5


def test_facet_counts(ds):
    found = ds.query(include_facet_counts=True, equal={"tags": "a"})
    rows = [dict(zip(SCHEMA_NAMES, r, strict=True)) for r in ROWS if r[0] in (1, 5)]
    assert found.facet_dict == facet_counts(rows, ["status", "tags", "zone"])
    assert found.total == 2
    assert found.facet_dict["tags"] == {"a": 3, "b": 1, "null": 1}
    assert {(r["field"], r["value"], r["count"]) for r in found.facets.collect()} >= {("tags", "a", 3), ("status", "open", 2)}
    none = ds.query(include_facet_counts=True, equal={"status": "gone"})
    assert none.facet_dict == {"status": {}, "tags": {}, "zone": {}} and none.total == 0
    assert ds.query().facets is None


def test_facets_of_every_type(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (TIMESTAMP_NTZ '2025-01-01 00:00:00.0001', DATE '2025-01-01', 1.50BD, CAST(0.5 AS FLOAT), true, array(1, null, 1)),"
        " (TIMESTAMP_NTZ '2025-01-01 00:00:00.0009', DATE '2025-01-02', 1.5BD, CAST(-0.0 AS FLOAT), null, null), (null, null, null, CAST('NaN' AS FLOAT), false, array()) AS t(at, day, dec, f, b, a)"
    )
    ds = FacetDataset.create(df, {"dataset_id": "x", "facets": df.columns})
    found = ds.query(include_facet_counts=True)
    expected = {
        "at": {"2025-01-01T00:00:00.000Z": 2}, "day": {"2025-01-01T00:00:00.000Z": 1, "2025-01-02T00:00:00.000Z": 1}, "dec": {"1.5": 2},
        "f": {"0.5": 1, "0": 1, "NaN": 1}, "b": {"true": 1, "false": 1}, "a": {"1": 2, "null": 1},
    }
    assert found.facet_dict == expected and found.total == 3
    listed = {}
    for r in found.facets.collect():
        assert r["value"] not in listed.setdefault(r["field"], {})
        listed[r["field"]][r["value"]] = r["count"]
    assert listed == expected
    for field, counts in expected.items():
        for key, n in counts.items():
            assert ds.total(equal={field: key}) == (n if field != "a" else 1)


SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def test_compat_facets_of_nothing(compat):
    assert compat.query(include_facet_counts=True, equal={"status": []}).facet_dict is None


def test_facet_summary(spark, ds):
    listed = lambda d, f, **q: [tuple(r) for r in d.facet_summary(f, **q).collect()]
    assert listed(ds, "tags") == [("a", 3), ("b", 1), ("c", 1)]
    assert listed(ds, "nope") == [] and listed(ds, "n") == []
    assert listed(ds, "status", ranges={"n": {"min": 6}}) == [("closed", 1)]
    df = spark.createDataFrame([(x, i % 2 == 0) for i, x in enumerate(["b", "B", "a", "A", "é", "Z", "_"])], "s string, f boolean")
    other = FacetDataset.create(df, {"dataset_id": "x", "facets": ["s", "f"]})
    assert [v for v, _ in listed(other, "s")] == ["_", "a", "A", "b", "B", "é", "Z"]
    assert listed(other, "f") == [(False, 3), (True, 4)]


def test_aliases(ds):
    assert ds.alias_values("zone_name", "z1") == ["North", "Upper"]
    assert ds.alias_values("zone_name", "z9") == [] and ds.alias_values("nope", "z1") == []
    got = {r["id"]: r["zone_name"] for r in ds.query(enrich_aliases=True).items.collect()}
    assert got == {1: ["North", "Upper"], 2: ["North"], 3: ["North", "Upper"], 4: ["Nowhere"], 5: None}
    assert "zone_name" not in ds.query(enrich_aliases=True, select=["id"]).items.columns
    assert ds.query(enrich_aliases=["nope"]).items.schema["zone_name"].dataType.simpleString() == "string"
    assert ds.query(enrich_aliases=[]).items.schema["zone_name"].dataType.simpleString() == "string"


def test_enriching_arrays(spark, ds):
    items = spark.createDataFrame([(1, ["z2", "z1", None]), (2, []), (3, None)], "id long, zone array<string>")
    got = {r["id"]: r["zone_name"] for r in ds.enrich(items, ["zone_name"]).collect()}
    assert got == {1: ["North", "Upper"], 2: None, 3: None}


def test_joins_find_what_literals_find(spark):
    """Null alternatives, two aliases of one target, times, and the order that compat keeps."""
    rows = [(i, i % 7 if i % 5 else None, f"n{i % 7 % 3}" if i % 4 else None, f"m{i % 7 % 2}", datetime(2025, 1, 1 + i % 3, tzinfo=UTC) if i % 6 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, k long, name string, mood string, t timestamp")
    config = {"dataset_id": "x", "facets": ["k", "t"], "aliases": {"name": "k", "mood": "k"}}
    day = {"dataset_id": "x", "facets": ["t"], "aliases": {"name": "t"}}
    queries = [
        {"equal": {"name": "n1"}}, {"equal": {"name": ["n1", None]}}, {"equal": {"name": [None, "n2", "n0"], "mood": "m1"}}, {"equal": {"name": ["n1", "nope"]}},
        {"not_equal": {"name": "n1"}}, {"not_equal": {"name": ["n1", None]}}, {"equal": {"mood": "m0"}, "not_equal": {"name": "n2"}}, {"equal": {"name": "nope"}}, {"equal": {"name": ["nope", None]}},
    ]
    for made in (config, day):
        for compat in (False, True):
            plain, joined = (FacetDataset.create(df, made, compat=compat) for _ in range(2))
            joined.max_literals = 0
            for q in queries:
                if made is config or "mood" not in str(q):
                    ids = [[r["id"] for r in d.query(**q, limit=100).items.collect()] for d in (plain, joined)]
                    assert ids[0] == ids[1] and joined.total(**q) == len(ids[0]), (made, compat, q)


def test_enriched_pages_keep_their_order(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    df = spark.range(200).select("id", (F.col("id") % 17).alias("k"), F.concat(F.lit("n"), F.col("id") % 17).alias("name"), F.lit(1).alias("__id"), F.lit(2).alias("__number"), F.lit(3).alias("__row_id"))
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        ds = FacetDataset.create(df, {"dataset_id": "x", "facets": ["k"], "aliases": {"name": "k"}})
        rows = ds.query(limit=60, offset=5, enrich_aliases=True).items.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [r["id"] for r in rows] == list(range(5, 65))
    assert all(r["name"] == [f"n{r['id'] % 17}"] and (r["__id"], r["__number"], r["__row_id"]) == (1, 2, 3) for r in rows)


def test_scan_order_does_not_follow_the_split(spark, tmp_path):
    """Successive pages of a table without ids, with another split for each: no row comes twice."""
    spark.range(400).select(F.col("id").alias("n"), F.lit("x").alias("s")).repartition(5).write.parquet(str(tmp_path / "t"))
    key = "spark.sql.files.maxPartitionBytes"
    before, seen = spark.conf.get(key), []
    try:
        for at, size in enumerate(("128m", "600", "1500", "900")):
            spark.conf.set(key, size)
            ds = FacetDataset.create(spark.read.parquet(str(tmp_path / "t")), {"dataset_id": "x", "facets": ["s"], "ranges": ["n"]})
            seen += [r["n"] for r in ds.query(limit=100, offset=100 * at).items.collect()]
    finally:
        spark.conf.set(key, before)
    assert sorted(seen) == list(range(400))
    held = FacetDataset.create(spark.read.parquet(str(tmp_path / "t")), {"dataset_id": "x", "facets": ["s"]}).persist()
    assert held.query(limit=3).items.columns == ["n", "s"] == held.query().items.columns
    assert [r["n"] for r in held.query(limit=100).items.collect()] == seen[:100]
    held.dispose()


def test_stored_totals_take_every_spelling(spark, tmp_path):
    rows = [(i, datetime(2025, 1, 1 + i % 3, 12 * (i % 2), tzinfo=UTC), date(2025, 1, 1 + i % 3), i % 4 / 2) for i in range(24)]
    ds = FacetDataset.create(spark.createDataFrame(rows, "id long, t timestamp, d date, x double"), {"dataset_id": "x", "facets": ["t", "d", "x"]})
    save(ds, str(tmp_path / "s"))
    back = load(spark, str(tmp_path / "s"))
    first = 1735689600000
    for f, v in [("t", first), ("t", str(first)), ("t", datetime(2025, 1, 1, tzinfo=UTC)), ("t", date(2025, 1, 1)), ("t", [first, "2025-01-01T00:00:00.000Z"]), ("t", "2025-01-01"), ("d", first), ("d", first + 1), ("d", date(2025, 1, 2)), ("d", "2025-01-01T00:00:00.000Z"), ("x", 0.5), ("x", "0.50"), ("x", 1), ("x", "1"), ("x", [])]:
        assert back.total(equal={f: v}) == ds.query(equal={f: v}).matches.count() == back.query(equal={f: v}).total, (f, v)
    assert back.total(equal={"t": first}) == 4


def test_many_ids_are_joined(spark):
    df = spark.range(20).select("id", (F.col("id") % 10).alias("k"), F.when(F.col("id") % 10 < 8, "low").otherwise("high").alias("name"))
    ds = FacetDataset.create(df, {"dataset_id": "x", "facets": ["k"], "aliases": {"name": "k"}})
    ds.max_literals = 3
    assert ds.plan(equal={"name": "low"}).joins and not ds.plan(equal={"name": "high"}).joins
    assert ds.total(equal={"name": "low"}) == 16
    assert ds.total(not_equal={"name": "low"}) == 4
    assert ds.total(equal={"name": "high"}) == 4


def test_configuration(spark, df, caplog):
    m = FacetDataset.create(df, {"dataset_id": "x", "facets": ["status"], "ranges": ["made", "n"], "meta": ["status", "zone"]}).describe()
    assert {f.name: (f.kind, f.type) for f in m.fields} == {"id": ("id", "number"), "status": ("facet", "string"), "made": ("range", "date"), "n": ("range", "number"), "zone": ("meta", "string"), "tags": ("meta", "string"), "zone_name": ("meta", "string")}
    assert FacetDataset.create(df, {"dataset_id": "x", "equal": ["status"], "auto_meta": False}).describe().of_kind("meta") == []
    with caplog.at_level(logging.WARNING):
        FacetDataset.create(df, {"dataset_id": "x", "fields": {"gone": {"kind": "facet", "type": "string"}}})
    assert "gone" in caplog.text
    for bad in (
        {"fields": {}},
        {"fields": {"id": {"kind": "nope", "type": "string"}}},
        {"fields": {"id": {"kind": "facet", "type": "nope"}}},
        {"fields": {"id": {"kind": "range", "type": "string"}}},
        {"fields": {"zone_name": {"kind": "alias", "type": "string"}}},
        {"fields": {"zone_name": {"kind": "alias", "type": "string", "target": "zone"}}},
        {"fields": {"zone": {"kind": "meta", "type": "string"}, "zone_name": {"kind": "alias", "type": "string", "target": "zone"}}},
        {"ranges": ["status"]},
        {"ranges": ["tags"]},
    ):
        with pytest.raises(ValueError):
            FacetDataset.create(df, {"dataset_id": "x", **bad})
    nested = spark.sql("SELECT 1 AS id, struct(1 AS a) AS s")
    with pytest.raises(ValueError):
        FacetDataset.create(nested, {"dataset_id": "x", "facets": ["s"]})
    assert FacetDataset.create(nested, {"dataset_id": "x", "facets": ["id"]}).query().items.columns == ["id", "s"]


def test_manifest_capabilities():
    raw = Manifest("x", (Field("a", "facet", "string"), Field("b", "range", "number")), "t").to_dict()
    assert Manifest.from_dict(raw).to_dict() == raw
    for bad in ({"facets": ["a", "zz"]}, {"facets": []}, {"facets": ["a", "b"]}):
        with pytest.raises(ValueError):
            Manifest.from_dict(raw | {"capabilities": raw["capabilities"] | bad})
    for bad in ({"version": "2.0.0"}, {"version": ""}, {"fields": []}, {"fields": raw["fields"] + raw["fields"][:1]}):
        with pytest.raises(ValueError):
            Manifest.from_dict(raw | bad)


def test_lifecycle(df):
    ds = FacetDataset.create(df, CONFIG)
    shown = ds.query(equal={"status": "open"})
    assert shown.applied == {"equal": {"status": "open"}}
    assert set(shown.snapshot) == {"datasetId", "builtAt", "indexVersion"}
    other = FacetDataset.create(df.select("*"), CONFIG)
    other.dispose()
    other.dispose()
    assert other.is_disposed and other.describe().dataset_id == "tickets" and other.snapshot()["datasetId"] == "tickets"
    for use in (lambda: other.query(), lambda: other.query(equal={"nope": 1}), lambda: other.facet_summary("status"), lambda: other.alias_values("zone_name", "z1"), lambda: other.df):
        with pytest.raises(RuntimeError, match="disposed"):
            use()
    with pytest.raises(TypeError):
        FacetQuery.of({"sort": "id"})


def test_tool_schema(ds):
    schema = query_schema(ds.describe())
    parts = schema["properties"]
    assert list(parts) == ["equal", "notEqual", "ranges", "isNull", "isNotNull", "limit", "offset", "includeFacetCounts", "enrichAliases"]
    assert not schema["additionalProperties"] and not parts["equal"]["additionalProperties"]
    assert list(parts["equal"]["properties"]) == ["status", "tags", "zone", "zone_name"]
    assert parts["ranges"]["properties"]["made"]["description"] == "min/max as Unix ms"
    assert parts["isNull"]["items"]["enum"] == ["status", "tags", "zone", "zone_name"]
    tool = function_tool(ds.describe(), "find")
    assert tool["type"] == "function" and "zone_name" in tool["function"]["description"] and tool["function"]["parameters"] == schema
    assert function_tool(ds.describe(), "find", "mine")["function"]["description"] == "mine"
    json.dumps(tool)
    plain = Manifest("x", (Field("a", "facet", "date"), Field("b", "facet", "boolean")), "t")
    assert "enrichAliases" not in query_schema(plain)["properties"]
    assert query_schema(plain)["properties"]["equal"]["properties"]["a"]["anyOf"][0] == {"type": "string"}


def test_save_and_load(spark, ds, tmp_path):
    save(ds, str(tmp_path / "d"), cluster_by=["status"], bloom=["zone"])
    again = load(spark, str(tmp_path / "d"))
    assert again.describe() == Manifest.from_dict(ds.describe().to_dict())
    for query in ({}, {"equal": {"zone_name": "North"}}, {"equal": {"tags": "a"}}, {"ranges": {"made": {}}}):
        assert ids(again, **query) == ids(ds, **query)
    assert [r["id"] for r in again.query(limit=2, offset=1).items.collect()] == [2, 3]
    scan = FacetDataset.create(ds.df.drop("id"), {**CONFIG, "dataset_id": "s"})
    save(scan, str(tmp_path / "s"), cluster_by=["zone"])
    back = load(spark, str(tmp_path / "s"))
    assert [r["zone"] for r in back.query(limit=5).items.collect()] == ["z1", "z2", "z1", None, "z3"]
    assert "__row_id" not in back.query().items.columns


def test_stored_totals(spark, ds, tmp_path, monkeypatch):
    save(ds, str(tmp_path / "d"))
    save(ds, str(tmp_path / "plain"), totals=False)
    asks = [{}, {"equal": {"status": "open"}}, {"equal": {"status": ["open", "", "gone", "open"]}}, {"equal": {"status": []}}, {"equal": {"zone": 5}}]
    other = [{"equal": {"tags": "a"}}, {"equal": {"status": ["open", None]}}, {"equal": {"n": 5}}, {"equal": {"nope": 1}}, {"equal": {"zone_name": "North"}}, {"equal": {"status": "open", "zone": "z1"}}, {"not_equal": {"status": "open"}}, {"equal": {"status": None}}]
    for most in (100_000, 2):
        monkeypatch.setattr("facetloom.sources.store.MAX_HELD", most)
        again, plain = load(spark, str(tmp_path / "d")), load(spark, str(tmp_path / "plain"))
        for q in asks + other:
            assert again.total(q) == plain.total(q) == ds.total(q), q
            assert (again.stored_total(normalize(FacetQuery.of(q))) is not None) == (q in asks)
    empty = FacetDataset.create(ds.df.limit(0), CONFIG)
    save(empty, str(tmp_path / "e"))
    assert load(spark, str(tmp_path / "e")).total() == 0 == load(spark, str(tmp_path / "e")).total(equal={"status": "open"})
    again.dispose()
    with pytest.raises(RuntimeError):
        again.total()


def test_filters_reach_the_scan(spark, ds, tmp_path):
    save(ds, str(tmp_path / "d"))
    found = load(spark, str(tmp_path / "d")).query(equal={"status": ["open", "closed"]}, not_equal={"zone": "z2"}, select=["id"]).items
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(status, [closed,open])" in plan or "In(status" in plan
    assert "zone" in plan and "tags" not in plan.split("ReadSchema")[1]


def test_streams(spark, df, ds, tmp_path):
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    counts = stream_facet_counts(stream, ds.describe(), equal={"tags": "a"})
    counts.writeStream.format("memory").queryName("counts_now").outputMode("complete").start().processAllAvailable()
    got = {(r["field"], r["value"]): r["count"] for r in spark.table("counts_now").collect()}
    assert got[("tags", "a")] == 3 and got[("status", "open")] == 2
    for q in spark.streams.active:
        q.stop()
    timed = stream.withColumn("at", F.try_to_timestamp("made"))
    windows = windowed_facet_counts(timed, ds.describe(), "at", "40 days", "1 day")
    windows.writeStream.format("memory").queryName("windows_now").outputMode("update").start().processAllAvailable()
    assert spark.table("windows_now").filter("field = 'status'").agg(F.sum("count")).first()[0] == 3
    for q in spark.streams.active:
        q.stop()
