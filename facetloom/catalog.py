"""Registered queries of the faceted engine, each with the SQL it must agree with."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import FacetDataset, function_tool, load, save
from .functions.keys import key_text
from .streaming.counts import windowed_facet_counts

Query = Callable[[SparkSession, str], DataFrame]

#: Configurations of the datasets that the queries run on.
CONFIGS = {
    "orders": {"dataset_id": "orders", "id": "o_orderkey", "facets": ["o_orderstatus", "o_orderpriority", "o_custkey"], "ranges": ["o_orderdate", "o_totalprice"]},
    "lineitem": {"dataset_id": "lineitem", "facets": ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity"], "ranges": ["l_shipdate", "l_extendedprice", "l_discount"]},
    "lineitem_quantity": {"dataset_id": "lineitem", "facets": ["l_returnflag"], "ranges": ["l_quantity"]},
    "part": {"dataset_id": "part", "id": "p_partkey", "facets": ["p_brand", "p_type", "words"], "ranges": ["p_retailprice", "p_size"]},
    "documents": {"dataset_id": "documents", "id": "doc_id", "facets": ["lang", "source", "quality", "toxic"], "ranges": ["n_chars"]},
    "customer": {"dataset_id": "customer", "id": "c_custkey", "facets": ["c_nationkey", "c_mktsegment"], "ranges": ["c_acctbal"], "aliases": {"n_name": "c_nationkey", "r_name": "c_nationkey"}},
    "part_sizes": {"dataset_id": "part", "id": "p_partkey", "facets": ["p_size"], "aliases": {"shown": "p_size"}},
    "supplier_plain": {"dataset_id": "supplier", "id": "s_suppkey", "facets": ["s_nationkey"], "ranges": ["s_acctbal"]},
    "supplier": {"dataset_id": "supplier", "id": "s_suppkey", "facets": ["s_nationkey"], "aliases": {"s_name": "s_nationkey"}},
    "events": {"dataset_id": "events", "id": "event_id", "facets": ["event_type", "user_id"], "ranges": ["ts", "value"]},
    "orders_derived": {"dataset_id": "orders", "id": "o_orderkey", "facets": ["is_final", "o_orderdate"]},
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table under a configuration, with its derived columns."""
    read = lambda t: table(spark, sf_dir, t)
    if name == "documents":
        return read("documents").select("doc_id", "lang", "source", "n_chars").join(read("labels"), "doc_id", "left")
    if name == "part":
        return read("part").withColumn("words", F.split("p_name", " "))
    if name == "part_sizes":
        return read("part").withColumn("shown", F.when(F.col("p_size") <= 10, "tiny").when(F.col("p_size") <= 30, "middling"))
    if name == "customer":
        nation = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
        return read("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).drop("n_nationkey")
    if name == "orders_derived":
        return read("orders").withColumn("is_final", F.col("o_orderstatus") == "F")
    return read(name.split("_")[0])


def dataset(spark: SparkSession, sf_dir: str, name: str, compat: bool = False, joined: bool = False) -> FacetDataset:
    """The dataset of a configuration; ``joined`` takes alias filters through joins, however few ids they have."""
    config = {**CONFIGS[name], "auto_meta": name not in ("supplier", "customer")}
    out = FacetDataset.create(rows_of(spark, sf_dir, name), config, compat=compat)
    if joined:
        out.max_literals = 0
    return out


def new_folder(spark: SparkSession) -> str:
    """A folder that all machines share, removed when the session ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared}/saved-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def stored(spark: SparkSession, sf_dir: str, name: str, **layout) -> FacetDataset:
    """The dataset after it was saved and loaded."""
    folder = new_folder(spark)
    save(dataset(spark, sf_dir, name), folder, **layout)
    return load(spark, folder)


def saved_items(name: str, columns: list[str] | None = None, layout: dict | None = None, **query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = stored(spark, sf_dir, name, **(layout or {})).query(**query).items
        return found.select(*columns) if columns else found

    return run


def saved_totals(name: str, *queries: dict) -> Query:
    """The totals that a loaded dataset answers, by the number of the query."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ds = stored(spark, sf_dir, name)
        return numbers(spark, [(i, ds.total(**q)) for i, q in enumerate(queries)], "query int, total long")

    return run


def numbers(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def bundled(name: str, binary: bool, **query) -> Query:
    """The rows of a dataset that went through an interchange bundle."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .sources.interchange import from_binary, from_json, to_binary, to_json

        ds = dataset(spark, sf_dir, name)
        back = from_binary(spark, to_binary(ds)) if binary else from_json(spark, json.loads(json.dumps(to_json(ds))))
        return back.query(**query).items

    return run


def placed(name: str, columns: list[str], **query) -> Query:
    """A page with the place of each of its rows, so that a comparison sees their order."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = dataset(spark, sf_dir, name).query(**query).items.select(*columns, F.monotonically_increasing_id().alias("at"))
        return found.select(*columns, F.row_number().over(Window.orderBy("at")).cast("long").alias("place"))  # a page is small

    return run


def field_table(name: str) -> Query:
    """What a dataset says of its fields: kind, type, target and operators."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        fields = dataset(spark, sf_dir, name).describe().fields
        return numbers(spark, [(f.name, f.kind, f.type, f.target, ",".join(f.ops)) for f in fields], "name string, kind string, type string, target string, ops string")

    return run


def tool_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arguments of the function tool of a dataset, and the fields that each takes."""
    shown = function_tool(dataset(spark, sf_dir, "customer").describe(), "query_customers")["function"]
    parts = shown["parameters"]["properties"]
    fields = {k: sorted(v.get("properties") or v.get("items", {}).get("enum") or []) for k, v in parts.items()}
    return numbers(spark, [(shown["name"], k, ",".join(v)) for k, v in fields.items()], "tool string, argument string, fields string")


def applied_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an answer says of its query and its dataset, and the size of an answer that cannot match."""
    found = dataset(spark, sf_dir, "orders").query(equal={"o_orderstatus": "O"}, isNull=["o_custkey"])
    none = dataset(spark, sf_dir, "orders").query(equal={"nope": 1}, include_facet_counts=True)
    return numbers(spark, [(json.dumps(found.applied, sort_keys=True), found.snapshot["datasetId"], none.total, none.items.count(), none.facets.count())], "applied string, dataset string, total long, items long, counts long")


def text_ranges(**ranges) -> Query:
    """Ranges over numbers and dates that are held as text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("number"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
        fields = {"o_orderkey": {"kind": "id", "type": "number"}, "number": {"kind": "range", "type": "number"}, "day": {"kind": "range", "type": "date"}}
        return FacetDataset.create(rows, {"dataset_id": "orders", "fields": fields}).query(ranges=ranges).items

    return run


def released(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A released dataset answers nothing but still describes itself."""
    ds = dataset(spark, sf_dir, "supplier").persist()
    ds.dispose()
    try:
        ds.query()
        refused = False
    except RuntimeError:
        refused = True
    return numbers(spark, [(ds.is_disposed, refused, len(ds.describe().fields))], "disposed boolean, refused boolean, fields long")


def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facet counts by day, from the stream's operator over a table that is all there."""
    events = table(spark, sf_dir, "events")
    ds = FacetDataset.create(events, {"dataset_id": "events", "facets": ["event_type"], "ranges": ["value"]})
    found = windowed_facet_counts(events, ds.describe(), "ts", "1 day", "1 hour", ranges={"value": {"min": 10}})
    return found.select(F.col("window.start").cast("date").alias("day"), "value", "count")


def items(name: str, columns: list[str] | None = None, compat: bool = False, joined: bool = False, **query) -> Query:
    """The rows that a query returns."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = dataset(spark, sf_dir, name, compat, joined).query(**query).items
        return found.select(*columns) if columns else found

    return run


def total(name: str, **query) -> Query:
    """The number of matches, as a table of one row."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return dataset(spark, sf_dir, name).query(**query).matches.agg(F.count(F.lit(1)).alias("total"))

    return run


def summary(name: str, field: str, **filters) -> Query:
    return lambda spark, sf_dir: dataset(spark, sf_dir, name).facet_summary(field, **filters)


def counts(name: str, fields: list[str], show_field: bool = True, **query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = dataset(spark, sf_dir, name).query(include_facet_counts=True, **query).facets.filter(F.col("field").isin(fields))
        return found if show_field else found.drop("field")

    return run


def unknown_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An undeclared field in any operator: no rows."""
    ds = dataset(spark, sf_dir, "orders")
    asks = [{"equal": {"nope": 1}}, {"not_equal": {"nope": 1}}, {"ranges": {"nope": {"min": 1}}}, {"is_null": ["nope"]}, {"is_not_null": ["nope"]}]
    found = [ds.query(**a).matches.select("o_orderkey") for a in asks]
    for other in found[1:]:
        found[0] = found[0].union(other)
    return found[0].agg(F.count(F.lit(1)).alias("total"))


def page_past_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset(spark, sf_dir, "orders").query(offset=10**9).items.agg(F.count(F.lit(1)).alias("n_items"))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dataset(spark, sf_dir, "supplier").query(enrich_aliases=["s_name"]).items
    return found.select("s_suppkey", "s_nationkey", F.array_join("s_name", ",").alias("names"))


def enriched_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrichment runs on the page only."""
    found = dataset(spark, sf_dir, "customer").query(equal={"r_name": "ASIA"}, limit=40, offset=10, enrich_aliases=True).items
    return found.select("c_custkey", F.array_join("n_name", ",").alias("n_names"), F.array_join("r_name", ",").alias("r_names"))


def names_of_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.aliases import alias_values

    return alias_values(dataset(spark, sf_dir, "supplier").lookups["s_name"], "15")


def lookup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset(spark, sf_dir, "supplier").lookup("s_name")


def field_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text keys of a numeric facet's distinct values."""
    lineitem = table(spark, sf_dir, "lineitem")
    return lineitem.select(key_text(F.col("l_quantity"), lineitem.schema["l_quantity"].dataType).alias("value")).distinct()


URGENT = ["1-URGENT", "2-HIGH"]
LABELLED = "documents d LEFT JOIN labels l USING (doc_id)"
DOC = ["doc_id", "quality"]

#: name: (query, SQL)
CATALOG: dict[str, tuple[Query, str]] = {
    "scan_all": (items("orders"), "SELECT * FROM orders"),
    "eq_scalar": (items("orders", equal={"o_orderstatus": "O"}), "SELECT * FROM orders WHERE o_orderstatus = 'O'"),
    "eq_in": (items("orders", equal={"o_orderpriority": URGENT}), "SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT','2-HIGH')"),
    "eq_in_dup_values": (items("orders", equal={"o_orderpriority": ["1-URGENT", "1-URGENT"]}), "SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT')"),
    "eq_multi_field_and": (items("lineitem", equal={"l_returnflag": "A", "l_linestatus": "F", "l_linenumber": [1, 2]}), "SELECT * FROM lineitem WHERE l_returnflag='A' AND l_linestatus='F' AND l_linenumber IN (1,2)"),
    "eq_empty_in": (total("orders", equal={"o_orderstatus": []}), "SELECT count(*) AS total FROM orders WHERE 1=0"),
    "eq_non_facet": (total("orders", equal={"o_orderkey": 1}), "SELECT count(*) AS total FROM orders WHERE 1=0"),
    "eq_cross_type_key": (items("lineitem", equal={"l_quantity": "5"}), "SELECT * FROM lineitem WHERE l_quantity = 5.0"),
    "eq_cross_type_noncanonical": (total("lineitem", equal={"l_quantity": "5.0"}), "SELECT count(*) AS total FROM lineitem WHERE 1=0"),
    "eq_multivalued_any": (items("part", ["p_partkey", "p_name"], equal={"words": "red"}), "SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(p_name,' '),'red')"),
    "eq_multivalued_in": (items("part", ["p_partkey", "p_name"], equal={"words": ["red", "small"]}), "SELECT p_partkey, p_name FROM part WHERE list_has_any(string_split(p_name,' '),['red','small'])"),
    "eq_null": (items("documents", DOC, equal={"quality": None}), f"SELECT d.doc_id, l.quality FROM {LABELLED} WHERE l.quality IS NULL"),
    "eq_val_or_null": (items("documents", DOC, equal={"quality": [1, None]}), f"SELECT d.doc_id, l.quality FROM {LABELLED} WHERE l.quality = 1 OR l.quality IS NULL"),
    "eq_val_or_null_and_other_ref": (items("documents", ["doc_id", "lang", "quality"], True, equal={"quality": [1, None], "lang": "en"}), f"SELECT d.doc_id, d.lang, l.quality FROM {LABELLED} WHERE (l.quality = 1 AND d.lang='en') OR l.quality IS NULL"),
    "eq_val_or_null_and_other_doc": (items("documents", ["doc_id", "lang", "quality"], equal={"quality": [1, None], "lang": "en"}), f"SELECT d.doc_id, d.lang, l.quality FROM {LABELLED} WHERE (l.quality = 1 OR l.quality IS NULL) AND d.lang='en'"),
    "neq_scalar": (items("orders", not_equal={"o_orderstatus": "O"}), "SELECT * FROM orders WHERE o_orderstatus <> 'O'"),
    "neq_in": (items("orders", not_equal={"o_orderpriority": URGENT}), "SELECT * FROM orders WHERE o_orderpriority NOT IN ('1-URGENT','2-HIGH')"),
    "neq_keeps_nulls": (items("documents", DOC, not_equal={"quality": 1}), f"SELECT d.doc_id, l.quality FROM {LABELLED} WHERE l.quality IS NULL OR l.quality <> 1"),
    "neq_null": (items("documents", DOC, not_equal={"quality": None}), f"SELECT d.doc_id, l.quality FROM {LABELLED} WHERE l.quality IS NOT NULL"),
    "neq_val_and_null": (items("documents", DOC, not_equal={"quality": [1, None]}), f"SELECT d.doc_id, l.quality FROM {LABELLED} WHERE l.quality IS NOT NULL AND l.quality <> 1"),
    "neq_empty_list_noop": (total("orders", not_equal={"o_orderstatus": []}), "SELECT count(*) AS total FROM orders"),
    "neq_multivalued": (items("part", ["p_partkey", "p_name"], not_equal={"words": "red"}), "SELECT p_partkey, p_name FROM part WHERE NOT list_contains(string_split(p_name,' '),'red')"),
    "neq_meta_field": (items("orders", not_equal={"o_orderkey": [1, 2, 3]}), "SELECT * FROM orders WHERE o_orderkey NOT IN (1, 2, 3)"),
    "is_null": (items("documents", ["doc_id"], is_null=["toxic"]), f"SELECT d.doc_id FROM {LABELLED} WHERE l.toxic IS NULL"),
    "is_not_null": (items("documents", ["doc_id", "toxic"], is_not_null=["toxic"]), f"SELECT d.doc_id, l.toxic FROM {LABELLED} WHERE l.toxic IS NOT NULL"),
    "range_num_closed": (items("orders", ranges={"o_totalprice": {"min": 1e5, "max": 2e5}}), "SELECT * FROM orders WHERE o_totalprice >= 100000 AND o_totalprice <= 200000"),
    "range_num_min_only": (items("lineitem", ranges={"l_discount": {"min": 0.05}}), "SELECT * FROM lineitem WHERE l_discount >= 0.05"),
    "range_num_max_only": (items("lineitem_quantity", ranges={"l_quantity": {"max": 10}}), "SELECT * FROM lineitem WHERE l_quantity <= 10"),
    "range_date_epoch_ms": (items("orders", ranges={"o_orderdate": {"min": 820454400000, "max": 851990400000}}), "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1996-12-31'"),
    "range_date_ms_truncation": (items("events", ranges={"ts": {"min": 1704067207179, "max": 1704153600000}}), "SELECT * FROM events WHERE epoch_us(ts)//1000 >= 1704067207179 AND epoch_us(ts)//1000 <= 1704153600000"),
    "range_inverted": (total("orders", ranges={"o_totalprice": {"min": 100, "max": 10}}), "SELECT count(*) AS total FROM orders WHERE 1=0"),
    "range_nan_bound_noop": (total("orders", ranges={"o_totalprice": {"min": float("nan"), "max": float("nan")}}), "SELECT count(*) AS total FROM orders WHERE o_totalprice IS NOT NULL"),
    "range_multi": (items("lineitem", ranges={"l_extendedprice": {"min": 1000, "max": 20000}, "l_shipdate": {"min": 883612800000}}), "SELECT * FROM lineitem WHERE l_extendedprice BETWEEN 1000 AND 20000 AND l_shipdate >= TIMESTAMP '1998-01-01'"),
    "range_non_range_field": (total("orders", ranges={"o_orderstatus": {"min": 0}}), "SELECT count(*) AS total FROM orders WHERE 1=0"),
    "unknown_field_fail_closed": (unknown_field, "SELECT count(*) AS total FROM orders WHERE 1=0"),
    "mixed_all_ops": (
        items("orders", equal={"o_orderstatus": ["O", "F"]}, not_equal={"o_orderpriority": "5-LOW"}, is_not_null=["o_custkey"], ranges={"o_totalprice": {"min": 50000, "max": 150000}}),
        "SELECT * FROM orders WHERE o_orderstatus IN ('O','F') AND o_orderpriority <> '5-LOW' AND o_custkey IS NOT NULL AND o_totalprice BETWEEN 50000 AND 150000",
    ),
    "page_limit_offset": (items("orders", equal={"o_orderstatus": "O"}, limit=50, offset=20), "SELECT * FROM orders WHERE o_orderstatus='O' ORDER BY o_orderkey LIMIT 50 OFFSET 20"),
    "page_negative_offset": (items("orders", offset=-10, limit=5), "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5"),
    "page_limit_zero_total": (total("orders", equal={"o_orderstatus": "O"}, limit=0), "SELECT count(*) AS total FROM orders WHERE o_orderstatus='O'"),
    "page_offset_past_end": (page_past_end, "SELECT count(*) AS n_items FROM orders WHERE 1=0"),
    "select_projection": (items("orders", equal={"o_orderstatus": "O"}, select=["o_orderkey", "o_orderpriority", "nope"]), "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus='O'"),
    "total_only": (total("lineitem", equal={"l_returnflag": "R"}), "SELECT count(*) AS total FROM lineitem WHERE l_returnflag='R'"),
    "facet_counts_all": (
        counts("orders", ["o_orderstatus", "o_orderpriority"], ranges={"o_totalprice": {"min": 2e5}}),
        "SELECT 'o_orderstatus' AS field, o_orderstatus AS value, count(*) AS count FROM orders WHERE o_totalprice >= 200000 GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders WHERE o_totalprice >= 200000 GROUP BY 2",
    ),
    "facet_counts_nulls_excluded": (counts("documents", ["quality"], False), f"SELECT CAST(l.quality AS VARCHAR) AS value, count(*) AS count FROM {LABELLED} WHERE l.quality IS NOT NULL GROUP BY 1"),
    "facet_counts_multivalued": (counts("part", ["words"], False), "SELECT w AS value, count(*) AS count FROM (SELECT unnest(string_split(p_name,' ')) AS w FROM part) GROUP BY 1"),
    "facet_counts_number_keys": (counts("lineitem", ["l_quantity"], False, equal={"l_returnflag": "A"}), "SELECT CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS value, count(*) AS count FROM lineitem WHERE l_returnflag='A' GROUP BY 1"),
    "facet_distinct_values": (field_keys, "SELECT DISTINCT CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS value FROM lineitem"),
    "facet_summary_string": (summary("customer", "c_mktsegment"), "SELECT c_mktsegment AS value, count(*) AS count FROM customer GROUP BY 1"),
    "facet_summary_number_filtered": (summary("lineitem", "l_linenumber", equal={"l_returnflag": "A"}, ranges={"l_discount": {"min": 0.05}}), "SELECT l_linenumber AS value, count(*) AS count FROM lineitem WHERE l_returnflag='A' AND l_discount >= 0.05 GROUP BY 1"),
    "facet_summary_boolean": (summary("orders_derived", "is_final"), "SELECT (o_orderstatus='F') AS value, count(*) AS count FROM orders GROUP BY 1"),
    "facet_summary_date": (summary("orders_derived", "o_orderdate"), "SELECT epoch_ms(o_orderdate) AS value, count(*) AS count FROM orders GROUP BY 1"),
    "alias_lookup_forward": (lookup_pairs, "SELECT DISTINCT s_name AS alias_value, s_nationkey AS canonical_id FROM supplier"),
    "alias_eq": (items("customer", ["c_custkey", "c_nationkey"], equal={"r_name": "ASIA"}), "SELECT c.c_custkey, c.c_nationkey FROM customer c WHERE c.c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name='ASIA'))"),
    "alias_eq_many_to_many": (items("supplier", ["s_suppkey", "s_nationkey"], equal={"s_name": ["Supplier#000000000", "Supplier#000000001"]}), "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_name IN ('Supplier#000000000','Supplier#000000001'))"),
    "alias_eq_unmapped": (total("customer", equal={"r_name": "NOPE"}), "SELECT count(*) AS total FROM customer WHERE 1=0"),
    "alias_neq_unmapped_noop": (total("customer", not_equal={"r_name": "NOPE"}), "SELECT count(*) AS total FROM customer"),
    "alias_neq": (items("customer", ["c_custkey"], not_equal={"r_name": "ASIA"}), "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation n JOIN region r ON n.n_regionkey=r.r_regionkey WHERE r_name='ASIA')"),
    "alias_enrich": (enriched, "SELECT s.s_suppkey, s.s_nationkey, a.names FROM supplier s JOIN (SELECT s_nationkey, string_agg(s_name, ',' ORDER BY s_suppkey) AS names FROM supplier GROUP BY 1) a USING (s_nationkey)"),
    "alias_enrich_page": (
        enriched_page,
        "SELECT c_custkey, n_name AS n_names, r_name AS r_names FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name='ASIA' ORDER BY c_custkey LIMIT 40 OFFSET 10",
    ),
    "alias_is_null_raw": (total("customer", is_not_null=["r_name"]), "SELECT count(*) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "alias_eq_joined": (items("customer", ["c_custkey", "c_nationkey"], joined=True, equal={"r_name": "ASIA"}), "SELECT c.c_custkey, c.c_nationkey FROM customer c WHERE c.c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name='ASIA'))"),
    "alias_neq_joined": (items("customer", ["c_custkey"], joined=True, not_equal={"r_name": "ASIA"}), "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation n JOIN region r ON n.n_regionkey=r.r_regionkey WHERE r_name='ASIA')"),
    "alias_eq_or_null_joined": (items("part_sizes", ["p_partkey", "shown"], joined=True, equal={"shown": ["tiny", None]}), "SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'tiny' WHEN p_size <= 30 THEN 'middling' END AS shown FROM part WHERE p_size <= 10 OR p_size > 30"),
    "alias_two_of_one_target_joined": (items("customer", ["c_custkey"], joined=True, equal={"r_name": ["ASIA", "EUROPE"]}, not_equal={"n_name": ["CHINA", "FRANCE"]}), "SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA','EUROPE') AND n_name NOT IN ('CHINA','FRANCE')"),
    "alias_enrich_page_order": (
        placed("customer", ["c_custkey"], equal={"r_name": "ASIA"}, limit=40, offset=10, enrich_aliases=True),
        "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS place FROM (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name='ASIA' ORDER BY c_custkey LIMIT 40 OFFSET 10)",
    ),
    "page_order": (placed("orders", ["o_orderkey"], equal={"o_orderstatus": "O"}, limit=50, offset=20), "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS place FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus='O' ORDER BY o_orderkey LIMIT 50 OFFSET 20)"),
    "saved_query": (saved_items("lineitem", layout={"cluster_by": ["l_shipdate"], "bloom": ["l_orderkey"]}, equal={"l_returnflag": "A"}, ranges={"l_shipdate": {"min": 725846400000}}), "SELECT * FROM lineitem WHERE l_returnflag = 'A' AND l_shipdate >= TIMESTAMP '1993-01-01'"),
    "saved_page": (saved_items("orders", ["o_orderkey"], layout={"cluster_by": ["o_orderdate"]}, equal={"o_orderpriority": URGENT}, limit=30, offset=3), "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT','2-HIGH') ORDER BY o_orderkey LIMIT 30 OFFSET 3"),
    "saved_alias_enrich": (
        lambda spark, sf_dir: stored(spark, sf_dir, "supplier").query(equal={"s_name": "Supplier#000000001"}, enrich_aliases=True).items.select("s_suppkey", F.array_join("s_name", ",").alias("names")),
        "SELECT s.s_suppkey, a.names FROM supplier s JOIN (SELECT s_nationkey, string_agg(s_name, ',' ORDER BY s_suppkey) AS names FROM supplier GROUP BY 1) a USING (s_nationkey) WHERE s_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_name = 'Supplier#000000001')",
    ),
    "saved_totals": (
        saved_totals("orders_derived", {}, {"equal": {"is_final": True}}, {"equal": {"o_orderdate": 820454400000}}, {"equal": {"o_orderdate": "1996-01-01T00:00:00.000Z"}}, {"equal": {"o_orderdate": ["1996-01-01", 820540800000]}}, {"not_equal": {"is_final": True}}),
        "SELECT 0::INT AS query, count(*) AS total FROM orders UNION ALL SELECT 1, count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 2, count(*) FROM orders WHERE o_orderdate = TIMESTAMP '1996-01-01' UNION ALL SELECT 3, count(*) FROM orders WHERE o_orderdate = TIMESTAMP '1996-01-01' UNION ALL SELECT 4, count(*) FROM orders WHERE o_orderdate = TIMESTAMP '1996-01-02' UNION ALL SELECT 5, count(*) FROM orders WHERE o_orderstatus <> 'F'",
    ),
    "bundle_json": (bundled("supplier_plain", False), "SELECT * FROM supplier"),
    "bundle_binary": (bundled("supplier_plain", True, equal={"s_nationkey": [1, 2, 3]}, limit=40), "SELECT * FROM supplier WHERE s_nationkey IN (1, 2, 3) ORDER BY s_suppkey LIMIT 40"),
    "describe_fields": (field_table("customer"), "SELECT * FROM (VALUES ('c_custkey','id','number',NULL,''), ('c_nationkey','facet','number',NULL,'eq,in'), ('c_mktsegment','facet','string',NULL,'eq,in'), ('c_acctbal','range','number',NULL,'between,gte,lte'), ('n_name','alias','string','c_nationkey','eq,in'), ('r_name','alias','string','c_nationkey','eq,in')) AS t(name, kind, type, target, ops)"),
    "infer_types": (field_table("orders_derived"), "SELECT * FROM (VALUES ('o_orderkey','id','number',NULL,''), ('is_final','facet','boolean',NULL,'eq,in'), ('o_orderdate','facet','date',NULL,'eq,in'), ('o_custkey','meta','number',NULL,''), ('o_orderstatus','meta','string',NULL,''), ('o_totalprice','meta','number',NULL,''), ('o_orderpriority','meta','string',NULL,'')) AS t(name, kind, type, target, ops)"),
    "function_tool": (tool_table, "SELECT 'query_customers' AS tool, * FROM (VALUES ('equal','c_mktsegment,c_nationkey,n_name,r_name'), ('notEqual','c_mktsegment,c_nationkey,n_name,r_name'), ('ranges','c_acctbal'), ('isNull','c_mktsegment,c_nationkey,n_name,r_name'), ('isNotNull','c_mktsegment,c_nationkey,n_name,r_name'), ('limit',''), ('offset',''), ('includeFacetCounts',''), ('enrichAliases','')) AS t(argument, fields)"),
    "applied_and_snapshot": (applied_table, """SELECT '{"equal": {"o_orderstatus": "O"}, "isNull": ["o_custkey"]}' AS applied, 'orders' AS dataset, 0::BIGINT AS total, 0::BIGINT AS items, 0::BIGINT AS counts"""),
    "range_text_numbers": (text_ranges(number={"min": 100, "max": 900.5}), "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS number, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_custkey >= 100 AND o_custkey <= 900"),
    "range_text_dates": (text_ranges(day={"min": 820454400000, "max": 851990400000}), "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS number, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'"),
    "released_dataset": (released, "SELECT true AS disposed, true AS refused, 3::BIGINT AS fields"),
    "windowed_facet_counts": (windowed, "SELECT CAST(ts AS DATE) AS day, event_type AS value, count(*) AS count FROM events WHERE value >= 10 GROUP BY 1, 2"),
    "alias_values_for_id": (names_of_id, "SELECT s_name AS value FROM supplier WHERE s_nationkey = 15"),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets, a range and a page in one query."""
    ds = dataset(spark, sf_dir, "orders")
    return ds.query(equal={"o_orderstatus": ["O", "F"]}, not_equal={"o_orderpriority": "5-LOW"}, ranges={"o_totalprice": {"min": 50000}}, limit=100, include_facet_counts=True).items


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOG.items()}
