"""The engine's queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators.index import fingerprint
from .operators.overlay import apply_updates
from .plans.engine import Engine
from .plans.query import Query
from .plans.request import execute_request
from .sources.delimited import files_of

Run = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, tuple[Run, str | None]] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared place of the session, or in Spark's warehouse where there is none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def find(spark: SparkSession, d: str, table: str, **options) -> Query:
    return Engine(spark, **options).find(f"{d}/{table}.parquet")


def add(name: str, sql: str | None):
    def put(run: Run) -> Run:
        FOUND[name] = (run, sql)
        return run

    return put


def simple(name: str, table: str, sql: str, build: Callable[[Query], DataFrame], **options) -> None:
    FOUND[name] = (lambda s, d: build(find(s, d, table, **options)), sql)


def rounded(df: DataFrame, digits: int, column: str = "value") -> DataFrame:
    return df.withColumn(column, F.round(column, digits))


simple("scan_all_columns", "nation", "SELECT * FROM nation", lambda q: q.all())
simple("project_columns", "orders", "SELECT o_orderkey, o_orderpriority FROM orders", lambda q: q.select("O_ORDERKEY", "o_orderpriority").all())
simple("count_all", "lineitem", "SELECT count(*) AS count FROM lineitem", lambda q: q.count_df())
simple("count_filtered", "orders", "SELECT count(*) AS count FROM orders WHERE o_orderstatus = 'F'", lambda q: q.where({"o_orderstatus": "F"}).count_df())
simple("count_filtered_limit_offset", "orders", "SELECT count(*) AS count FROM (SELECT 1 FROM orders WHERE o_orderstatus = 'F' LIMIT 100 OFFSET 10)", lambda q: q.where({"o_orderstatus": "F"}).offset(10).limit(100).count_df())

CUSTOMER = "SELECT c_custkey, c_mktsegment FROM customer WHERE "
for _name, _op in (("eq", "="), ("neq", "!=")):
    simple(f"filter_{_name}", "customer", f"{CUSTOMER}c_mktsegment {_op.replace('!=', '<>')} 'BUILDING'", lambda q, o=_op: q.where([o, "C_MKTSEGMENT", "BUILDING"]).select("c_custkey", "c_mktsegment").all())
for _name, _op in (("gt", ">"), ("lt", "<"), ("gte", ">="), ("lte", "<=")):
    simple(f"filter_{_name}_text", "part", f"SELECT p_partkey, p_size FROM part WHERE CAST(p_size AS VARCHAR) {_op} '3'", lambda q, o=_op: q.where([o, "p_size", 3]).select("p_partkey", "p_size").all())
simple("filter_lt_text_string", "orders", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority < '3'", lambda q: q.where(["<", "o_orderpriority", "3"]).select("o_orderkey", "o_orderpriority").all())
simple("filter_gt_numeric", "lineitem", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity > 45", lambda q: q.numeric().where([">", "l_quantity", 45]).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice").all())
simple("filter_range_numeric", "part", "SELECT p_partkey, p_size FROM part WHERE p_size >= 9 AND p_size < 20", lambda q: q.numeric().where([">=", "p_size", 9]).and_where(["<", "p_size", 20]).select("p_partkey", "p_size").all())
simple("filter_eq_numeric", "part", "SELECT p_partkey FROM part WHERE p_size = 7", lambda q: q.where({"p_size": 7}).select("p_partkey").all())
simple("filter_like", "part", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a')", lambda q: q.where(["LIKE", "p_name", "A"]).select("p_partkey", "p_name").all())
simple("filter_like_literal_percent", "documents", "SELECT doc_id FROM documents WHERE contains(lower(text), '%')", lambda q: q.where(["LIKE", "text", "%"]).select("doc_id").all())
simple("filter_in", "orders", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')", lambda q: q.where(["IN", "o_orderpriority", ["1-URGENT", "5-LOW"]]).select("o_orderkey").all())
simple("filter_in_integers", "nation", "SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3)", lambda q: q.where(["IN", "n_regionkey", [1, 3]]).select("n_nationkey").all())


def _blanked(s: SparkSession, d: str) -> Query:
    segment = F.when(F.col("c_mktsegment") == "BUILDING", F.lit(None)).when(F.col("c_mktsegment") == "MACHINERY", F.lit("")).when(F.col("c_nationkey") == 3, F.lit("NULL")).otherwise(F.col("c_mktsegment"))
    return Engine(s).find(find(s, d, "customer").df.withColumn("segment", segment))


BLANKED = "(SELECT *, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL WHEN c_mktsegment = 'MACHINERY' THEN '' WHEN c_nationkey = 3 THEN 'NULL' ELSE c_mktsegment END AS segment FROM customer)"
FOUND["filter_is_null"] = (lambda s, d: _blanked(s, d).where(["IS NULL", "segment"]).select("c_custkey").all(), f"SELECT c_custkey FROM {BLANKED} WHERE segment IS NULL OR segment IN ('', 'NULL')")
FOUND["filter_is_not_null"] = (lambda s, d: _blanked(s, d).where(["IS NOT NULL", "segment"]).select("c_custkey", "segment").all(), f"SELECT c_custkey, segment FROM {BLANKED} WHERE segment IS NOT NULL AND segment NOT IN ('', 'NULL')")
FOUND["filter_neq_null"] = (lambda s, d: _blanked(s, d).where(["!=", "segment", "FURNITURE"]).select("c_custkey").all(), f"SELECT c_custkey FROM {BLANKED} WHERE segment <> 'FURNITURE'")
simple("filter_and", "orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH'", lambda q: q.where({"o_orderstatus": "F"}).and_where({"o_orderpriority": "2-HIGH"}).select("o_orderkey").all())
simple("filter_or", "orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = '2-HIGH'", lambda q: q.where({"o_orderstatus": "P"}).or_where({"o_orderpriority": "2-HIGH"}).select("o_orderkey").all())
simple(
    "filter_nested", "orders", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 100000) OR (o_orderpriority = '1-URGENT' AND NOT o_orderstatus = 'F' AND (o_custkey < 200 OR o_custkey >= 900))",
    lambda q: q.numeric().where({"operator": "OR", "children": [
        {"operator": "AND", "children": [{"operator": "=", "column": "o_orderstatus", "value": "F"}, {"operator": ">", "column": "o_totalprice", "value": 100000}]},
        {"operator": "AND", "children": [{"operator": "=", "column": "o_orderpriority", "value": "1-URGENT"}, {"operator": "!=", "column": "o_orderstatus", "value": "F"}, {"operator": "OR", "children": [{"operator": "<", "column": "o_custkey", "value": 200}, {"operator": ">=", "column": "o_custkey", "value": 900}]}]},
    ]}).select("o_orderkey").all(),
)
simple("filter_empty_and", "region", "SELECT * FROM region", lambda q: q.where({"operator": "AND", "children": []}).all())
simple("filter_empty_or", "region", "SELECT * FROM region WHERE FALSE", lambda q: q.where({"operator": "OR", "children": []}).all())
simple("filter_map_form", "orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '3-MEDIUM'", lambda q: q.where('{"O_ORDERSTATUS": "O", "o_orderpriority": "3-MEDIUM"}').select("o_orderkey").all())

for _f in ("sum", "min", "max", "avg"):
    simple(f"group_{_f}", "lineitem", f"SELECT l_returnflag, round({_f}(l_quantity), 6) AS value FROM lineitem GROUP BY l_returnflag", lambda q, f=_f: rounded(q.group_by("l_returnflag").aggregate(f, "l_quantity").all(), 6))
    simple(f"global_{_f}", "orders", f"SELECT round({_f}(o_totalprice), 2) AS value FROM orders", lambda q, f=_f: rounded(q.aggregate(f, "o_totalprice").all(), 2))
simple("group_count", "lineitem", "SELECT l_returnflag, count(*) AS count FROM lineitem GROUP BY l_returnflag", lambda q: q.group_by("l_returnflag").count_df())
simple("group_distinct", "orders", "SELECT DISTINCT o_orderpriority, CAST(1 AS DOUBLE) AS value FROM orders", lambda q: q.group_by("o_orderpriority").aggregate("").all())
simple("distinct_values", "events", "SELECT DISTINCT event_type FROM events", lambda q: q.distinct("event_type"))
simple("group_multi_key", "lineitem", "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY ALL", lambda q: rounded(q.group_by("l_returnflag,l_linestatus").aggregate("sum", "l_extendedprice").all(), 2))
simple("group_filtered", "events", "SELECT event_type, round(avg(value), 6) AS value FROM events WHERE user_id < 50 GROUP BY event_type", lambda q: rounded(q.numeric().where(["<", "user_id", 50]).group_by("event_type").aggregate("avg", "value").all(), 6))
simple("group_limit_offset", "orders", "SELECT o_orderpriority, count(*) AS value FROM orders GROUP BY 1 ORDER BY 1 LIMIT 2 OFFSET 1", lambda q: q.group_by("o_orderpriority").aggregate("count").limit(2).offset(1).all())
simple("group_sum_unparsable", "part", "SELECT p_brand, CAST(0 AS DOUBLE) AS value FROM part GROUP BY p_brand", lambda q: q.group_by("p_brand").aggregate("sum", "p_type").all())


def _mixed(s: SparkSession, d: str) -> Query:
    return Engine(s).find(find(s, d, "events").df.withColumn("amount", F.when(F.col("event_type") == "click", F.lit("n/a")).when(F.col("user_id") % 3 == 0, F.lit("")).otherwise(F.col("user_id").cast("string"))))


FOUND["group_avg_mixed"] = (
    lambda s, d: rounded(_mixed(s, d).group_by("event_type").aggregate("avg", "amount").all(), 6),
    "SELECT event_type, round(avg(CASE WHEN event_type = 'click' OR user_id % 3 = 0 THEN 0.0 ELSE CAST(user_id AS DOUBLE) END), 6) AS value FROM events GROUP BY event_type",
)
simple("distinct_count", "lineitem", "SELECT count(DISTINCT l_partkey) AS value FROM lineitem", lambda q: q.aggregate("distinct", "l_partkey").all())


def _placed(df: DataFrame) -> DataFrame:
    """df with each row's place; the frame is ordered, and its partitions are in order."""
    return df.select("*", F.monotonically_increasing_id().alias("_id")).select(*df.columns, F.row_number().over(Window.orderBy("_id")).cast("long").alias("place"))


simple(
    "order_by_desc", "customer", "SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer",
    lambda q: _placed(q.order_by({"c_acctbal": "DESC", "c_custkey": "ASC"}).select("c_custkey", "c_acctbal").all()),
)
simple("top_k", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", lambda q: q.order_by("o_totalprice", "DESC").order_by("o_orderkey").limit(10).select("o_orderkey", "o_totalprice").all())
simple("first_row", "orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 1", lambda q: q.where({"o_orderstatus": "F"}).order_by("o_orderkey").select("o_orderkey").first_row())
simple("limit_offset", "customer", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 35", lambda q: q.order_by("c_custkey").limit(20).offset(35).select("c_custkey").all())


def _indexed(s: SparkSession, d: str, columns: list[str]) -> Query:
    engine = Engine(s, index_dir=scratch(s, "index"))
    path = f"{d}/orders.parquet"
    engine.create_index(path, columns)
    return engine.find(path)


FOUND["index_lookup_single"] = (lambda s, d: _indexed(s, d, ["o_orderpriority"]).where({"o_orderpriority": "2-HIGH"}).select("o_orderkey").all(), "SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH'")
FOUND["index_lookup_composite"] = (lambda s, d: _indexed(s, d, ["o_orderstatus", "o_orderpriority"]).where({"o_orderpriority": "2-HIGH", "o_orderstatus": "F"}).select("o_orderkey").all(), "SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'F'")
FOUND["index_lookup_residual"] = (lambda s, d: _indexed(s, d, ["o_orderstatus"]).numeric().where({"o_orderstatus": "F"}).and_where([">", "o_totalprice", 100000]).select("o_orderkey").all(), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
FOUND["index_group_scan"] = (lambda s, d: _indexed(s, d, ["o_orderpriority"]).group_by("o_orderpriority").count_df(), "SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY o_orderpriority")


@add("index_metadata", "SELECT count(*) AS total_rows, count(DISTINCT o_orderpriority) AS distinct_count FROM orders")
def _metadata(s: SparkSession, d: str) -> DataFrame:
    meta = Engine(s, index_dir=scratch(s, "index")).create_index(f"{d}/orders.parquet", ["o_orderpriority"])
    return s.createDataFrame([(meta["totalRows"], meta["indexes"]["o_orderpriority"]["distinctCount"])], "total_rows long, distinct_count long")


UPDATES = {3: {"n_name": "ELSEWHERE", "n_regionkey": "4"}, 7: {"n_name": "NOWHERE"}}
UPDATED = "(SELECT n_nationkey, CASE n_nationkey WHEN 3 THEN 'ELSEWHERE' WHEN 7 THEN 'NOWHERE' ELSE n_name END AS n_name, CAST(CASE n_nationkey WHEN 3 THEN 4 ELSE n_regionkey END AS INTEGER) AS n_regionkey FROM nation)"
FOUND["overlay_update"] = (lambda s, d: apply_updates(find(s, d, "nation").df, UPDATES, "n_nationkey"), f"SELECT * FROM {UPDATED}")
FOUND["overlay_then_filter"] = (lambda s, d: Engine(s).find(apply_updates(find(s, d, "nation").df, UPDATES, "n_nationkey")).where({"n_regionkey": 4}).all(), f"SELECT * FROM {UPDATED} WHERE n_regionkey = 4")


@add("csv_roundtrip", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def _roundtrip(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "csv") + ".csv"
    Engine(s).append(find(s, d, "nation").select("n_nationkey", "n_name").all(), path)
    return Engine(s).find(path).all()


@add("csv_append", "SELECT r_name, CAST(count(*) AS BIGINT) AS count FROM (SELECT r_name FROM region UNION ALL SELECT r_name FROM region) GROUP BY r_name")
def _append(s: SparkSession, d: str) -> DataFrame:
    path, engine = scratch(s, "csv") + ".csv", Engine(s)
    for _ in range(2):
        engine.append(find(s, d, "region").df, path)
    return engine.find(path).group_by("r_name").count_df()


def _csv(s: SparkSession, d: str, table: str, *columns: str, sep: str = ",", order: str | None = None) -> str:
    """A small table as one delimited file."""
    df = find(s, d, table).select(*columns).all()
    path = scratch(s, "csv") + ".csv"
    df.orderBy(order or columns[0]).coalesce(1).write.option("header", True).option("sep", sep).option("escape", '"').csv(path)
    return path


LOCATED = "(SELECT *, CAST(row_number() OVER o + 1 AS BIGINT) AS line, CAST(strlen('n_nationkey,n_name,n_regionkey') + 1 + coalesce(sum(strlen(concat_ws(',', n_nationkey, n_name, n_regionkey)) + 1) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM nation WINDOW o AS (ORDER BY n_nationkey))"


@add("row_locators", f'SELECT "offset", line FROM {LOCATED} WHERE n_regionkey = 2')
def _locators(s: SparkSession, d: str) -> DataFrame:
    return Engine(s).find(_csv(s, d, "nation", "n_nationkey", "n_name", "n_regionkey"), locators=True).where({"n_regionkey": 2}).locators()


@add("index_locators", f'SELECT "offset", line FROM {LOCATED} WHERE n_regionkey = 3')
def _index_locators(s: SparkSession, d: str) -> DataFrame:
    path, engine = _csv(s, d, "nation", "n_nationkey", "n_name", "n_regionkey"), Engine(s, index_dir=scratch(s, "index"))
    engine.create_index(path, ["n_regionkey"], covering=False)
    return engine.catalog(path).best({"n_regionkey": "3"})[1].filter("n_regionkey = '3'").select("offset", "line")


@add("csv_quoted_line_feeds", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents WHERE doc_id < 100 AND text <> '' AND trim(text) = text AND NOT contains(text, chr(13))")
def _quoted(s: SparkSession, d: str) -> DataFrame:
    df = find(s, d, "documents").df.filter("doc_id < 100 AND text <> '' AND trim(text) = text AND NOT contains(text, char(13))").select(F.concat("doc_id", F.lit(',"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"')).alias("line"))
    path = scratch(s, "csv") + ".csv"
    s.createDataFrame([("doc_id,text",)], "line string").unionByName(df).coalesce(1).write.text(path)
    return Engine(s).find(path, locators=True).select("doc_id", "text").all()


@add("csv_numeric_top_k", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CAST(p_size AS VARCHAR) AS p_size FROM part ORDER BY part.p_size DESC, part.p_partkey LIMIT 25")
def _numeric_top(s: SparkSession, d: str) -> DataFrame:
    return Engine(s).find(_csv(s, d, "part", "p_partkey", "p_size")).numeric().order_by({"p_size": "DESC", "p_partkey": "ASC"}).limit(25).all()


@add("csv_virtual_columns", "SELECT 'north' AS site, CAST(count(*) AS BIGINT) AS count FROM nation")
def _virtual(s: SparkSession, d: str) -> DataFrame:
    path, engine = _csv(s, d, "nation", "n_nationkey", "n_name"), Engine(s)
    engine.save_schema(path, {"site": "north"})
    return engine.find(path).where({"site": "north"}).group_by("site").count_df()


@add("csv_updates", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, CASE n_nationkey WHEN 0 THEN 'FIRST' ELSE n_name END AS n_name FROM nation")
def _csv_updates(s: SparkSession, d: str) -> DataFrame:
    path, engine = _csv(s, d, "nation", "n_nationkey", "n_name"), Engine(s)
    engine.save_updates(path, {2: {"n_name": "FIRST"}})
    return engine.find(path).select("n_nationkey", "n_name").all()


@add("csv_separator", "SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region WHERE r_name > 'AMERICA'")
def _separator(s: SparkSession, d: str) -> DataFrame:
    return Engine(s, sep="|").find(_csv(s, d, "region", "r_regionkey", "r_name", sep="|")).where([">", "r_name", "AMERICA"]).all()


@add("reader_metadata", "SELECT * FROM (VALUES ('n_nationkey'), ('n_name'), ('n_regionkey')) AS t(name)")
def _headers(s: SparkSession, d: str) -> DataFrame:
    path = _csv(s, d, "nation", "n_nationkey", "n_name", "n_regionkey")
    return s.createDataFrame([(c,) for c in Engine(s).validate(path, ["N_NATIONKEY", "n_name", "N_RegionKey"])], "name string")


def _refused(s: SparkSession, tries: dict[str, Callable[[], object]]) -> DataFrame:
    """The names of what raises ValueError."""
    found = []
    for name, run in tries.items():
        try:
            run()
        except ValueError:
            found.append((name,))
    return s.createDataFrame(found, "refused string")


@add("errors", "SELECT * FROM (VALUES ('operator'), ('function'), ('group key'), ('filter column'), ('index column'), ('header')) AS t(refused)")
def _errors(s: SparkSession, d: str) -> DataFrame:
    q, engine = find(s, d, "nation"), Engine(s, index_dir=scratch(s, "index"))
    path = _csv(s, d, "region", "r_regionkey", "r_name")
    return _refused(s, {
        "none": lambda: q.where({"n_name": "PERU"}).all(), "operator": lambda: q.where(["~", "n_name", "x"]).all(), "function": lambda: q.aggregate("median", "n_regionkey").all(), "group key": lambda: q.group_by("nope").count_df(),
        "filter column": lambda: q.where({"nope": 1}).all(), "index column": lambda: engine.create_index(f"{d}/nation.parquet", ["nope"]), "header": lambda: engine.append(q.df, path),
    })


@add("request_count", "SELECT count(*) AS count FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '2-HIGH'")
def _request_count(s: SparkSession, d: str) -> DataFrame:
    where = {"operator": "OR", "children": [{"operator": "=", "column": "o_orderstatus", "value": "F"}, {"operator": "=", "column": "o_orderpriority", "value": "2-HIGH"}]}
    out = execute_request(s, json.dumps({"action": "count", "csv": f"{d}/orders.parquet", "where": where}))
    return s.createDataFrame([(out["count"],)], "count long")


@add("request_groups", "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY o_orderpriority")
def _request_groups(s: SparkSession, d: str) -> DataFrame:
    return rounded(execute_request(s, {"action": "query", "csv": f"{d}/orders.parquet", "groupBy": "o_orderpriority", "aggFunc": "sum", "aggCol": "o_totalprice"})["data"], 2)


@add("request_locators", f'SELECT "offset", line FROM {LOCATED} WHERE n_regionkey = 1 ORDER BY line LIMIT 3 OFFSET 1')
def _request_locators(s: SparkSession, d: str) -> DataFrame:
    where = {"operator": "=", "column": "n_regionkey", "value": "1"}
    return execute_request(s, {"action": "query", "csv": _csv(s, d, "nation", "n_nationkey", "n_name", "n_regionkey"), "where": where, "limit": 3, "offset": 1})["data"]


@add("request_index", "SELECT 'ok' AS status, count(*) AS count FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 'error', 0")
def _request_index(s: SparkSession, d: str) -> DataFrame:
    path, where = f"{d}/orders.parquet", scratch(s, "index")
    made = execute_request(s, {"action": "index", "csv": path, "cols": '["o_orderpriority"]', "indexDir": where})
    count = execute_request(s, {"action": "query", "csv": path, "indexDir": where, "where": {"o_orderpriority": "1-URGENT"}, "countOnly": True})["count"]
    return s.createDataFrame([(made["status"], count), (execute_request(s, {"action": "drop", "csv": path})["status"], 0)], "status string, count long")


@add("groups_json", "SELECT '{' || string_agg('\"' || o_orderstatus || '\": ' || n, ', ' ORDER BY o_orderstatus) || '}' AS json FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus)")
def _groups_json(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(find(s, d, "orders").group_by("o_orderstatus").aggregate("count").groups_json(),)], "json string")


@add("explain_plan", "SELECT * FROM (VALUES ('Index: o_orderstatus', TRUE), ('Index: none', TRUE)) AS t(index, filtered)")
def _explain(s: SparkSession, d: str) -> DataFrame:
    plans = [_indexed(s, d, ["o_orderstatus"]).where({"o_orderstatus": "F"}).explain(), find(s, d, "orders").where({"o_orderstatus": "F"}).explain()]
    return s.createDataFrame([(p.split("\n")[0], "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in p) for p in plans], "index string, filtered boolean")


@add("index_stale", "SELECT * FROM (VALUES ('Index: n_name', 25), ('Index: none', 26)) AS t(index, rows)")
def _stale(s: SparkSession, d: str) -> DataFrame:
    path, engine, found = scratch(s, "table") + ".parquet", Engine(s, index_dir=scratch(s, "index")), []
    find(s, d, "nation").df.write.parquet(path)
    engine.create_index(path, ["n_name"])
    for grow in (False, True):
        if grow:
            find(s, d, "nation").df.limit(1).write.mode("append").parquet(path)
        found.append((engine.find(path).where({"n_name": "PERU"}).explain().split("\n")[0], engine.find(path).count()))
    return s.createDataFrame(found, "index string, rows int")


@add("index_bloom", "SELECT 'o_orderkey' AS name")
def _bloom(s: SparkSession, d: str) -> DataFrame:
    """Columns that have a Bloom filter in every row group of the index; those of few values have a dictionary instead."""
    engine, path, jvm = Engine(s, index_dir=scratch(s, "index")), f"{d}/orders.parquet", s._jvm
    engine.create_index(path, ["o_orderkey"])
    have: list[set] = []
    for name, _, _ in files_of(s, f"{engine.catalog(path).folder}/o_orderkey"):
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(name), s._jsc.hadoopConfiguration()))
        try:
            have += [{c.getPath().toDotString() for c in block.getColumns() if c.getBloomFilterOffset() >= 0} for block in reader.getFooter().getBlocks()]
        finally:
            reader.close()
    return s.createDataFrame([(c,) for c in set.intersection(*have)], "name string")


@add("fingerprint", "SELECT TRUE AS same, TRUE AS sha1")
def _fingerprint(s: SparkSession, d: str) -> DataFrame:
    a, b, other = (fingerprint(s, f"{d}/{t}.parquet") for t in ("nation", "nation", "region"))
    return s.createDataFrame([(a == b and a["hash"] != other["hash"], len(a["hash"]) == 40)], "same boolean, sha1 boolean")


def queries() -> dict[str, Run]:
    return {k: run for k, (run, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in FOUND.items() if sql}
