"""Queries of the engine's own operators over the test tables, each with its SQL.

The tables play these parts: part = product, lineitem = observation and child, supplier = organisation, nation and
region = classifications, orders' priority = ordered vocabulary, canonical_* and metric_observations = fact store.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions import parsing
from factweave.functions import text as ftext
from factweave.operators import entity, findings, graph, merge, predicates, projection, quality, ranking, text
from factweave.operators.graph import Hop
from factweave.operators.predicates import Field, Filter, Tree
from factweave.plans.request import Catalog, Contract, Request, Sort, gate, run
from factweave.session import table
from factweave.sources import files as connectors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The places of order priorities, most urgent first.
PRIORITIES = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4, "5-LOW": 5}
AS_OF = "1996-03-01"
#: What organisation names end in, and the kind it tells.
ORGANISATION_KINDS = {"자산운용사": "자산운용", "자산운용": "자산운용", "운용사": "운용", "증권사": "증권", "증권": "증권", "은행": "은행", "보험": "보험"}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


# --- Catalog over the star tables -------------------------------------------------------------------------------------


def _part_suppliers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select("l_partkey", "l_suppkey").distinct()


def _regions(s: SparkSession, d: str) -> DataFrame:
    """(p_partkey, value): regions of a part's suppliers."""
    nations = table(s, d, "nation").join(F.broadcast(table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    suppliers = table(s, d, "supplier").join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"))
    return table(s, d, "lineitem").select("l_partkey", "l_suppkey").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_partkey").alias("p_partkey"), F.col("r_name").alias("value"))


def _flags(s: SparkSession, d: str) -> DataFrame:
    """(p_partkey, value): a part that was ever returned; parts without the fact are unknown."""
    returned = table(s, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return returned.withColumn("value", F.lit("returned"))


def _prices(s: SparkSession, d: str) -> DataFrame:
    """The latest price of each part as of a day, ties by order and line."""
    rows = table(s, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_shipdate", F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity").alias("tie"), F.col("l_extendedprice").alias("price"))
    return ranking.latest(rows, ["p_partkey"], "l_shipdate", "tie", ["price"], F.lit(AS_OF).cast("timestamp_ntz"))


def _catalog(s: SparkSession, d: str) -> Catalog:
    line = table(s, d, "lineitem")
    fields = {
        "name": Field("attribute", "p_name"),
        "type": Field("attribute", "p_type"),
        "size": Field("attribute", "p_size"),
        "brand": Field("attribute", "p_brand"),
        "region": Field("classification", facts=_regions(s, d)),
        "supplier": Field("relation", facts=line.select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("value"))),
        "returned": Field("flag", facts=_flags(s, d)),
        "priority": Field("vocabulary", facts=line.join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("p_partkey"), F.col("o_orderpriority").alias("value")), ranks=PRIORITIES),
        "price": Field("metric", facts=_prices(s, d).withColumnRenamed("price", "value")),
    }
    metrics = line.where(F.col("l_shipdate") <= F.lit(AS_OF).cast("timestamp_ntz")).select(F.col("l_partkey").alias("entity_id"), F.lit("price").alias("metric"), F.col("l_linestatus").alias("dataset"), F.lit("CURRENCY_AMOUNT").alias("unit"), F.lit(None).cast("string").alias("scale"), F.lit("USD").alias("currency"), (F.col("l_returnflag") != "R").alias("comparable"), F.col("l_shipdate").alias("observed_on"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity").alias("fact_id"), F.col("l_extendedprice").alias("value"))
    return Catalog(table(s, d, "part"), "p_partkey", fields, metrics, {"price": Contract("price", "F", "CURRENCY_AMOUNT", None, "USD")})


def _selected(s: SparkSession, d: str, *filters: Filter, tree: Tree | None = None) -> DataFrame:
    c = _catalog(s, d)
    return predicates.select_entities(c.base, c.entity, filters, c.fields, tree).select("p_partkey")


_REGIONS_SQL = "r AS (SELECT DISTINCT l_partkey AS p_partkey, r_name AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_LATEST_SQL = f"latest AS (SELECT l_partkey AS p_partkey, l_shipdate, l_extendedprice AS price FROM lineitem WHERE l_shipdate <= TIMESTAMP '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity) = 1)"
_CONTRACT_SQL = f"c AS (SELECT l_partkey AS p_partkey, l_extendedprice AS price FROM lineitem WHERE l_shipdate <= TIMESTAMP '{AS_OF}' AND l_linestatus = 'F' AND l_returnflag <> 'R' QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity) = 1)"


# --- Filters ----------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 30 AND p_type IN ('SMALL', 'PROMO') AND p_brand = 'Brand#7'")
def filter_eq_in_between(s, d):
    return _selected(s, d, Filter("a", "size", "between", (10, 30)), Filter("b", "type", "in", ("SMALL", "PROMO")), Filter("c", "brand", "eq", ("Brand#7",)))


@query(f"WITH {_REGIONS_SQL} SELECT p_partkey FROM part p WHERE ((p_type = 'SMALL' AND EXISTS (SELECT 1 FROM r WHERE r.p_partkey = p.p_partkey AND value = 'ASIA')) OR p_size > 45) AND p_brand <> 'Brand#1'")
def filter_nested_boolean(s, d):
    tree = Tree("or", (Tree("and", ("a", "b")), "c"))
    return _selected(s, d, Filter("a", "type", "eq", ("SMALL",)), Filter("b", "region", "eq", ("ASIA",)), Filter("c", "size", "gt", (45,)), Filter("d", "brand", "ne", ("Brand#1",)), tree=tree)


@query("SELECT p_partkey FROM part WHERE contains(lower(replace(p_name, ' ', '')), 'eri')")
def filter_contains_literal(s, d):
    return _selected(s, d, Filter("a", "name", "contains", ("E ri",)))


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey IN (1, 3, 5))")
def semi_relation(s, d):
    return _selected(s, d, Filter("a", "supplier", "in", (1, 3, 5)))


@query(f"WITH {_REGIONS_SQL} SELECT p_partkey FROM part p WHERE EXISTS (SELECT 1 FROM r WHERE r.p_partkey = p.p_partkey AND value IN ('EUROPE', 'ASIA'))")
def semi_classification(s, d):
    return _selected(s, d, Filter("a", "region", "in", ("EUROPE", "ASIA")))


@query("SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'A') AND NOT bool_or(l_returnflag <> 'A')")
def classification_child_rollup(s, d):
    return predicates.rollup_matches(table(s, d, "lineitem"), "l_orderkey", "l_returnflag", ["A"], any_child=False)


@query("SELECT canonical_product_id FROM canonical_products WHERE currency IS NOT NULL GROUP BY 1 HAVING count(DISTINCT currency) = 1")
def classification_known(s, d):
    return predicates.known_once(table(s, d, "canonical_products"), "canonical_product_id", "currency")


@query(f"WITH {_REGIONS_SQL} SELECT p_partkey FROM part p WHERE p_size = 1 OR EXISTS (SELECT 1 FROM r WHERE r.p_partkey = p.p_partkey AND value = 'AFRICA')")
def exists_in_or(s, d):
    return _selected(s, d, Filter("a", "size", "eq", (1,)), Filter("b", "region", "eq", ("AFRICA",)), tree=Tree("or", ("a", "b")))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) = 1 AND min(l_linestatus) <> 'F')")
def neg_known_only(s, d):
    status = table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linestatus").alias("value"))
    return predicates.select_entities(table(s, d, "orders"), "o_orderkey", [Filter("a", "status", "ne", ("F",))], {"status": Field("classification", facts=status)}).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49)")
def neg_open_world(s, d):
    return _selected(s, d, Filter("a", "returned", "ne", ("returned",)))


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 3)")
def neg_relation_known(s, d):
    return _selected(s, d, Filter("a", "supplier", "ne", (3,)))


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_shipdate <= TIMESTAMP '1996-03-01')")
def anti_lifecycle(s, d):
    ended = table(s, d, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_shipdate") <= F.lit(AS_OF).cast("timestamp_ntz"))).select(F.col("l_partkey").alias("p_partkey"))
    return table(s, d, "part").select("p_partkey").join(ended, "p_partkey", "left_anti")


@query("SELECT l_partkey AS p_partkey, count(DISTINCT l_suppkey) AS children FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def multi_child_count(s, d):
    return quality.shared_identifiers(table(s, d, "lineitem"), ["l_partkey"], "l_suppkey", "children").withColumnRenamed("l_partkey", "p_partkey")


@query("SELECT DISTINCT canonical_product_id FROM (SELECT source_record_id, canonical_product_id FROM source_field_assertions WHERE source_column IN ('du_last_aum', 'du_last_nav') AND trim(raw_value) <> '' GROUP BY 1, 2 HAVING count(DISTINCT source_column) = 2)")
def same_record_two_fields(s, d):
    return predicates.same_record_fields(table(s, d, "source_field_assertions"), "source_record_id", "canonical_product_id", "source_column", "raw_value", ["du_last_aum", "du_last_nav"])


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A') AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O') AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def conjunctive_eligibility(s, d):
    line = table(s, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_returnflag", "l_linestatus", "l_quantity")
    return merge.intersected([table(s, d, "part"), line.where("l_returnflag = 'A'"), line.where("l_linestatus = 'O'"), line.where("l_quantity > 49")], "p_partkey")


@query("SELECT DISTINCT user_id FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)")
def on_global_latest_date(s, d):
    days = table(s, d, "events").select("user_id", F.to_date("ts").alias("day"))
    return days.join(F.broadcast(days.agg(F.max("day").alias("day"))), "day", "left_semi").select("user_id").distinct()


@query("SELECT DISTINCT entity_id FROM canonical_entities WHERE entity_id IN (SELECT canonical_product_id FROM canonical_products WHERE source_dataset = 'PREF01N001')")
def dataset_member(s, d):
    inside = table(s, d, "canonical_products").where("source_dataset = 'PREF01N001'").select(F.col("canonical_product_id").alias("entity_id"))
    return predicates.restrict(table(s, d, "canonical_entities").select("entity_id").distinct(), "entity_id", inside)


@query("SELECT DISTINCT canonical_product_id FROM canonical_products WHERE (product_type = 'ETF' AND source_dataset = 'PREF01N001') OR (product_type = 'BOND' AND currency = 'USD')")
def universe_union(s, d):
    p = table(s, d, "canonical_products")
    return p.where("(product_type = 'ETF' AND source_dataset = 'PREF01N001') OR (product_type = 'BOND' AND currency = 'USD')").select("canonical_product_id").distinct()


@query("SELECT p_partkey FROM part WHERE false")
def empty_candidates(s, d):
    none = table(s, d, "part").where("p_size < 0").select("p_partkey")
    return predicates.restrict(table(s, d, "part"), "p_partkey", none).select("p_partkey")


@query("SELECT DISTINCT l_partkey AS p_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def ordered_vocab_range(s, d):
    return _selected(s, d, Filter("a", "priority", "between", ("1-URGENT", "2-HIGH")))


# --- Ranking ----------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 ELSE 5 END DESC, o_orderkey LIMIT 50")
def ordered_vocab_sort(s, d):
    return ranking.by_vocabulary(table(s, d, "orders"), "o_orderpriority", PRIORITIES, True, "o_orderkey", 50).select("o_orderkey", "o_orderpriority")


@query(f"WITH {_LATEST_SQL} SELECT p_partkey, CAST(l_shipdate AS DATE) AS observed_on, price FROM latest")
def metric_latest_asof(s, d):
    return _prices(s, d).select("p_partkey", F.to_date("l_shipdate").alias("observed_on"), "price")


@query(f"WITH {_CONTRACT_SQL} SELECT p_partkey, price FROM c ORDER BY price DESC, p_partkey LIMIT 20")
def rank_topk_contract(s, d):
    return run(Request(sort=(Sort("price"),), limit=20), _catalog(s, d)).rows.select("p_partkey", "price")


@query(f"WITH {_CONTRACT_SQL} SELECT count(DISTINCT part.p_partkey) AS filtered_count, count(DISTINCT CASE WHEN price IS NOT NULL THEN part.p_partkey END) AS rankable_count, count(DISTINCT part.p_partkey) - count(DISTINCT CASE WHEN price IS NOT NULL THEN part.p_partkey END) AS missing_count FROM part LEFT JOIN c USING (p_partkey) WHERE p_type = 'ECONOMY'")
def rank_counts(s, d):
    return run(Request(filters=(Filter("a", "type", "eq", ("ECONOMY",)),), sort=(Sort("price"),)), _catalog(s, d)).stats


@query(f"WITH {_REGIONS_SQL}, {_CONTRACT_SQL} SELECT p.p_partkey, p_name AS name, price FROM part p JOIN c USING (p_partkey) WHERE p_type = 'ECONOMY' AND EXISTS (SELECT 1 FROM r WHERE r.p_partkey = p.p_partkey AND value = 'ASIA') ORDER BY price DESC, p.p_partkey LIMIT 5")
def flagship_request(s, d):
    request = Request(filters=(Filter("a", "type", "eq", ("ECONOMY",)), Filter("b", "region", "eq", ("ASIA",))), outputs=("name",), sort=(Sort("price"),))
    return run(request, _catalog(s, d)).rows


@query("SELECT p_type, p_partkey, p_retailprice, rank FROM (SELECT p_type, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 3")
def rank_groupwise(s, d):
    return ranking.top_per_group(table(s, d, "part"), ["p_type"], "p_retailprice", True, "p_partkey", 3).select("p_type", "p_partkey", "p_retailprice", "rank")


@query(f"WITH {_LATEST_SQL} SELECT p_partkey, price FROM part LEFT JOIN latest USING (p_partkey) ORDER BY price ASC NULLS LAST, p_partkey LIMIT 100")
def rank_nulls_last(s, d):
    rows = table(s, d, "part").select("p_partkey").join(_prices(s, d).select("p_partkey", "price"), "p_partkey", "left")
    return ranking.ordered_nulls_last(rows, "price", False, "p_partkey", 100)


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def latency_percentiles(s, d):
    return ranking.nearest_rank(table(s, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("SELECT user_id, freshness, count(*) AS n FROM (SELECT user_id, CASE WHEN CAST(ts AS DATE) = max(CAST(ts AS DATE)) OVER (PARTITION BY event_type) THEN 'LATEST' ELSE 'STALE' END AS freshness FROM events) GROUP BY 1, 2")
def freshness_status(s, d):
    rows = table(s, d, "events").select("user_id", "event_type", F.to_date("ts").alias("day"))
    return ranking.freshness(rows, "event_type", "day").groupBy("user_id", "freshness").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT subject_entity_id, metric_code, fact_id, observed_on FROM metric_observations WHERE quality_status IN ('VALID', 'SOURCE_ZERO') AND observed_on <= DATE '2026-08-24' QUALIFY row_number() OVER (PARTITION BY subject_entity_id, metric_code ORDER BY observed_on DESC, fact_id, recorded_at) = 1")
def metric_latest_valid(s, d):
    rows = table(s, d, "metric_observations").where("quality_status IN ('VALID', 'SOURCE_ZERO')")
    return ranking.latest(rows, ["subject_entity_id", "metric_code"], "observed_on", "fact_id", ["fact_id"], F.lit("2026-08-24").cast("date")).select("subject_entity_id", "metric_code", "fact_id", "observed_on")


_REFUSED = [
    ("counted", Request(wishes=("count",))),
    ("unknown_field", Request(filters=(Filter("a", "colour", "eq", ("red",)),))),
    ("wrong_operator", Request(filters=(Filter("a", "region", "gt", ("ASIA",)),))),
    ("no_contract", Request(sort=(Sort("size"),))),
    ("wrong_universe", Request(sort=(Sort("price"),), universe="moon")),
    ("allowed", Request(filters=(Filter("a", "size", "gt", (1,)),))),
]


@query("SELECT * FROM (VALUES ('counted', 'count is not offered'), ('unknown_field', 'unknown field colour'), ('wrong_operator', 'region does not take gt'), ('no_contract', 'size has no contract to sort by'), ('wrong_universe', 'price can''t be compared in moon'), ('wrong_universe', 'unknown universe moon')) t(request, reason)")
def refusals(s, d):
    catalog = _catalog(s, d)
    return s.createDataFrame([(name, reason) for name, request in _REFUSED for reason in gate(request, catalog)], "request string, reason string")


# --- Projections ------------------------------------------------------------------------------------------------------


@query(f"WITH {_REGIONS_SQL} SELECT p_partkey, string_agg(value, '|' ORDER BY value) AS regions FROM r GROUP BY 1")
def project_multivalue(s, d):
    return projection.multi_value(_regions(s, d), "p_partkey", "value", "regions")


@query("SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_type END, CASE WHEN n = 1 THEN v END) AS status FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_linestatus) AS n, min(l_linestatus) AS v FROM lineitem GROUP BY 1) ON p_partkey = l_partkey")
def project_rollup(s, d):
    parents = table(s, d, "part").withColumn("own", F.when(F.col("p_size") > 25, F.col("p_type")))
    children = table(s, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_linestatus")
    return projection.rolled_up(parents, "p_partkey", "own", children, "l_linestatus", "status", keep_many=False)


@query("SELECT l_partkey AS p_partkey, string_agg(DISTINCT s_name, '|' ORDER BY s_name) AS suppliers FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def project_relation_names(s, d):
    relations = _part_suppliers(s, d).select(F.col("l_partkey").alias("p_partkey"), "l_suppkey")
    return projection.relation_names(relations, "p_partkey", "l_suppkey", table(s, d, "supplier"), "s_suppkey", "s_name", "suppliers")


_PROVENANCE_SQL = "SELECT DISTINCT canonical_product_id, 'dataset' AS kind, source_dataset AS member FROM source_field_assertions WHERE source_dataset IS NOT NULL UNION ALL SELECT DISTINCT canonical_product_id, 'record', source_record_id FROM source_field_assertions WHERE source_record_id IS NOT NULL"


@query(_PROVENANCE_SQL)
def provenance_sets(s, d):
    """Every product's datasets and records, a row for each."""
    return projection.provenance(table(s, d, "source_field_assertions"), "canonical_product_id", {"dataset": "source_dataset", "record": "source_record_id"})


@query(f"SELECT canonical_product_id, count(*) FILTER (WHERE kind = 'dataset') AS datasets, count(*) FILTER (WHERE kind = 'record') AS records FROM ({_PROVENANCE_SQL}) GROUP BY 1")
def provenance_counts(s, d):
    return projection.provenance_counts(provenance_sets(s, d), "canonical_product_id", {"datasets": "dataset", "records": "record"})


@query("UNPIVOT (SELECT p_partkey, CAST(p_name AS VARCHAR) AS p_name, CAST(p_type AS VARCHAR) AS p_type, CAST(p_size AS VARCHAR) AS p_size FROM part) ON p_name, p_type, p_size INTO NAME field VALUE value")
def project_long_records(s, d):
    return projection.long_records(table(s, d, "part"), "p_partkey", ["p_name", "p_type", "p_size"])


@query(" UNION ALL ".join(f"SELECT source_record_key, '{c}' AS source_column, nullif(trim({c}), '') AS raw_value FROM canonical_products" + ("" if c == "isin" else f" WHERE nullif(trim({c}), '') IS NOT NULL") for c in ("ticker", "isin", "currency")))
def melt_assertions(s, d):
    return projection.melt_filled(table(s, d, "canonical_products"), ["source_record_key", "dataset_snapshot"], ["ticker", "isin", "currency"], ["isin"]).drop("dataset_snapshot")


@query("WITH o AS (SELECT DISTINCT source_record_id, quality_status AS record_quality, lower(trim(e.key)) AS source_column, e.value ->> '$' AS observed FROM source_records, json_each(CASE WHEN json_valid(raw_payload) THEN raw_payload END) e) SELECT a.assertion_id, a.source_record_id, lower(trim(a.source_column)) AS source_column, o.record_quality, o.observed FROM source_field_assertions a LEFT JOIN o ON a.source_record_id = o.source_record_id AND lower(trim(a.source_column)) = o.source_column")
def field_evidence(s, d):
    """Of every column: what the record's payload holds there."""
    column = F.lower(F.trim("source_column")).alias("source_column")
    cells = table(s, d, "source_records").select("source_record_id", F.col("quality_status").alias("record_quality"), F.explode(F.from_json("raw_payload", "map<string,string>")).alias("source_column", "observed"))
    asserted = table(s, d, "source_field_assertions").select("assertion_id", "source_record_id", column)
    found = projection.field_evidence(asserted, cells.select("source_record_id", "record_quality", column, "observed").distinct(), "source_record_id", "source_column")
    return found.select("assertion_id", "source_record_id", "source_column", "record_quality", "observed")


# --- Cleaning and quality ---------------------------------------------------------------------------------------------


@query("SELECT assertion_id, CASE WHEN v IN ('0', '00000000', '10001231', '99991231') THEN 'SENTINEL' WHEN v IS NULL OR v = '' THEN 'MISSING' WHEN regexp_full_match(v, '[0-9]{8}|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}\\.[0-9]{2}\\.[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}') AND try_strptime(regexp_replace(v, '[-./]', '', 'g'), '%Y%m%d') IS NOT NULL THEN 'VALID' ELSE 'INVALID' END AS quality FROM (SELECT assertion_id, trim(raw_value) AS v FROM source_field_assertions WHERE lower(source_column) IN ('mat_dt', 'isu_dt', 'du_upt_dt'))")
def clean_dates(s, d):
    rows = table(s, d, "source_field_assertions").where(F.lower("source_column").isin("mat_dt", "isu_dt", "du_upt_dt"))
    return rows.select("assertion_id", quality.dated(F.col("raw_value"))[1].alias("quality"))


@query("SELECT assertion_id, try_cast(replace(trim(raw_value), ',', '') AS DECIMAL(38, 6)) AS number FROM source_field_assertions WHERE lower(source_column) IN ('eval_price', 'isu_bal_amt')")
def clean_decimals(s, d):
    rows = table(s, d, "source_field_assertions").where(F.lower("source_column").isin("eval_price", "isu_bal_amt"))
    return rows.select("assertion_id", quality.decimal_of(F.col("raw_value"), 6).alias("number"))


_REASON_SQL = "CASE WHEN NOT regexp_matches(source_record_key, '^[A-Z0-9]{9,12}') THEN 'BAD_KEY' WHEN product_name IS NULL OR trim(product_name) = '' THEN 'NO_NAME' WHEN product_type NOT IN ('ETF', 'ETN', 'BOND', 'FUND') THEN 'BAD_TYPE' END"


@query(f"SELECT coalesce(source_dataset, '') AS source_dataset, {_REASON_SQL} AS reason, count(*) AS n FROM canonical_products WHERE {_REASON_SQL} IS NOT NULL GROUP BY 1, 2")
def validate_quarantine(s, d):
    c = F.col
    reason = quality.first_reason({"BAD_KEY": c("source_record_key").rlike("^[A-Z0-9]{9,12}"), "NO_NAME": c("product_name").isNotNull() & (F.trim("product_name") != ""), "BAD_TYPE": c("product_type").isin("ETF", "ETN", "BOND", "FUND")})
    _, bad = quality.split_valid(table(s, d, "canonical_products"), reason)
    return bad.groupBy(F.coalesce("source_dataset", F.lit("")).alias("source_dataset"), "reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, n AS duplicate_no FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) WHERE n > 1")
def dedupe_first_wins(s, d):
    rows = quality.first_wins(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"])
    return rows.where("duplicate_no > 1").select("l_orderkey", "l_linenumber", "l_partkey", "duplicate_no")


@query("SELECT source_record_id, strftime(max(loaded_at), '%Y-%m-%d %H:%M:%S.%f') AS loaded_at FROM source_records GROUP BY 1")
def upsert_last_write(s, d):
    rows = table(s, d, "source_records").select("source_record_id", "source_record_key", "loaded_at")
    return quality.last_write(rows, ["source_record_id"], ["loaded_at"]).select("source_record_id", F.date_format("loaded_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("loaded_at"))


def _profile_sql() -> str:
    parts = []
    fields = ["ticker", "isin", "currency", "asset_type"]
    for ds in ("source_dataset", "'__all__'"):
        for pt in ("product_type", "'__all__'"):
            for f in fields:
                v = f"nullif(trim({f}), '')"
                parts.append(f"SELECT {ds} AS source_dataset, {pt} AS product_type, '{f}' AS field, count(*) AS total, count({v}) AS valid, count(*) - count({v}) AS missing, round(count({v})::DOUBLE / count(*), 6) AS coverage, count(DISTINCT {v}) AS unique_values, count(DISTINCT {v}) = 1 AS is_constant, CASE WHEN count(DISTINCT {v}) = 1 THEN min({v}) END AS constant_value FROM canonical_products GROUP BY ALL")
    return " UNION ALL ".join(parts)


@query(_profile_sql())
def quality_profile(s, d):
    return quality.profile(table(s, d, "canonical_products"), ["source_dataset", "product_type"], ["ticker", "isin", "currency", "asset_type"])


@query("SELECT 'pd_dates' AS field, count(*) AS total, count(*) FILTER (WHERE q = 'VALID') AS valid, count(*) FILTER (WHERE q = 'MISSING') AS missing, count(*) FILTER (WHERE q = 'SENTINEL') AS sentinel, count(*) FILTER (WHERE q = 'INVALID') AS invalid FROM (SELECT CASE WHEN v IS NULL OR v = '' THEN 'MISSING' WHEN v IN ('0', '00000000', '10001231', '99991231') THEN 'SENTINEL' WHEN regexp_full_match(v, '[0-9]{8}|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}\\.[0-9]{2}\\.[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}') AND try_strptime(regexp_replace(v, '[-./]', '', 'g'), '%Y%m%d') IS NOT NULL THEN 'VALID' ELSE 'INVALID' END AS q FROM (SELECT trim(raw_value) AS v FROM source_field_assertions WHERE lower(source_column) LIKE '%_dt'))")
def coverage_counts(s, d):
    rows = table(s, d, "source_field_assertions").where(F.lower("source_column").endswith("_dt"))
    return quality.coverage(rows, {"pd_dates": quality.dated(F.col("raw_value"))[1]})


@query("SELECT asset_manager, normalized_product_name, count(DISTINCT canonical_product_id) AS entities FROM canonical_products WHERE asset_manager IS NOT NULL AND normalized_product_name IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT canonical_product_id) > 1 UNION ALL SELECT asset_manager, base_index, count(DISTINCT canonical_product_id) FROM canonical_products WHERE asset_manager IS NOT NULL AND base_index IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT canonical_product_id) > 1")
def identifier_conflicts(s, d):
    p = table(s, d, "canonical_products")
    by_name = quality.shared_identifiers(p, ["asset_manager", "normalized_product_name"], "canonical_product_id")
    by_index = quality.shared_identifiers(p, ["asset_manager", "base_index"], "canonical_product_id")
    return by_name.unionByName(by_index.withColumnRenamed("base_index", "normalized_product_name"))


@query("SELECT canonical_product_id, count(DISTINCT trim(currency)) AS \"values\", min(trim(currency)) AS least, max(trim(currency)) AS greatest FROM canonical_products WHERE currency IS NOT NULL GROUP BY 1 HAVING count(DISTINCT trim(currency)) > 1")
def fact_conflicts(s, d):
    return quality.conflicts(table(s, d, "canonical_products").withColumn("currency", F.trim("currency")), ["canonical_product_id"], "currency")


@query("SELECT metric_code, unit, count(*) AS rows FROM metric_observations WHERE unit IS NOT NULL AND (metric_code, unit) NOT IN (SELECT metric, unit FROM comparison_contracts) GROUP BY 1, 2")
def contract_violations(s, d):
    contract = table(s, d, "comparison_contracts").select(F.col("metric").alias("metric_code"), "unit")
    return quality.contract_violations(table(s, d, "metric_observations").where("unit IS NOT NULL"), ["metric_code", "unit"], contract)


@query("SELECT fact_id, subject_entity_id FROM metric_observations WHERE subject_entity_id NOT IN (SELECT canonical_product_id FROM canonical_products)")
def reconcile_orphans(s, d):
    rows = table(s, d, "metric_observations").select("fact_id", "subject_entity_id")
    return quality.orphans(rows, "subject_entity_id", table(s, d, "canonical_products"), "canonical_product_id")


@query("SELECT sum(n - 1) AS duplicates FROM (SELECT count(*) AS n FROM documents GROUP BY text)")
def duplicate_texts(s, d):
    return quality.duplicate_rows(table(s, d, "documents"), ["text"])


@query("SELECT fund_code, CASE WHEN bool_or(ratio < 0 OR ratio > 100) THEN 'INVALID' WHEN bool_or(itm_no IS NULL) THEN 'PARTIAL' ELSE 'READY' END AS status, count(*) AS rows FROM kodex_holding_items GROUP BY 1")
def portfolio_status(s, d):
    bad = F.bool_or((F.col("ratio") < 0) | (F.col("ratio") > 100))
    return table(s, d, "kodex_holding_items").groupBy("fund_code").agg(F.when(bad, "INVALID").when(F.bool_or(F.col("itm_no").isNull()), "PARTIAL").otherwise("READY").alias("status"), F.count(F.lit(1)).alias("rows"))


@query("SELECT DISTINCT isin, CASE WHEN regexp_full_match(upper(trim(isin)), '[A-Z]{2}[A-Z0-9]{9}[0-9]') THEN 'VALIDATED' WHEN regexp_full_match(trim(isin), '0+') THEN 'ZERO' ELSE 'INVALID' END AS validation FROM canonical_products WHERE isin IS NOT NULL AND trim(isin) <> ''")
def identifier_validation(s, d):
    rows = table(s, d, "canonical_products").where("isin IS NOT NULL AND trim(isin) <> ''")
    return rows.select("isin", quality.identifier(F.col("isin"))[1].alias("validation")).distinct()


# --- Text, vectors, graph, entities -----------------------------------------------------------------------------------

_TOKENS_SQL = "regexp_extract_all(lower(text), '[a-z0-9]+(?:[.&+\\-][a-z0-9]+)*|[가-힣]+')"


def _bm25_sql(terms: list[str], where: str) -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{q}')) AS tf{i}" for i, q in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0)::DOUBLE AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i}::DOUBLE * 2.5 / (tf{i} + 1.5 * (0.25 + 0.75 * l / avgl))" for i in range(len(terms)))
    return f"WITH t AS (SELECT doc_id, {_TOKENS_SQL} AS t FROM documents WHERE {where}), c AS (SELECT doc_id, len(t) AS l, {tf} FROM t), s AS (SELECT count(*)::DOUBLE AS n, avg(l) AS avgl, {df} FROM c) SELECT doc_id, round(exact, 6) AS score FROM (SELECT doc_id, {score} AS exact FROM c, s) WHERE exact > 0 ORDER BY exact DESC, doc_id LIMIT 20"


@query(_bm25_sql(["refund", "claim", "dividend"], "true"))
def bm25_topk(s, d):
    return text.bm25(table(s, d, "documents"), "doc_id", "text", ["refund", "claim", "dividend"], 20)


@query(_bm25_sql(["wafer", "memory"], "lower(trim(lang)) = 'en'"))
def bm25_filtered_stats(s, d):
    return text.bm25(table(s, d, "documents").where("lower(trim(lang)) = 'en'"), "doc_id", "text", ["wafer", "memory"], 20)


@query(_bm25_sql(["기준가격은", "세율"], "entity_id IN (SELECT canonical_product_id FROM canonical_products WHERE product_type = 'ETF')"))
def bm25_candidates(s, d):
    etf = table(s, d, "canonical_products").where("product_type = 'ETF'").select(F.col("canonical_product_id").alias("entity_id"))
    return text.bm25(predicates.restrict(table(s, d, "documents"), "entity_id", etf), "doc_id", "text", ["기준가격은", "세율"], 20)


@query(f"SELECT lower(replace(trim(source), '-', '_')) AS source, count(*) AS documents, sum(len({_TOKENS_SQL}))::BIGINT AS tokens, round(avg(len({_TOKENS_SQL})), 6) AS mean_tokens FROM documents GROUP BY 1")
def token_stats(s, d):
    docs = table(s, d, "documents").withColumn("source", F.lower(F.replace(F.trim("source"), F.lit("-"), F.lit("_"))))
    return text.token_stats(docs, ["source"], "text")


_QUERY_VECTOR = [0.125] * 64


@query("SELECT vec_id, round(exact, 6) AS score FROM (SELECT vec_id, list_sum(list_transform(embedding, lambda x: x::DOUBLE * 0.125)) AS exact FROM embeddings) ORDER BY exact DESC, vec_id LIMIT 10")
def cosine_topk(s, d):
    return text.cosine(table(s, d, "embeddings"), "vec_id", "embedding", _QUERY_VECTOR, 10)


@query("SELECT vec_id, round(exact, 6) AS score FROM (SELECT vec_id, list_sum(list_transform(embedding, lambda x: x::DOUBLE * 0.125)) AS exact FROM embeddings WHERE label IN (1, 2)) ORDER BY exact DESC, vec_id LIMIT 10")
def cosine_candidates(s, d):
    return text.cosine(table(s, d, "embeddings").where("label IN (1, 2)"), "vec_id", "embedding", _QUERY_VECTOR, 10)


@query()
def hash_embedding(s, d):
    """Hash embeddings of all documents; the hash has no SQL."""
    return table(s, d, "documents").select("doc_id", ftext.hash_embedding(F.col("text")).alias("embedding"))


def _edges(s: SparkSession, d: str) -> DataFrame:
    made = _part_suppliers(s, d).select(F.concat_ws(":", F.lit("ps"), "l_partkey", "l_suppkey").alias("edge_id"), F.concat(F.lit("p"), F.col("l_partkey")).alias("subject"), F.lit("SUPPLIED_BY").alias("relation"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("object"))
    home = table(s, d, "supplier").select(F.concat_ws(":", F.lit("sn"), "s_suppkey", "s_nationkey").alias("edge_id"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("subject"), F.lit("BASED_IN").alias("relation"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("object"))
    return made.unionByName(home)


_WALKABLE = ["SUPPLIED_BY", "BASED_IN"]


def _nodes(s: SparkSession, *ids: str) -> DataFrame:
    return s.createDataFrame([(i,) for i in ids], "node string")


@query("SELECT DISTINCT 'p' || l_partkey AS n0, 'ps:' || l_partkey || ':' || l_suppkey AS e0, 's' || l_suppkey AS n1 FROM lineitem WHERE l_suppkey = 7")
def graph_one_hop(s, d):
    return graph.paths(_edges(s, d), [Hop("SUPPLIED_BY")], _WALKABLE, end=_nodes(s, "s7"))


_TWO_HOP_SQL = "SELECT DISTINCT 'p' || l_partkey AS n0, 'ps:' || l_partkey || ':' || l_suppkey AS e0, 's' || l_suppkey AS n1, 'sn:' || s_suppkey || ':' || s_nationkey AS e1, 'n' || s_nationkey AS n2 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey IN (3, 4)"


@query(_TWO_HOP_SQL)
def graph_two_hop_anchor(s, d):
    return graph.paths(_edges(s, d), [Hop("SUPPLIED_BY"), Hop("BASED_IN")], _WALKABLE, end=_nodes(s, "n3", "n4")).select("n0", "e0", "n1", "e1", "n2")


@query(f"SELECT e0, e1, CASE WHEN n0 IN ('p1', 'p2', 'p3') THEN n0 WHEN n1 = 's5' THEN n1 END AS result FROM ({_TWO_HOP_SQL}) WHERE n0 IN ('p1', 'p2', 'p3') OR n1 = 's5'")
def graph_candidate_any_node(s, d):
    found = graph.paths(_edges(s, d), [Hop("SUPPLIED_BY"), Hop("BASED_IN")], _WALKABLE, end=_nodes(s, "n3", "n4"))
    return graph.touching(found, _nodes(s, "p1", "p2", "p3", "s5"), ["n0", "n1", "n2"]).select("e0", "e1", "result")


@query("SELECT DISTINCT 'p' || l_partkey AS n0 FROM lineitem WHERE l_suppkey = 7 INTERSECT SELECT DISTINCT 'p' || l_partkey FROM lineitem WHERE l_suppkey = 9")
def graph_paths_and(s, d):
    parts = [graph.paths(_edges(s, d), [Hop("SUPPLIED_BY")], _WALKABLE, end=_nodes(s, x)) for x in ("s7", "s9")]
    return graph.all_paths(parts, "n0")


@query("SELECT DISTINCT 'ps:' || l_partkey || ':' || l_suppkey AS e0, 'p' || l_partkey AS n0 FROM lineitem WHERE l_suppkey IN (7, 9)")
def graph_paths_union(s, d):
    parts = [graph.paths(_edges(s, d), [Hop("SUPPLIED_BY")], _WALKABLE, end=_nodes(s, x)) for x in ("s7", "s9")]
    return graph.any_path(parts, "e0").select("e0", "n0")


@query("SELECT subject, relation, object, string_agg(DISTINCT status, '|' ORDER BY status) AS status FROM (SELECT l_partkey AS subject, 'SUPPLIED_BY' AS relation, l_suppkey AS object, l_linestatus AS status FROM lineitem) GROUP BY 1, 2, 3")
def graph_edges_merged(s, d):
    rows = table(s, d, "lineitem").select(F.col("l_partkey").alias("subject"), F.lit("SUPPLIED_BY").alias("relation"), F.col("l_suppkey").alias("object"), F.col("l_linestatus").alias("status"))
    return graph.merged_edges(rows, "status")


@query("SELECT s_suppkey, s_nationkey AS class, count(*) OVER (PARTITION BY s_nationkey) - 1 AS links FROM supplier")
def self_join_same_object(s, d):
    """Suppliers by the nation they share, with the number of others there: the pairs' classes, not the pairs."""
    return graph.same_object(table(s, d, "supplier"), "s_suppkey", "s_nationkey")


_NAME = "lower(regexp_replace(trim({}), '\\s+', '', 'g'))"
_TIERS_SQL = f"""t AS (SELECT trim(preferred_name) AS key, entity_id, 1 AS tier FROM canonical_entities WHERE preferred_name IS NOT NULL
  UNION SELECT trim(alias), entity_id, 2 FROM entity_aliases WHERE entity_id IS NOT NULL
  UNION SELECT {_NAME.format('preferred_name')}, entity_id, 3 FROM canonical_entities WHERE preferred_name IS NOT NULL),
m AS (SELECT DISTINCT trim(alias) AS mention FROM entity_aliases WHERE alias IS NOT NULL),
h AS (SELECT DISTINCT mention, entity_id, tier FROM m JOIN t ON mention = key QUALIFY tier = min(tier) OVER (PARTITION BY mention))"""


def _tier_hits(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    entities = table(s, d, "canonical_entities").where("preferred_name IS NOT NULL")
    aliases = table(s, d, "entity_aliases")
    plain = F.lower(F.regexp_replace(F.trim("preferred_name"), r"\s+", ""))
    tiers = [entities.select(F.trim("preferred_name").alias("key"), "entity_id"), aliases.where("entity_id IS NOT NULL").select(F.trim("alias").alias("key"), "entity_id"), entities.select(plain.alias("key"), "entity_id")]
    mentions = aliases.where("alias IS NOT NULL").select(F.trim("alias").alias("mention"))
    return mentions, entity.exact_tiers(mentions, "mention", tiers)


@query(f"WITH {_TIERS_SQL} SELECT mention, entity_id, tier FROM h")
def entity_exact_tiers(s, d):
    return _tier_hits(s, d)[1]


@query(f"WITH {_TIERS_SQL} SELECT mention, count(DISTINCT entity_id) AS candidates, CASE count(DISTINCT entity_id) WHEN 0 THEN 'UNRESOLVED' WHEN 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS status, CASE count(DISTINCT entity_id) WHEN 1 THEN min(entity_id) END AS entity_id FROM m LEFT JOIN h USING (mention) GROUP BY 1")
def entity_ambiguity(s, d):
    mentions, hits = _tier_hits(s, d)
    return entity.resolution(mentions, "mention", hits)


@query()
def entity_fuzzy(s, d):
    """Near matches of organisation and product aliases; the likeness has no SQL."""
    entities, aliases = table(s, d, "canonical_entities"), table(s, d, "entity_aliases")
    ids = entities.select("entity_id", "entity_kind", "query_eligible")
    names = entities.select("entity_id", entity.name_key(F.col("preferred_name")).alias("name"), "entity_kind", "query_eligible").unionByName(aliases.join(ids, "entity_id").select("entity_id", entity.name_key(F.col("alias")).alias("name"), "entity_kind", "query_eligible"))
    mentions = aliases.select(entity.name_key(F.col("alias")).alias("mention"), "alias_type")
    organisation = F.col("entity_kind") == "ORGANIZATION"
    near = lambda kind, known, *how: entity.near_matches(mentions.where(F.col("alias_type") == kind), "mention", names.where(known), *how).withColumn("alias_type", F.lit(kind))
    return near("ORGANIZATION", organisation, entity.MIN_LENGTH, ORGANISATION_KINDS).unionByName(near("PRODUCT", ~organisation & F.col("query_eligible"), entity.MIN_LENGTH_PRODUCT))


@query("""WITH p AS (SELECT DISTINCT canonical_product_id, isin, ticker, asset_manager FROM canonical_products),
hits AS (SELECT a.canonical_product_id AS key, b.canonical_product_id AS entity_id, 0 AS p FROM p a JOIN p b ON a.isin = b.isin UNION ALL SELECT a.canonical_product_id, b.canonical_product_id, 1 FROM p a JOIN p b ON a.ticker = b.ticker AND a.asset_manager = b.asset_manager)
SELECT k.key, CASE WHEN count(DISTINCT entity_id) = 1 THEN min(entity_id) END AS entity_id, CASE count(DISTINCT entity_id) WHEN 0 THEN 'UNRESOLVED' WHEN 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS status FROM (SELECT DISTINCT canonical_product_id AS key FROM p) k LEFT JOIN hits USING (key) GROUP BY 1""")
def multi_identifier_resolution(s, d):
    p = table(s, d, "canonical_products").select("canonical_product_id", "isin", "ticker", "asset_manager").distinct()
    known = p.withColumnRenamed("canonical_product_id", "entity_id")
    return entity.by_identifiers(p.withColumnRenamed("canonical_product_id", "key"), "key", [(["isin"], known), (["ticker", "asset_manager"], known)])


# --- Merge, findings, connectors --------------------------------------------------------------------------------------


@query("SELECT DISTINCT l_partkey AS p_partkey FROM lineitem WHERE l_suppkey = 3 INTERSECT SELECT p_partkey FROM part WHERE p_size > 20 INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def merge_intersection(s, d):
    line = table(s, d, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    return merge.intersected([line.where("l_suppkey = 3"), table(s, d, "part").where("p_size > 20"), line.where("l_returnflag = 'A'")], "p_partkey")


@query("SELECT p_partkey, rank FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY rank LIMIT 50")
def merge_ranked(s, d):
    """The limit comes after the intersection; only the chosen parts' places among all parts are counted."""
    place = F.struct(F.col("p_retailprice").isNull().alias("none"), (-F.col("p_retailprice")).alias("less"), F.col("p_partkey").alias("key"))
    parts = table(s, d, "part").select("p_partkey", place.alias("place"))
    best = merge.ranked(parts, [table(s, d, "lineitem").where("l_returnflag = 'R'").withColumnRenamed("l_partkey", "p_partkey")], "p_partkey", "place", 50)
    ahead = parts.select(F.col("place").alias("other")).join(F.broadcast(best), F.col("other") <= F.col("place"))
    return ahead.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("rank"))


@query("WITH a AS (SELECT source_record_key AS key, max(product_name) AS v FROM canonical_products WHERE dataset_snapshot = '2026-06-08' GROUP BY 1), b AS (SELECT source_record_key AS key, max(product_name) AS v FROM canonical_products WHERE dataset_snapshot = '2026-08-24' GROUP BY 1) SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'new' WHEN b.key IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.key = b.key WHERE a.key IS NULL OR b.key IS NULL OR a.v IS DISTINCT FROM b.v")
def set_difference(s, d):
    p = table(s, d, "canonical_products")
    a, b = [p.where(F.col("dataset_snapshot") == day).groupBy(F.col("source_record_key").alias("key")).agg(F.max("product_name").alias("v")) for day in ("2026-06-08", "2026-08-24")]
    return merge.key_changes(a, b, "key", "v")


@query("WITH l AS (SELECT DISTINCT canonical_product_id AS e FROM canonical_products), r AS (SELECT DISTINCT entity_id AS e FROM canonical_entities), n AS (SELECT count(*) FILTER (WHERE l.e IS NOT NULL AND r.e IS NOT NULL) AS \"both\", count(*) FILTER (WHERE r.e IS NULL) AS only_left, count(*) FILTER (WHERE l.e IS NULL) AS only_right FROM l FULL JOIN r ON l.e = r.e) SELECT *, CASE WHEN only_left = 0 AND only_right = 0 THEN 'EQUAL' WHEN only_left = 0 THEN 'SUBSET' WHEN only_right = 0 THEN 'SUPERSET' WHEN \"both\" = 0 THEN 'DISJOINT' ELSE 'OVERLAP' END AS verdict FROM n")
def shadow_compare(s, d):
    return merge.compared(table(s, d, "canonical_products").select(F.col("canonical_product_id").alias("e")), table(s, d, "canonical_entities").select(F.col("entity_id").alias("e")), "e")


def _evidence(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "canonical_products")
    return projection.long_records(p.select(F.col("canonical_product_id").alias("entity_id"), F.trim("currency").alias("currency"), F.trim("ticker").alias("ticker"), F.trim("asset_type").alias("asset_type")), "entity_id", ["currency", "ticker", "asset_type"]).distinct()


_EVIDENCE_SQL = "e AS (SELECT DISTINCT canonical_product_id AS entity_id, f.field, f.value FROM canonical_products, LATERAL (VALUES ('currency', trim(currency)), ('ticker', trim(ticker)), ('asset_type', trim(asset_type))) f(field, value))"
_CONFLICT_SQL = "SELECT 'CONFLICT' AS code, CASE WHEN field = 'currency' THEN 'BLOCKING' ELSE 'WARNING' END AS severity, entity_id, field, count(DISTINCT value)::VARCHAR AS detail FROM e GROUP BY entity_id, field HAVING count(DISTINCT value) > 1"
_MISSING_SQL = "SELECT 'MISSING' AS code, 'BLOCKING' AS severity, entity_id, field, NULL::VARCHAR AS detail FROM e WHERE field IN ('currency', 'ticker') GROUP BY entity_id, field HAVING count(value) = 0"


@query(f"WITH {_EVIDENCE_SQL} {_CONFLICT_SQL}")
def findings_conflict(s, d):
    return findings.conflicting(_evidence(s, d), ["currency"])


@query(f"WITH {_EVIDENCE_SQL} {_MISSING_SQL}")
def findings_missing(s, d):
    e = _evidence(s, d)
    return findings.missing(e, e, ["currency", "ticker"])


@query(f"WITH {_EVIDENCE_SQL}, bad AS ({_CONFLICT_SQL} UNION ALL {_MISSING_SQL}), blocked AS (SELECT DISTINCT entity_id, field FROM bad WHERE severity = 'BLOCKING' AND field IN ('currency', 'ticker')), n AS (SELECT entity_id, 2 - (SELECT count(*) FROM blocked b WHERE b.entity_id = x.entity_id) AS answerable FROM (SELECT DISTINCT entity_id FROM e) x) SELECT entity_id, answerable, CASE answerable WHEN 2 THEN 'FULLY' WHEN 0 THEN 'UNANSWERABLE' ELSE 'PARTIALLY' END AS verdict FROM n")
def verdict_matrix(s, d):
    e = _evidence(s, d)
    found = findings.all_findings([findings.conflicting(e, ["currency"]), findings.missing(e, e, ["currency", "ticker"])])
    return findings.verdict_matrix(e, ["currency", "ticker"], found)


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_field(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("SELECT l_orderkey, CASE WHEN count(*) FILTER (WHERE l_linenumber = 1) = 1 THEN max(l_extendedprice) FILTER (WHERE l_linenumber = 1) END AS first_price FROM lineitem GROUP BY 1")
def json_parallel_arrays(s, d):
    rows = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("t"), F.collect_list("l_extendedprice").alias("v"))
    return rows.select("l_orderkey", connectors.parallel_value(F.col("t"), F.col("v"), 1).alias("first_price"))


@query("SELECT doc_id, lower(replace(trim(source), '-', '_')) AS source, 'https://' || lower(trim(lang)) || '.example/x?a=1&b=2' AS url FROM documents WHERE lang IS NOT NULL")
def url_normalize(s, d):
    raw = F.concat(F.lit("HTTPS://user@"), F.upper(F.trim("lang")), F.lit(".Example:443/x?b=2&a=1#top"))
    return table(s, d, "documents").where("lang IS NOT NULL").select("doc_id", F.lower(F.replace(F.trim("source"), F.lit("-"), F.lit("_"))).alias("source"), ftext.normalized_url(raw).alias("url"))


@query("SELECT entity_id, sha256(concat_ws('|', entity_id, entity_kind)) AS source_scoped_id FROM canonical_entities")
def scoped_identity(s, d):
    return table(s, d, "canonical_entities").select("entity_id", F.sha2(F.concat_ws("|", "entity_id", "entity_kind"), 256).alias("source_scoped_id"))


@query("SELECT relation, count(*) AS edges FROM (SELECT DISTINCT 'SUPPLIED_BY' AS relation, l_partkey, l_suppkey FROM lineitem UNION ALL SELECT 'BASED_IN', s_suppkey, s_nationkey FROM supplier) GROUP BY 1")
def graph_counts(s, d):
    return _edges(s, d).groupBy("relation").agg(F.count(F.lit(1)).alias("edges"))


@query("SELECT dataset_id, count(*) FILTER (WHERE upper(status) = 'READY') AS released, count(*) AS snapshots, CAST(max(CASE WHEN upper(status) = 'READY' THEN snapshot_date END) AS DATE) AS newest FROM dataset_snapshots GROUP BY 1")
def snapshot_readiness(s, d):
    ready = F.upper("status") == "READY"
    return table(s, d, "dataset_snapshots").groupBy("dataset_id").agg(F.count_if(ready).alias("released"), F.count(F.lit(1)).alias("snapshots"), F.max(F.when(ready, F.col("snapshot_date"))).cast("date").alias("newest"))


@query("SELECT source_record_id, CAST(coalesce(try_strptime(trim(json_extract_string(raw_payload, '$.mat_dt')), '%Y-%m-%d'), NULL) AS DATE) AS maturity FROM source_records WHERE dataset_id = 'PRBD01N001'")
def payload_dates(s, d):
    rows = table(s, d, "source_records").where("dataset_id = 'PRBD01N001'")
    value = F.trim(F.get_json_object("raw_payload", "$.mat_dt"))
    return rows.select("source_record_id", F.when(value.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), parsing.day_divided(value)).alias("maturity"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
