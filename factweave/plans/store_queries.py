"""Queries of the fact store's life: mapping, emission, snapshots, evidence, graph records, indexes, findings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions import text as ftext
from factweave.operators import entity, findings, graph, mapping, merge, projection, quality, text, wide
from factweave.operators.graph import Hop
from factweave.operators.predicates import Filter, Tree
from factweave.plans import question
from factweave.plans import request as planning
from factweave.session import table
from factweave.sources import store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

LAST_DAY = "2026-08-24"
#: The four datasets with the namespaces of their products, and the payload fields of canonical ones.
NAMESPACES = {"PRBD01N001": "bond_kr", "PREF01N001": "etf_kr", "PREF02N001": "etf_gl", "PRFD01N001": "fund_pub"}
LAYOUTS = {
    "PRBD01N001": {"name": ["pd_nm", "pd_abrv_nm"], "currency": ["curr_cd"], "issuer": ["pd_pbcm"]},
    "PREF01N001": {"name": ["pd_nm", "pd_abrv_nm"], "currency": ["pd_curr_cd"], "manager": ["cu_fund_mgmt_co"], "isin": ["pd_isin_cd"]},
    "PREF02N001": {"name": ["pd_nm", "pd_abrv_nm"], "currency": ["pd_trd_ccy"], "manager": ["cu_fund_mgmt_co"], "isin": ["pd_isin_cd"]},
    "PRFD01N001": {"name": ["itm_nm", "itm_abrv_nm"], "currency": ["curr_cd"], "manager": ["or_co_xtn_itt_cd"]},
}
#: Kinds of evidence by the category of a column.
CATEGORY_KINDS = {"ATTRIBUTE": "attribute", "DATE": "date", "STATUS": "status", "METRIC": "metric"}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


_DATE_SQL = "regexp_full_match({0}, '[0-9]{{8}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{4}}\\.[0-9]{{2}}\\.[0-9]{{2}}|[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}') AND try_strptime(regexp_replace({0}, '[-./]', '', 'g'), '%Y%m%d') IS NOT NULL"
_TYPED_SQL = "t AS (SELECT a.*, d.value_type, d.source_column AS declared, nullif(trim(a.normalized_value), '') AS v FROM source_field_assertions a JOIN source_column_types d ON upper(trim(a.source_dataset)) = d.source_dataset AND lower(trim(a.source_column)) = d.source_column)"


def _typed(s: SparkSession, d: str) -> DataFrame:
    """Assertions with the declared column (``_declared``) and type (``_type``) of their field."""
    return wide.assertion_cells(table(s, d, "source_field_assertions"), table(s, d, "source_column_types"))


# --- Mapping ----------------------------------------------------------------------------------------------------------


@query(f"WITH {_TYPED_SQL}, q AS (SELECT assertion_id, v, declared, CASE WHEN v IS NULL THEN 'MISSING' WHEN (value_type = 'date' AND v IN ('0', '00000000', '10001231', '99991231')) OR (declared = 'rptt_ksd_itm_no' AND v = '000000000000') THEN 'SENTINEL' WHEN (value_type = 'date' AND NOT ({_DATE_SQL.format('v')})) OR (declared = 'rptt_ksd_itm_no' AND NOT regexp_full_match(v, '[A-Za-z0-9]{{9,12}}')) THEN 'INVALID' WHEN declared = 'buyable_quantity' THEN 'UNUSABLE_BY_POLICY' WHEN declared = 'cu_base_index' AND lower(v) IN ('not provided', 'not available') THEN 'VENDOR_PLACEHOLDER' ELSE 'VALID' END AS quality, value_type FROM t) SELECT assertion_id, quality, CASE WHEN quality = 'VALID' AND value_type = 'date' THEN CAST(CAST(try_strptime(regexp_replace(v, '[-./]', '', 'g'), '%Y%m%d') AS DATE) AS VARCHAR) WHEN quality IN ('VALID', 'UNUSABLE_BY_POLICY') THEN v END AS normalized FROM q")
def assertion_classes(s, d):
    """Every assertion's class: missing, sentinel, invalid, unusable by policy, placeholder or valid."""
    c = F.col
    value, column = F.trim("normalized_value"), c("_declared")
    is_id = column == "rptt_ksd_itm_no"
    placeholder = F.when((column == "cu_base_index") & F.lower(value).isin("not provided", "not available"), "VENDOR_PLACEHOLDER")
    told = mapping.assertion_class(value, c("_type") == "date", is_id & (value == "000000000000"), is_id & ~value.rlike("^[A-Za-z0-9]{9,12}$"), column == "buyable_quantity", placeholder)
    return _typed(s, d).select("assertion_id", told.alias("k")).select("assertion_id", "k.quality", "k.normalized")


@query(f"WITH {_TYPED_SQL}, x AS (SELECT *, trim(normalized_value, E' \\t\\n\\r') AS w FROM t WHERE v IS NOT NULL) SELECT source_dataset, declared AS source_column, count(*) AS violations FROM (SELECT upper(trim(source_dataset)) AS source_dataset, declared, CASE value_type WHEN 'text' THEN true WHEN 'numeric' THEN regexp_full_match(w, '[+-]?([0-9]+|[0-9]{{1,3}}(,[0-9]{{3}})+)(\\.[0-9]+)?') WHEN 'integer' THEN regexp_full_match(w, '[+-]?[0-9]+') WHEN 'date' THEN {_DATE_SQL.format('w')} ELSE regexp_full_match(w, '[YyNn]') END AS ok FROM x) WHERE NOT ok GROUP BY 1, 2")
def type_violations(s, d):
    """Assertions whose value suits not the declared type, by column."""
    bad = mapping.type_violations(_typed(s, d), "normalized_value", "_type")
    return bad.groupBy("source_dataset", F.col("_declared").alias("source_column")).agg(F.count(F.lit(1)).alias("violations"))


def _payload_sql(field: str) -> str:
    return f"nullif(trim(json_extract_string(raw_payload, '$.{field}')), '')"


def _mapped_sql(name: str) -> str:
    cases = " ".join(f"WHEN '{ds}' THEN coalesce({', '.join(_payload_sql(f) for f in layout[name])})" for ds, layout in LAYOUTS.items() if name in layout)
    return f"CASE dataset_id {cases} END AS {name}"


@query("SELECT source_record_id, CASE dataset_id " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMESPACES.items()) + " END || ':' || trim(source_record_key) AS product_id, " + ", ".join(map(_mapped_sql, ("name", "currency", "issuer", "manager", "isin"))) + " FROM source_records")
def mapped_products(s, d):
    """Canonical columns of every record, by its dataset's layout, with a namespaced id."""
    return mapping.mapped(table(s, d, "source_records"), "raw_payload", "dataset_id", LAYOUTS, NAMESPACES, "source_record_key", ["source_record_id"])


@query(f"SELECT source_record_id, CASE WHEN regexp_full_match(rep, '[A-Za-z0-9]{{9,12}}') AND NOT regexp_full_match(rep, '0+') THEN rep WHEN cls IS NOT NULL THEN own END AS parent_id, CASE WHEN regexp_full_match(rep, '[A-Za-z0-9]{{9,12}}') AND NOT regexp_full_match(rep, '0+') THEN 'REPRESENTATIVE' WHEN cls IS NOT NULL THEN 'CLASS_CODE' ELSE 'UNRESOLVED' END AS rule FROM (SELECT source_record_id, {_payload_sql('rptt_ksd_itm_no')} AS rep, {_payload_sql('han_clas_nm')} AS cls, {_payload_sql('itm_no')} AS own FROM source_records WHERE dataset_id = 'PRFD01N001')")
def fund_parents(s, d):
    """The fund a share class belongs to: its representative, or itself if it has a class; else none is invented."""
    rows = table(s, d, "source_records").where("dataset_id = 'PRFD01N001'").select("source_record_id", F.from_json("raw_payload", "rptt_ksd_itm_no string, han_clas_nm string, itm_no string").alias("p"))
    parent, rule = mapping.parent_key(F.col("p.rptt_ksd_itm_no"), F.col("p.han_clas_nm"), F.col("p.itm_no"), "^[A-Za-z0-9]{9,12}$")
    return rows.select("source_record_id", parent.alias("parent_id"), rule.alias("rule"))


@query(f"SELECT source_record_id, CASE WHEN regexp_full_match(regexp_replace(upper(cur), '^CURR_CD_', ''), '[A-Z]{{3}}') THEN regexp_replace(upper(cur), '^CURR_CD_', '') END AS currency, CASE sale WHEN 'Y' THEN 'ON_SALE' WHEN 'N' THEN 'NOT_ON_SALE' ELSE 'UNKNOWN' END AS sale_status FROM (SELECT source_record_id, {_payload_sql('curr_cd')} AS cur, {_payload_sql('sale_yn')} AS sale FROM source_records WHERE dataset_id IN ('PRBD01N001', 'PRFD01N001'))")
def code_maps(s, d):
    """Codes brought to canonical ones; what the tables don't list is unknown, not guessed."""
    rows = table(s, d, "source_records").where("dataset_id IN ('PRBD01N001', 'PRFD01N001')").select("source_record_id", F.from_json("raw_payload", "curr_cd string, sale_yn string").alias("p"))
    return rows.select("source_record_id", mapping.code(F.col("p.curr_cd"), "^[A-Z]{3}$", "CURR_CD_").alias("currency"), mapping.code_state(F.col("p.sale_yn"), {"Y": "ON_SALE", "N": "NOT_ON_SALE"}).alias("sale_status"))


@query("SELECT DISTINCT base_index, NOT contains(base_index, '+') AND NOT regexp_matches(lower(base_index), 'not provided|not available|해당없음|없음| 25%| 50%| 75%| 90%') AS atomic FROM canonical_products WHERE base_index IS NOT NULL")
def atomic_indexes(s, d):
    return table(s, d, "canonical_products").where("base_index IS NOT NULL").select("base_index", mapping.atomic_index(F.col("base_index")).alias("atomic")).distinct()


@query("SELECT 'attribute' AS kind, count(*) AS rows FROM source_field_assertions a WHERE quality_status = 'VALID' AND EXISTS (SELECT 1 FROM source_field_assertions b WHERE a.source_dataset = b.source_dataset AND a.source_column = b.source_column AND b.mapping_category = 'ATTRIBUTE') UNION ALL SELECT 'metric', count(*) FROM source_field_assertions a WHERE quality_status = 'VALID' AND EXISTS (SELECT 1 FROM source_field_assertions b WHERE a.source_dataset = b.source_dataset AND a.source_column = b.source_column AND b.mapping_category = 'METRIC')")
def assertions_by_category(s, d):
    """Valid assertions sent to the kind of evidence their column makes."""
    rows = table(s, d, "source_field_assertions")
    layout = rows.groupBy("source_dataset", "source_column").agg(F.min("mapping_category").alias("category"))
    parts = mapping.by_category(rows, layout, CATEGORY_KINDS, F.col("quality_status") == "VALID")
    counted = [parts[k].select(F.lit(k).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("rows")) for k in ("attribute", "metric")]
    return counted[0].unionByName(counted[1])


_METRICS = {"aum": ("AUM", "CURRENCY_AMOUNT", "CURRENCY_UNIT"), "expense_ratio": ("EXPENSE_RATIO", "PERCENT", "SOURCE_PERCENT")}


@query(" UNION ALL ".join(f"SELECT p.canonical_product_id, p.dataset_snapshot, '{m}' AS metric, p.source_dataset AS dataset, '{u}' AS unit, '{sc}' AS scale_basis, p.currency, CAST(try_strptime(p.observed_at, '%Y-%m-%d') AS DATE) AS observed_on, {col} AS numeric_value, CASE WHEN {col} = 0 THEN 'SOURCE_ZERO' ELSE 'VALID' END AS quality_status, CASE WHEN try_strptime(p.observed_at, '%Y-%m-%d') IS NOT NULL AND EXISTS (SELECT 1 FROM comparison_contracts c WHERE c.metric = '{m}' AND c.dataset = p.source_dataset AND c.unit = '{u}' AND c.scale_basis = '{sc}' AND (c.currency IS NULL OR c.currency = p.currency)) THEN 'COMPARABLE' ELSE 'NOT_COMPARABLE' END AS comparability FROM canonical_products p WHERE {col} IS NOT NULL" for col, (m, u, sc) in _METRICS.items()))
def metric_emission(s, d):
    """Observations made of metric columns, comparable where a contract lists them."""
    rows = table(s, d, "canonical_products").withColumn("day", F.try_to_date("observed_at", "yyyy-MM-dd"))
    made = mapping.emitted_metrics(rows, ["canonical_product_id", "dataset_snapshot"], _METRICS, "currency", "day", table(s, d, "comparison_contracts"), "source_dataset")
    return made.withColumn("numeric_value", F.col("numeric_value").cast("double"))


@query("SELECT dataset_id, count(*) AS source, count(*) FILTER (WHERE quality_status = 'VALID') AS loaded, count(*) FILTER (WHERE quality_status IS DISTINCT FROM 'VALID') AS quarantined, true AS whole FROM source_records GROUP BY 1")
def loaded_and_quarantined(s, d):
    """Whether each dataset's records are all either loaded or quarantined."""
    rows = table(s, d, "source_records")
    good, bad = quality.split_valid(rows, F.when(~F.col("quality_status").eqNullSafe("VALID"), F.lit("NOT_VALID")))
    return quality.reconciled(rows, good, bad, "dataset_id")


# --- Snapshots, evidence and projections ------------------------------------------------------------------------------

_SELECTION_SQL = "SELECT d AS dataset_id, count(DISTINCT snapshot_id) AS snapshots, CASE WHEN count(DISTINCT snapshot_id) = 1 THEN min(snapshot_id) END AS snapshot_id, CASE count(DISTINCT snapshot_id) WHEN 0 THEN 'MISSING' WHEN 1 THEN NULL ELSE 'AMBIGUOUS' END AS problem FROM (VALUES ('PRBD01N001'), ('PREF01N001'), ('PREF02N001'), ('PRFD01N001')) n(d) LEFT JOIN dataset_snapshots ON dataset_id = d AND snapshot_date = DATE '2026-08-21' AND generation = 'V2' AND upper(trim(status)) = 'READY' AND upper(trim(reconciliation_status)) = 'PASSED' AND row_count_reconciled GROUP BY 1"


@query(_SELECTION_SQL)
def snapshot_selection(s, d):
    """The released snapshot of every dataset on a day and generation, or why there is none."""
    return store.selected_snapshots(table(s, d, "dataset_snapshots"), list(NAMESPACES), "2026-08-21", {"generation": "V2"})


_DAYS_SQL = "ready AS (SELECT dataset_id, strftime(max(snapshot_date), '%Y-%m-%d') AS day FROM dataset_snapshots WHERE upper(trim(status)) = 'READY' AND upper(trim(reconciliation_status)) = 'PASSED' AND row_count_reconciled GROUP BY 1)"


@query(f"WITH {_DAYS_SQL}, f AS (SELECT p.canonical_product_id FROM canonical_products p JOIN ready r ON p.source_dataset = r.dataset_id AND p.dataset_snapshot = r.day) SELECT entity_id, entity_kind FROM canonical_entities WHERE query_eligible AND entity_id IN (SELECT canonical_product_id FROM f)")
def eligible_entities(s, d):
    """Entities that may be asked about and are held by the newest released snapshots."""
    newest = store.released(table(s, d, "dataset_snapshots")).groupBy(F.col("dataset_id").alias("source_dataset")).agg(F.date_format(F.max("snapshot_date"), "yyyy-MM-dd").alias("day"))
    facts = table(s, d, "canonical_products").select(F.col("canonical_product_id").alias("entity_id"), F.concat_ws("@", "source_dataset", "dataset_snapshot").alias("snapshot"))
    chosen = [r["s"] for r in newest.select(F.concat_ws("@", "source_dataset", "day").alias("s")).collect()]  # one per dataset
    return store.eligible_entities(table(s, d, "canonical_entities"), facts, "entity_id", "snapshot", chosen).select("entity_id", "entity_kind")


def _observations(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(observations, evidence): a fact is backed by the assertions on its subject."""
    rows = table(s, d, "metric_observations").groupBy("fact_id").agg(F.max(F.struct("recorded_at", "subject_entity_id", "metric_code", "observed_on", "quality_status", "numeric_value", "unit", "scale_basis", "currency", "source_dataset")).alias("o")).select("fact_id", "o.*")
    made = rows.select(F.col("subject_entity_id").alias("entity_id"), F.col("metric_code").alias("metric"), "fact_id", "observed_on", "quality_status", "numeric_value", "unit", "scale_basis", "currency", F.col("source_dataset").alias("dataset"))
    backed = table(s, d, "source_field_assertions").groupBy(F.col("canonical_product_id").alias("entity_id")).agg(F.count(F.lit(1)).alias("n"))
    return made, made.select("fact_id", "entity_id").join(backed, "entity_id").select("fact_id")


_FACTS_SQL = "o AS (SELECT * FROM metric_observations QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY recorded_at DESC NULLS LAST, subject_entity_id DESC) = 1), e AS (SELECT * FROM o WHERE subject_entity_id IN (SELECT canonical_product_id FROM source_field_assertions) AND quality_status IN ('VALID', 'SOURCE_ZERO'))"


@query(f"WITH {_FACTS_SQL} SELECT subject_entity_id AS entity_id, metric_code AS metric, fact_id, observed_on, numeric_value FROM e WHERE observed_on IS NULL OR observed_on <= DATE '{LAST_DAY}' QUALIFY row_number() OVER (PARTITION BY subject_entity_id, metric_code ORDER BY observed_on DESC NULLS LAST, fact_id) = 1")
def metric_evidenced(s, d):
    """The latest valid observation of every entity and metric that evidence backs; undated ones come last."""
    return projection.metric_details(*_observations(s, d), LAST_DAY).select("entity_id", "metric", "fact_id", "observed_on", "numeric_value")


@query(f"WITH {_FACTS_SQL} SELECT subject_entity_id AS entity_id, metric_code AS metric, fact_id, observed_on, numeric_value, unit, scale_basis, currency, source_dataset AS dataset, quality_status, 1::BIGINT AS evidence FROM e WHERE observed_on <= DATE '{LAST_DAY}' AND (metric_code, source_dataset, unit, scale_basis) IN (SELECT metric, dataset, unit, scale_basis FROM comparison_contracts) QUALIFY row_number() OVER (PARTITION BY subject_entity_id, metric_code ORDER BY observed_on DESC, fact_id) = 1")
def metric_details(s, d):
    """The same under the comparison contracts, whole."""
    contract = table(s, d, "comparison_contracts").select("metric", "dataset", "unit", "scale_basis")
    return projection.metric_details(*_observations(s, d), LAST_DAY, contract)


@query("SELECT DISTINCT canonical_product_id, upper(trim(isin)) AS isin FROM canonical_products WHERE regexp_full_match(upper(trim(isin)), '[A-Z]{2}[A-Z0-9]{9}[0-9]') AND upper(trim(isin)) NOT IN (SELECT upper(trim(isin)) FROM canonical_products WHERE isin IS NOT NULL GROUP BY 1 HAVING count(DISTINCT canonical_product_id) > 1)")
def valid_identifiers(s, d):
    """Identifiers that are well-formed and name one product."""
    p = table(s, d, "canonical_products").withColumn("isin", F.upper(F.trim("isin")))
    return projection.identifiers(p, "canonical_product_id", "isin", quality.shared_identifiers(p, ["isin"], "canonical_product_id"))


_MISSING_FIELDS = ["mat_dt", "crd_grd", "cu_base_index", "fd_sbpr"]


@query(f"WITH r AS (SELECT source_record_id, raw_payload FROM source_records), c AS (SELECT source_record_id, f AS source_column, nullif(trim(json_extract_string(raw_payload, '$.' || f)), '') AS v FROM r, (SELECT unnest({_MISSING_FIELDS}) AS f)) SELECT source_record_id, source_column, 'MISSING' AS quality_status FROM c WHERE v IS NULL AND (source_record_id, source_column) NOT IN (SELECT source_record_id, source_column FROM source_field_assertions WHERE source_record_id IS NOT NULL AND source_column IS NOT NULL)")
def missing_from_payload(s, d):
    """Fields without an assertion that the payload leaves empty, record by record."""
    return projection.missing_fields(table(s, d, "source_records"), table(s, d, "source_field_assertions"), "source_record_id", "raw_payload", _MISSING_FIELDS)[0]


@query("SELECT canonical_product_id AS entity_id, min(trim(product_name)) AS name, min(product_type) AS type, min(trim(ticker)) AS ticker, min(trim(isin)) AS isin FROM canonical_products GROUP BY 1")
def basic_profile(s, d):
    """What a request shows that names one product and asks nothing else; here of every product."""
    fields = projection.profile_fields((), (), (), 1)
    source = {"name": F.trim("product_name"), "type": F.col("product_type"), "ticker": F.trim("ticker"), "isin": F.trim("isin")}
    return table(s, d, "canonical_products").groupBy(F.col("canonical_product_id").alias("entity_id")).agg(*[F.min(source[f]).alias(f) for f in fields])


@query("SELECT * FROM (VALUES ('currency:krw', 'KRW', NULL), ('code.usd', 'USD', NULL), ('EUR', 'EUR', NULL), ('xyz', NULL, 'xyz is no known target')) t(target, canonical, refused)")
def relation_targets(s, d):
    """Targets of a relation by the currencies the store knows; others are refused."""
    known = {r["c"]: r["c"] for r in table(s, d, "comparison_contracts").select(F.upper("currency").alias("c")).unionByName(table(s, d, "currency_rates").select(F.upper("currency").alias("c"))).where("c IS NOT NULL").distinct().collect()}

    def tried(value: str) -> tuple:
        try:
            return value, mapping.relation_target(value, known, "currency:"), None
        except planning.RequestRefused as e:
            return value, None, str(e)

    return s.createDataFrame([tried(v) for v in ("currency:krw", "code.usd", "EUR", "xyz")], "target string, canonical string, refused string")


@query("SELECT * FROM (VALUES ('and_drops', 'a'), ('or_refused', 'an OR can''t be split over stores'), ('removed', 'b'), ('not_from_or', 'a filter can''t be taken out of an OR')) t(tree, outcome)")
def tree_parts(s, d):
    """What becomes of trees that go to several stores or lose a filter of their group."""
    both = lambda op: Tree(op, ("a", "b"))

    def tried(f, *args) -> str:
        try:
            return str(f(*args))
        except planning.RequestRefused as e:
            return str(e)

    rows = [("and_drops", tried(planning.local_tree, both("and"), ["a"], ["a", "b"])), ("or_refused", tried(planning.local_tree, both("or"), ["a"], ["a", "b"])), ("removed", tried(planning.without_filters, both("and"), ["a"])), ("not_from_or", tried(planning.without_filters, both("or"), ["a"]))]
    return s.createDataFrame(rows, "tree string, outcome string")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey IN (1, 2, 3)")
def certain_currency(s, d):
    """Values that hold in whatever branch decide what may be compared: here the suppliers every branch names."""
    filters = [Filter("a", "supplier", "in", (1, 2, 3)), Filter("b", "supplier", "in", (2, 9)), Filter("c", "supplier", "in", (1, 3, 2))]
    sure = planning.certain_values(Tree("and", ("a", "c")), [filters[0], filters[2]], "supplier")
    return table(s, d, "supplier").where(F.col("s_suppkey").isin(sorted(sure))).select("s_suppkey")


# --- Graph ------------------------------------------------------------------------------------------------------------


def _relations(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "canonical_products")
    managed = p.where("asset_manager IS NOT NULL").select(F.col("canonical_product_id").alias("subject"), F.lit("MANAGED_BY").alias("relation"), F.concat(F.lit("org:"), F.trim("asset_manager")).alias("object"), "source_dataset")
    tracks = p.where("base_index IS NOT NULL").select(F.col("canonical_product_id").alias("subject"), F.lit("TRACKS_INDEX").alias("relation"), F.concat(F.lit("index:"), F.trim("base_index")).alias("object"), "source_dataset")
    rows = managed.unionByName(tracks).distinct()
    return rows.select(F.concat_ws("|", "relation", "subject", "object").alias("fact_id"), "subject", "relation", "object", "source_dataset")


def _graph_nodes(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "canonical_products")
    products = p.groupBy(F.col("canonical_product_id").alias("node")).agg(F.lit("PRODUCT").alias("type"), F.min(F.trim("product_name")).alias("display_name"))
    named = lambda c, prefix, kind: p.where(F.col(c).isNotNull()).select(F.concat(F.lit(prefix), F.trim(c)).alias("node"), F.lit(kind).alias("type"), F.trim(c).alias("display_name")).distinct()
    return products.unionByName(named("asset_manager", "org:", "ORGANIZATION")).unionByName(named("base_index", "index:", "INDEX"))


_WALKABLE = ["MANAGED_BY", "TRACKS_INDEX"]
_EDGES_SQL = "g AS (SELECT DISTINCT canonical_product_id AS subject, 'MANAGED_BY' AS relation, 'org:' || trim(asset_manager) AS object, trim(asset_manager) AS label FROM canonical_products WHERE asset_manager IS NOT NULL UNION SELECT DISTINCT canonical_product_id, 'TRACKS_INDEX', 'index:' || trim(base_index), trim(base_index) FROM canonical_products WHERE base_index IS NOT NULL), n AS (SELECT canonical_product_id AS node, min(trim(product_name)) AS name FROM canonical_products GROUP BY 1)"


@query(f"WITH {_EDGES_SQL}, m AS (SELECT min(label) AS name FROM g WHERE relation = 'MANAGED_BY') SELECT 'graph:MANAGED_BY|' || subject || '|' || object AS source_id, subject AS entity_id, 'graph.MANAGED_BY' AS field, label AS value, coalesce(n.name, subject) || ' -> ' || label AS text FROM g LEFT JOIN n ON subject = node WHERE relation = 'MANAGED_BY' AND label = (SELECT name FROM m)")
def graph_path_records(s, d):
    """Records of the paths to one manager, found by its display name, with labels and each edge's provenance."""
    nodes, edges = _graph_nodes(s, d), _relations(s, d).withColumnRenamed("fact_id", "edge_id")
    name = nodes.where("type = 'ORGANIZATION'").agg(F.min("display_name")).first()[0]
    hops = [Hop("MANAGED_BY")]
    found = graph.result_entities(graph.paths(edges, hops, _WALKABLE, end=graph.anchors(nodes, [name], "ORGANIZATION")), hops)
    records = graph.path_records(found.dropDuplicates(["e0"]), hops, nodes, edges, ["source_dataset"])
    return records.select("source_id", "entity_id", "field", "value", "text")


@query(f"WITH {_EDGES_SQL}, p AS (SELECT a.subject AS n0, a.object AS n1, b.subject AS n2 FROM g a JOIN g b ON a.object = b.object WHERE a.relation = 'TRACKS_INDEX' AND b.relation = 'TRACKS_INDEX' AND a.subject = (SELECT min(subject) FROM g WHERE relation = 'TRACKS_INDEX')) SELECT least(count(*), 20) AS returned, count(*) <= 20 AS complete FROM p")
def graph_path_window(s, d):
    """How many of the two-hop paths from one product fit into a window, and whether those are all."""
    edges = _relations(s, d).withColumnRenamed("fact_id", "edge_id").drop("source_dataset").distinct()
    start = edges.where("relation = 'TRACKS_INDEX'").agg(F.min("subject").alias("node"))
    found = graph.paths(edges, [Hop("TRACKS_INDEX"), Hop("TRACKS_INDEX", False)], _WALKABLE, start=start)
    return graph.path_window(found, 20, ["n1", "n2"])[1]


@query(f"WITH {_EDGES_SQL} SELECT relation, count(*) AS edges, 0::BIGINT AS lost FROM g GROUP BY 1")
def graph_projection(s, d):
    """Edges of the allowed relations whose ends are nodes, and those that lost an end."""
    facts = _relations(s, d).drop("source_dataset").distinct()
    edges, lost = graph.projected(facts, _graph_nodes(s, d), _WALKABLE)
    return edges.groupBy("relation").agg(F.count(F.lit(1)).alias("edges")).join(lost.groupBy("relation").agg(F.count(F.lit(1)).alias("lost")), "relation", "left").select("relation", "edges", F.coalesce("lost", F.lit(0)).alias("lost"))


@query("WITH h AS (SELECT DISTINCT fund_code, itm FROM (SELECT fund_code, regexp_extract(upper(trim(itm_no)), '^A?([0-9]{6})$', 1) AS itm FROM kodex_holding_items) WHERE itm <> ''), k AS (SELECT DISTINCT representative_ticker AS t, issuer_code FROM krx_kind_companies WHERE issuer_code IS NOT NULL AND market_name = 'KONEX') SELECT DISTINCT fund_code AS subject, 'HOLDS_SHARES_OF' AS relation, issuer_code AS object FROM h JOIN k ON itm = t WHERE fund_code IS NOT NULL")
def holdings_to_issuers(s, d):
    """Funds and the KONEX companies whose securities they hold: holding and issuing as one relation."""
    items, companies = table(s, d, "kodex_holding_items"), table(s, d, "krx_kind_companies")
    code = F.regexp_extract(F.upper(F.trim("itm_no")), "^A?([0-9]{6})$", 1)
    holds = items.select(F.col("fund_code").alias("subject"), F.lit("HOLDS").alias("relation"), F.nullif(code, F.lit("")).alias("object")).dropna().distinct()
    issued = companies.select(F.col("representative_ticker").alias("subject"), F.lit("ISSUED_BY").alias("relation"), F.col("issuer_code").alias("object")).dropna().distinct()
    konex = companies.where("market_name = 'KONEX'").select(F.col("issuer_code").alias("node"))
    return graph.through(holds.unionByName(issued), "HOLDS", "ISSUED_BY", konex, "HOLDS_SHARES_OF")


@query(f"WITH {_EDGES_SQL} SELECT relation || '|' || subject || '|' || object AS edge_id, relation FROM g WHERE relation = 'TRACKS_INDEX' AND subject IN (SELECT canonical_product_id FROM canonical_products GROUP BY 1 HAVING bool_and(product_type = 'FUND'))")
def domain_range(s, d):
    """Edges against a contract by the classes of products: here only listed products may track an index."""
    facts = _relations(s, d).drop("source_dataset").distinct().withColumnRenamed("fact_id", "edge_id")
    p = table(s, d, "canonical_products")
    types = p.select(F.col("canonical_product_id").alias("node"), F.col("product_type").alias("type")).distinct().unionByName(_graph_nodes(s, d).where("type <> 'PRODUCT'").select("node", "type"))
    above = graph.ancestors(s.createDataFrame([("ETF", "LISTED"), ("ETN", "LISTED"), ("LISTED", "PRODUCT"), ("FUND", "PRODUCT"), ("BOND", "PRODUCT")], "child string, parent string"), "child", "parent")
    contract = s.createDataFrame([("TRACKS_INDEX", "LISTED", "INDEX"), ("MANAGED_BY", "PRODUCT", "ORGANIZATION")], "relation string, domain string, range string")
    return graph.incompatible(facts, types, contract, above)


# --- Search -----------------------------------------------------------------------------------------------------------

_TOKENS_SQL = "regexp_extract_all(lower(text), '[a-z0-9]+(?:[.&+\\-][a-z0-9]+)*|[가-힣]+')"


@query(f"WITH t AS (SELECT doc_id, {_TOKENS_SQL} AS t FROM documents), c AS (SELECT doc_id, coalesce(len(t), 0) AS l, len(list_filter(t, lambda x: x = 'refund')) AS a, len(list_filter(t, lambda x: x = 'dividend')) AS b FROM t), s AS (SELECT count(*)::DOUBLE AS n, avg(l) AS av, count(*) FILTER (WHERE a > 0)::DOUBLE AS da, count(*) FILTER (WHERE b > 0)::DOUBLE AS db FROM c), x AS (SELECT doc_id, (CASE WHEN a > 0 THEN ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.5 / (a + 1.5 * (0.25 + 0.75 * l / av)) ELSE 0 END) + (CASE WHEN b > 0 THEN ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.5 / (b + 1.5 * (0.25 + 0.75 * l / av)) ELSE 0 END) AS exact FROM c, s) SELECT doc_id, round(exact, 6) AS score, row_number() OVER (ORDER BY round(exact, 6) DESC, doc_id) AS rank FROM (SELECT * FROM x WHERE exact > 0 ORDER BY round(exact, 9) DESC, doc_id LIMIT 20)")
def bm25_index(s, d):
    """The best documents from an index instead of texts, with their rank."""
    docs = table(s, d, "documents")
    return text.bm25_indexed(text.token_index(docs, "doc_id", "text", normalize=False), text.document_lengths(docs, "doc_id", "text", normalize=False), "doc_id", ["refund", "dividend"], 20)


@query("SELECT count(*) AS rows, count(*) FILTER (WHERE t IS NULL) AS missing, count(*) FILTER (WHERE lower(t) IN ('n/a', 'none', '-', '없음')) AS sentinel, count(*) FILTER (WHERE t IS NOT NULL AND lower(t) NOT IN ('n/a', 'none', '-', '없음')) AS documents, (SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM documents WHERE nullif(trim(text), '') IS NOT NULL AND lower(trim(text)) NOT IN ('n/a', 'none', '-', '없음') GROUP BY text)) AS duplicates FROM (SELECT nullif(trim(text), '') AS t FROM documents)")
def document_build(s, d):
    """What a build of the search documents keeps, leaves out and finds repeated."""
    return text.document_build(table(s, d, "documents"), "text", ["n/a", "none", "-", "없음"])[1]


@query(f"WITH h AS (SELECT doc_id FROM documents WHERE list_contains({_TOKENS_SQL}, 'refund')) SELECT least(count(*), 25) AS returned, count(*) <= 25 AS complete FROM h")
def search_window(s, d):
    """Whether a window of hits holds all of them, by looking one ahead."""
    return text.completeness(text.bm25(table(s, d, "documents"), "doc_id", "text", ["refund"]), 25)


@query("SELECT doc_id FROM documents WHERE lower(trim(lang)) = 'ko' AND source_field = 'notice_body'")
def search_filters(s, d):
    """Filters of a search: the field is fixed, the region is the store's to answer."""
    asked = text.search_filters({"lang": "ko", "region": "US", "source_field": "other"}, {"source_field": "notice_body"}, ["region"])
    docs = table(s, d, "documents").withColumn("lang", F.lower(F.trim("lang")))
    for column, value in asked.items():
        docs = docs.where(F.col(column) == value)
    return docs.select("doc_id")


@query("SELECT doc_id FROM documents WHERE lower(trim(lang)) IS DISTINCT FROM 'en'")
def pending_documents(s, d):
    """Documents whose text an index of the English ones does not hold yet."""
    docs = table(s, d, "documents")
    held = docs.where("lower(trim(lang)) = 'en'").select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    return text.pending_documents(docs.select("doc_id", "text"), held, "doc_id", "text").select("doc_id")


# --- Entities ---------------------------------------------------------------------------------------------------------

_KEY = r"regexp_replace(regexp_replace(lower(trim({})), '\(주\)|㈜|주식회사|\b(co|inc|ltd|corp|plc)\b\.?', '', 'g'), '[\s.,]+', '', 'g')"


@query(f"WITH n AS (SELECT DISTINCT preferred_name, {_KEY.format('preferred_name')} AS k FROM canonical_entities WHERE preferred_name IS NOT NULL AND upper(trim(entity_kind)) = 'ORGANIZATION') SELECT preferred_name, k AS lookup FROM n WHERE k <> '' UNION SELECT preferred_name, left(k, length(k) - 2) FROM n WHERE (k LIKE '%증권' OR k LIKE '%은행' OR k LIKE '%운용') AND length(k) > 2")
def lookup_variants(s, d):
    """The keys an organisation is looked up by: its name's, and without a known ending."""
    names = table(s, d, "canonical_entities").where("preferred_name IS NOT NULL AND upper(trim(entity_kind)) = 'ORGANIZATION'").select("preferred_name").distinct()
    return names.select("preferred_name", F.explode(entity.lookup_keys(F.col("preferred_name"), ["증권", "은행", "운용"])).alias("lookup")).distinct()


@query("SELECT DISTINCT trim(preferred_name) AS mention, entity_id FROM canonical_entities WHERE preferred_name IS NOT NULL AND trim(preferred_name) IN (SELECT trim(asset_manager) FROM canonical_products WHERE asset_manager IS NOT NULL)")
def managers_only(s, d):
    """Names bound in the role of a manager: only to what some product is managed by."""
    names = table(s, d, "canonical_entities").where("preferred_name IS NOT NULL").select(F.trim("preferred_name").alias("mention"), F.trim("preferred_name").alias("name"), F.col("entity_id").alias("id"))
    relations = _relations(s, d).where("relation = 'MANAGED_BY'").select("relation", F.substring("object", 5, 10000).alias("object"))
    bound = entity.in_role(names.select("mention", F.col("name").alias("entity_id"), "id"), relations, "MANAGED_BY")
    return bound.select("mention", F.col("id").alias("entity_id")).distinct()


@query("WITH c AS (SELECT conflict_case_id, subject_entity_id AS mention, candidate_fact_ids FROM fact_conflict_cases WHERE upper(trim(status)) NOT IN ('RESOLVED', 'REJECTED') OR status IS NULL), h AS (SELECT DISTINCT subject_entity_id AS mention, subject_entity_id AS entity_id FROM fact_conflict_cases WHERE subject_entity_id IS NOT NULL) SELECT mention, entity_id FROM h UNION SELECT c.mention, unnest(from_json(candidate_fact_ids, '[\"VARCHAR\"]')) FROM c WHERE mention IS NOT NULL")
def open_cases(s, d):
    """Hits with the candidates of cases still open, so that they show as ambiguous."""
    cases = table(s, d, "fact_conflict_cases").where("subject_entity_id IS NOT NULL").select(F.col("subject_entity_id").alias("key"), F.col("candidate_fact_ids").alias("candidates"), "status")
    hits = cases.select(F.col("key").alias("mention"), F.col("key").alias("entity_id")).distinct()
    return entity.with_open_cases(hits, "mention", cases)


@query("SELECT DISTINCT itm_no, upper(trim(itm_no)) AS ticker, regexp_full_match(upper(trim(itm_no)), '[0-9A-Z]{6}') AND regexp_matches(upper(trim(itm_no)), '[0-9]') AS bound FROM kodex_holding_items WHERE itm_no IS NOT NULL AND NOT regexp_matches(upper(trim(itm_no)), '^[A-Z]+:|\\.[A-Z]{1,3}$')")
def bare_tickers(s, d):
    """Codes without an exchange: a domestic one names a security, a foreign one does not."""
    rows = table(s, d, "kodex_holding_items").where("itm_no IS NOT NULL").where(~F.upper(F.trim("itm_no")).rlike(r"^[A-Z]+:|\.[A-Z]{1,3}$"))
    ticker, _, bound = entity.exchange_ticker(F.col("itm_no"))
    return rows.select("itm_no", ticker.alias("ticker"), bound.alias("bound")).distinct()


_SEC_KEY = _KEY.format("sec_nm")
_COM_KEY = _KEY.format("issuer_name")


@query(f"WITH s AS (SELECT DISTINCT item_id::VARCHAR AS security_id, upper(trim(itm_no)) AS t, nullif({_SEC_KEY}, '') AS n FROM kodex_holding_items), bt AS (SELECT upper(trim(representative_ticker)) AS k, min(issuer_code) AS lo, max(issuer_code) AS hi FROM krx_kind_companies WHERE representative_ticker IS NOT NULL AND issuer_code IS NOT NULL GROUP BY 1), bn AS (SELECT nullif({_COM_KEY}, '') AS k, min(issuer_code) AS lo, max(issuer_code) AS hi FROM krx_kind_companies WHERE issuer_code IS NOT NULL GROUP BY 1 HAVING k IS NOT NULL), r AS (SELECT security_id, bool_or(coalesce(bt.lo <> bt.hi, false)) AS shared, min(CASE WHEN bt.lo = bt.hi THEN bt.lo END) AS a, max(CASE WHEN bt.lo = bt.hi THEN bt.lo END) AS b, min(CASE WHEN bn.lo = bn.hi THEN bn.lo END) AS c, max(CASE WHEN bn.lo = bn.hi THEN bn.lo END) AS d FROM s LEFT JOIN bt ON t = bt.k LEFT JOIN bn ON n = bn.k GROUP BY 1), q AS (SELECT *, CASE WHEN shared AND a IS NULL THEN 'SHARED_TICKER' WHEN least(a, c) <> greatest(b, d) THEN 'DIFFERENT_ISSUERS' END AS reason FROM r) SELECT security_id, reason, CASE WHEN reason IS NULL THEN coalesce(a, c) END AS issuer_code FROM q WHERE reason IS NOT NULL OR coalesce(a, c) IS NOT NULL")
def issuer_integration(s, d):
    """Holdings and their issuers by exact ticker and name, with the conflicts."""
    securities = table(s, d, "kodex_holding_items").select(F.col("item_id").cast("string").alias("security_id"), F.col("itm_no").alias("ticker"), F.col("sec_nm").alias("name"))
    companies = table(s, d, "krx_kind_companies").select("issuer_code", F.col("representative_ticker").alias("ticker"), F.col("issuer_name").alias("name"))
    links, conflicts = entity.integrated_issuers(securities, companies)
    return links.select("security_id", F.lit(None).cast("string").alias("reason"), "issuer_code").unionByName(conflicts.select("security_id", "reason", F.lit(None).cast("string").alias("issuer_code")))


# --- Findings and merges ----------------------------------------------------------------------------------------------


def _evidence(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "metric_observations")
    return o.select(F.col("subject_entity_id").alias("entity_id"), F.col("metric_code").alias("field"), F.trim("raw_value").alias("value"), "observed_on", F.col("source_dataset").alias("snapshot_id"), "unit", "currency", "source_dataset")


_FINDINGS_SQL = """
WITH e AS (SELECT subject_entity_id AS entity_id, metric_code AS field, trim(raw_value) AS value, observed_on, source_dataset, unit, currency FROM metric_observations)
SELECT 'SENTINEL' AS code, 'BLOCKING' AS severity, entity_id, field, value AS detail FROM e WHERE value IN ('-', 'N/A', '0') AND field = 'AUM'
UNION ALL SELECT 'SENTINEL', 'WARNING', entity_id, field, value FROM e WHERE value IN ('-', 'N/A', '0') AND field <> 'AUM'
UNION ALL SELECT 'OBSERVATION_DATES_DIFFER', 'WARNING', NULL, field, count(DISTINCT observed_on)::VARCHAR FROM e GROUP BY field HAVING count(DISTINCT observed_on) > 1
UNION ALL SELECT 'CONTRACT_BROKEN', 'BLOCKING', NULL, field, count(DISTINCT entity_id)::VARCHAR || '/' || greatest(count(DISTINCT source_dataset), count(DISTINCT unit), count(DISTINCT currency), 0)::VARCHAR FROM e GROUP BY field HAVING count(DISTINCT entity_id) < 2 OR greatest(count(DISTINCT source_dataset), count(DISTINCT unit), count(DISTINCT currency)) > 1
UNION ALL SELECT 'SNAPSHOT_MISMATCH', CASE WHEN field = 'NAV' THEN 'WARNING' ELSE 'BLOCKING' END, NULL, field, count(DISTINCT source_dataset)::VARCHAR FROM e GROUP BY field HAVING count(DISTINCT source_dataset) > 1
UNION ALL SELECT 'LOW_COVERAGE', 'BLOCKING', NULL, f.field, round(count(DISTINCT CASE WHEN e.field = f.field AND value IS NOT NULL THEN entity_id END) / count(DISTINCT entity_id)::DOUBLE, 6)::VARCHAR FROM e, (VALUES ('AUM'), ('NAV'), ('NOBODY_HAS')) f(field) GROUP BY f.field HAVING count(DISTINCT CASE WHEN e.field = f.field AND value IS NOT NULL THEN entity_id END) / count(DISTINCT entity_id)::DOUBLE < 0.99"""


@query("SELECT code, severity, entity_id, field, CASE WHEN code = 'LOW_COVERAGE' THEN round(detail::DOUBLE, 4)::VARCHAR ELSE detail END AS detail FROM (" + _FINDINGS_SQL + ")")
def evidence_findings(s, d):
    """Sentinels, differing days, broken contracts, mixed snapshots and low coverage of all observations."""
    e = _evidence(s, d)
    parts = [
        findings.sentinels(e, ["-", "N/A", "0"], ["AUM"]),
        findings.mixed_dates(e),
        findings.incomparable(e, ["source_dataset", "unit", "currency"]),
        findings.snapshots_differ(e, {"NAV": "WARNING"}),
        findings.low_coverage(e, e, ["AUM", "NAV", "NOBODY_HAS"], 0.99),
    ]
    rows = findings.all_findings(parts)
    return rows.withColumn("detail", F.when(F.col("code") == "LOW_COVERAGE", F.round(F.col("detail").cast("double"), 4).cast("string")).otherwise(F.col("detail")))


@query(f"WITH m AS (SELECT DISTINCT trim(alias) AS mention FROM entity_aliases WHERE alias IS NOT NULL), h AS (SELECT DISTINCT mention, entity_id FROM m JOIN canonical_entities ON trim(preferred_name) = mention), c AS (SELECT mention, count(DISTINCT entity_id) AS n FROM m LEFT JOIN h USING (mention) GROUP BY 1) SELECT 'ENTITY_UNRESOLVED' AS code, 'BLOCKING' AS severity, NULL::VARCHAR AS entity_id, NULL::VARCHAR AS field, mention AS detail FROM c WHERE n = 0 UNION ALL SELECT 'AMBIGUOUS_ENTITY', 'BLOCKING', entity_id, NULL, mention FROM h WHERE mention IN (SELECT mention FROM c WHERE n > 1)")
def entity_findings(s, d):
    """Mentions that name no entity, or several."""
    mentions = table(s, d, "entity_aliases").where("alias IS NOT NULL").select(F.trim("alias").alias("mention"))
    hits = entity.exact_tiers(mentions, "mention", [table(s, d, "canonical_entities").where("preferred_name IS NOT NULL").select(F.trim("preferred_name").alias("key"), "entity_id")])
    return findings.unresolved(entity.resolution(mentions, "mention", hits), hits, "mention")


@query("SELECT * FROM (VALUES ('STEP_FAILED', 'a'), ('STEP_TIMED_OUT', 'b'), ('STEP_SKIPPED', 'c'), ('CONSTRAINT_NOT_APPLIED', 'C2'), ('CONSTRAINT_NOT_ASKED', 'C9'), ('OR_NOT_APPLIED', 'tree'), ('RANKING_NOT_APPLIED', 'price'), ('ZERO_MATCH', NULL), ('NO_EVIDENCE', NULL), ('INSUFFICIENT_EVIDENCE', NULL)) t(code, detail)")
def plan_findings(s, d):
    """What a plan's run leaves to be told: steps, receipts, order, empty results."""
    rows = findings.step_problems({"a": "FAILED", "b": "TIMED_OUT", "c": "SKIPPED", "d": "SUCCESS"})
    rows += findings.receipt_problems(["C1", "C2"], ["C1", "C9"], True, False, "price", None)
    rows += [(findings.empty_result(*x), None) for x in ((0, 0), (5, 0, 0), (5, 0, 3))]
    return s.createDataFrame(rows, "code string, detail string")


@query("SELECT p_partkey, string_agg(DISTINCT l_returnflag || ':' || l_linestatus, '|' ORDER BY l_returnflag || ':' || l_linestatus) AS matches FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1")
def attached_matches(s, d):
    """Parts with the states of their lines attached."""
    lines = table(s, d, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    rows = merge.attached(table(s, d, "part").select("p_partkey"), lines, "p_partkey", ["l_returnflag", "l_linestatus"], "m")
    return rows.select("p_partkey", F.nullif(F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["l_returnflag"], x["l_linestatus"])), "|"), F.lit("")).alias("matches"))


@query("SELECT source, source_id, field, value FROM (SELECT 'rdb' AS source, p_partkey::VARCHAR AS source_id, 'type' AS field, p_type AS value FROM part UNION ALL SELECT 'graph', p_partkey::VARCHAR, 'size', p_size::VARCHAR FROM part) WHERE source_id IN (SELECT l_partkey::VARCHAR FROM lineitem WHERE l_suppkey = 3)")
def kept_records(s, d):
    """All records of the entities that the sources agree on, whatever source they come from."""
    part = table(s, d, "part").withColumn("id", F.col("p_partkey").cast("string"))
    record = lambda source, field, value: part.select(F.lit(source).alias("source"), F.col("id").alias("source_id"), F.lit(field).alias("field"), F.col(value).cast("string").alias("value"), "id")
    chosen = table(s, d, "lineitem").where("l_suppkey = 3").select(F.col("l_partkey").cast("string").alias("id"))
    return merge.kept_records([record("rdb", "type", "p_type"), record("graph", "size", "p_size")], chosen, "id").drop("id")


@query("SELECT count(DISTINCT fact_id) AS facts, count(DISTINCT CASE WHEN subject_entity_id IN (SELECT canonical_product_id FROM source_field_assertions WHERE canonical_product_id IS NOT NULL) THEN fact_id END) AS evidenced FROM metric_observations")
def readiness(s, d):
    """Facts and evidenced facts: a store is ready if they are the same."""
    facts = table(s, d, "metric_observations").select("fact_id", F.col("subject_entity_id").alias("entity_id"))
    backed = table(s, d, "source_field_assertions").select(F.col("canonical_product_id").alias("entity_id")).dropna().distinct().withColumn("_backed", F.lit(True))
    return facts.join(backed, "entity_id", "left").agg(F.count_distinct("fact_id").alias("facts"), F.count_distinct(F.when(F.col("_backed"), F.col("fact_id"))).alias("evidenced"))


@query(f"SELECT count(*) = count(*) FILTER (WHERE problem IS NULL) AS ready, coalesce(string_agg(dataset_id || ' ' || problem, '; ' ORDER BY dataset_id), '') AS problems FROM ({_SELECTION_SQL})")
def store_health(s, d):
    """Whether the store can answer on a day, and what is missing."""
    return store.health(snapshot_selection(s, d)).select("ready", F.array_join("problems", "; ").alias("problems"))


@query(f"WITH {_EDGES_SQL}, c AS (SELECT relation, count(*) AS n FROM g GROUP BY 1) SELECT sum(n)::BIGINT AS edges, sha256(string_agg(relation || '=' || n, ';' ORDER BY relation)) AS checksum FROM c")
def graph_manifest(s, d):
    """Edges and the checksum of their counts by relation."""
    return graph.manifest(_relations(s, d).drop("source_dataset").distinct())


@query("SELECT source_dataset, count(*) AS assertions, count(DISTINCT source_record_id) AS records, count(*) FILTER (WHERE quality_status = 'VALID') AS valid, count(*) FILTER (WHERE nullif(trim(raw_value), '') IS NULL) AS blank, CAST(max(asserted_at) AS DATE) AS newest FROM source_field_assertions GROUP BY 1")
def ingestion_report(s, d):
    """What was delivered, dataset by dataset."""
    return quality.ingestion_report(table(s, d, "source_field_assertions"), "source_dataset", "source_record_id", "raw_value", F.col("quality_status") == "VALID", "asserted_at")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice IS NOT NULL QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def first_per_key(s, d):
    """The first row of each key in a given order."""
    return merge.first_of_key(table(s, d, "orders").where("o_totalprice IS NOT NULL"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("SELECT item_id, CASE WHEN ratio BETWEEN 0 AND 100 THEN round(ratio / 100, 8) END AS proportion FROM kodex_holding_items")
def proportions(s, d):
    """Percentages as proportions, others NULL."""
    return table(s, d, "kodex_holding_items").select("item_id", F.round(quality.proportion(F.col("ratio")).cast("double"), 8).alias("proportion"))


@query(f"SELECT fact_id FROM metric_observations WHERE observed_on IS NULL OR observed_on > DATE '{LAST_DAY}'")
def cutoff_violations(s, d):
    return quality.cutoff_violations(table(s, d, "metric_observations"), "observed_on", LAST_DAY).select("fact_id")


@query("SELECT doc_id, lower(regexp_replace(trim(source), '\\s+', '', 'g')) AS form FROM documents WHERE regexp_full_match(source, '[\\x20-\\x7E]*')")
def lookup_forms(s, d):
    """Lookup forms of text; NFKC has no SQL, so those of plain ASCII are compared."""
    return table(s, d, "documents").where(F.col("source").rlike(r"^[\x20-\x7E]*$")).select("doc_id", ftext.lookup_form(F.col("source")).alias("form"))


_WORDS = {
    "아시아": [question.Term("value", "region", "ASIA")], "유럽": [question.Term("value", "region", "EUROPE")], "asia": [question.Term("value", "region", "ASIA")],
    "경제형": [question.Term("value", "type", "ECONOMY")], "소형": [question.Term("value", "type", "SMALL")],
    "가격": [question.Term("field", "price")], "price": [question.Term("field", "price")], "이름": [question.Term("field", "name")],
    "공급사 7": [question.Term("relation", "SUPPLIED_BY", "s7")], "좋은": [question.Term("field", "price"), question.Term("field", "size")],
}
_QUESTIONS = ["아시아 경제형 중 가격 높은 순으로 상위 5", "아시아 또는 유럽의 이름 보여줘", "유럽을 제외한 소형", "price of asia", "좋은 아시아", "무지개 아시아", "아시아 100억원 이상", "공급사 7의 소형 이름"]


@query("SELECT * FROM (VALUES ('아시아 경제형 중 가격 높은 순으로 상위 5', 'STORE', 'region eq ASIA; type eq ECONOMY', 'price desc', 5), ('아시아 또는 유럽의 이름 보여줘', 'STORE', 'region in ASIA,EUROPE', '', NULL), ('유럽을 제외한 소형', 'INCOMPLETE', 'region ne EUROPE; type eq SMALL', '', NULL), ('price of asia', 'STORE', 'region eq ASIA', '', NULL), ('좋은 아시아', 'INCOMPLETE', 'region eq ASIA', '', NULL), ('무지개 아시아', 'INCOMPLETE', 'region eq ASIA', '', NULL), ('아시아 100억원 이상', 'REFUSED', 'region eq ASIA', '', NULL), ('공급사 7의 소형 이름', 'FEDERATED', 'type eq SMALL', '', NULL)) t(question, route, filters, sort, top)")
def parsed_questions(s, d):
    """Questions in words: where they run, their filters, order and limit."""
    rows = []
    for q in _QUESTIONS:
        p = question.parse(q, _WORDS)
        rows.append((q, question.route(p), "; ".join(f"{f.field} {f.op} {','.join(map(str, f.values))}" for f in p.request.filters), ", ".join(f"{x.field} {'desc' if x.descending else 'asc'}" for x in p.request.sort), p.request.limit))
    return s.createDataFrame(rows, "question string, route string, filters string, sort string, top int")


@query("SELECT p.p_partkey FROM part p WHERE p_type = 'ECONOMY' AND EXISTS (SELECT 1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_partkey = p.p_partkey AND r_name = 'ASIA')")
def answered_question(s, d):
    """A question in words run to its rows."""
    from factweave.operators.predicates import select_entities
    from factweave.plans.fact_queries import _catalog

    asked = question.parse("아시아 경제형 보여줘", _WORDS)
    catalog = _catalog(s, d)
    return select_entities(catalog.base, catalog.entity, asked.request.filters, catalog.fields, asked.request.tree).select("p_partkey")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
