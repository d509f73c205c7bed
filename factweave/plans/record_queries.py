"""Queries of the training-data operators in the core (problems 1, 2, 3 and 7) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.operators import raw_records, snapshot_diff, units, wide
from factweave.session import table

#: Fixed layout for the SQL, which can't read it: what source_column_types declares today. The queries read the table.
WIDE_LAYOUT = {
    "PRBD01N001": "pd_no text, pd_nm text, pd_abrv_nm text, pd_pbcm text, isu_dt date, mat_dt date, isu_bal_amt numeric, pd_risk_gcd integer, bd_knd text, curr_cd text, pd_exg_mkt text, info_base_dt date, info_seq integer, eval_price numeric, buy_yield numeric, buyable_quantity integer, crd_grd text, crd_grd_dt date, sale_yn flag",
    "PREF01N001": "pd_itm_no text, pd_isin_cd text, pd_ticker text, pd_nm text, pd_abrv_nm text, cu_fund_mgmt_co text, cu_base_index text, wu_inv_ast_type text, wu_inv_rgn text, pd_curr_cd text, du_last_aum numeric, cu_charge_rt numeric, du_last_nav numeric, du_clpr numeric, du_upt_dt date, du_er_1m numeric, du_er_1y numeric, pd_sale_yn flag, pd_tr_yn flag, pd_lstg_dt date, ru_mkt_volume integer",
    "PREF02N001": "pd_itm_no text, pd_isin_cd text, pd_lipper_id integer, pd_nm text, pd_abrv_nm text, cu_fund_mgmt_co text, cu_base_index text, cu_index_tracking_yn flag, wu_inv_ast_type text, pd_trd_ccy text, du_last_aum numeric, cu_charge_rt numeric, du_last_nav numeric, du_clpr numeric, du_clpr_base_dt date, du_upt_dt date, pd_sale_yn flag, pd_lstg_dt date, ru_mkt_volume integer",
    "PRFD01N001": "itm_no text, itm_nm text, itm_abrv_nm text, rptt_ksd_itm_no text, or_co_xtn_itt_cd text, bmrk_nm text, or_attr_desc text, fd_ivst_rgn_desc text, zrin_fd_ivst_risk_gcd integer, curr_cd text, fd_nast_suma numeric, bns_bpr numeric, fd_sbpr numeric, fd_price_bas_dt date, fd_yr1_ern_r numeric, han_clas_nm text, sale_yn flag, thco_sale_yn flag, fd_daily_bas_dt date",
}


def layout(dataset: str) -> list[tuple[str, str]]:
    return [tuple(part.split()) for part in WIDE_LAYOUT[dataset].split(", ")]


def _checked_lines(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    lines = table(spark, d, "kodex_raw_lines").select(*keep, "raw_line")
    return raw_records.checked_records(lines, "raw_line", raw_records.holding_fields())


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are not valid."""
    return raw_records.rejected_rows(_checked_lines(spark, d, "line_id"), ["line_id"]).select("line_id")


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Rejected lines with reason and offset."""
    return raw_records.rejected_rows(_checked_lines(spark, d, "line_id", "file_name", "line_no"), ["line_id", "file_name", "line_no"])


def p1_holdings(spark: SparkSession, d: str) -> DataFrame:
    """Valid lines as typed holding rows."""
    return raw_records.typed_rows(_checked_lines(spark, d, "line_id", "file_name"), raw_records.holding_fields(), ["line_id", "file_name"])


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return wide.compacted_assertions(table(spark, d, "source_field_assertions"), table(spark, d, "source_column_types"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Cells that have values but none that suits the declared type."""
    return wide.unfit_cells(_cells(spark, d), ["source_record_id"], "source_column")


def _p2_wide(dataset: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        columns = wide.declared_columns(table(spark, d, "source_column_types"), dataset)
        return wide.wide(_cells(spark, d).where(F.col("source_dataset") == dataset), ["source_record_id"], columns)

    run.__doc__ = f"Wide typed rows of {dataset}, one per source record."
    return run


def _ready(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_diff.ready_sequence(table(spark, d, "dataset_snapshots"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Record keys added, removed or changed between consecutive READY snapshots."""
    ready = _ready(spark, d)
    c = F.col
    content = snapshot_diff.content_hash(c("raw_payload_hash"), c("raw_payload"))
    rows = snapshot_diff.snapshot_rows(table(spark, d, "source_records"), c("dataset_id"), c("dataset_snapshot"), c("source_record_key"), content, c("loaded_at"), ready)
    changes = snapshot_diff.classify_changes(snapshot_diff.unmatched_rows(rows, ready), ready)
    return changes.select(F.col("dataset").alias("dataset_id"), F.col("key").alias("source_record_key"), F.date_format("day", "yyyy-MM-dd").alias("snapshot_date"), "change_kind")


def p3_products(spark: SparkSession, d: str) -> DataFrame:
    """The same for canonical_products, whose content is all its descriptive columns."""
    ready = _ready(spark, d)
    products = table(spark, d, "canonical_products")
    describing = [c for c in products.columns if c not in ("dataset_snapshot", "source_dataset", "source_record_key", "observed_at")]
    content = F.unhex(F.sha2(F.to_json(F.struct(*[F.trim(F.col(c).cast("string")).alias(c) for c in describing])), 256))
    rows = snapshot_diff.snapshot_rows(products, F.col("source_dataset"), F.col("dataset_snapshot"), F.col("source_record_key"), content, F.col("observed_at"), ready)
    changes = snapshot_diff.classify_changes(snapshot_diff.unmatched_rows(rows, ready), ready)
    return changes.select(F.col("dataset").alias("source_dataset"), F.col("key").alias("source_record_key"), F.date_format("day", "yyyy-MM-dd").alias("snapshot_date"), "change_kind")


def _values(spark: SparkSession, d: str) -> DataFrame:
    return units.common_values(table(spark, d, "metric_observations"), table(spark, d, "comparison_contracts"), table(spark, d, "currency_rates"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of facts of one subject, metric and day whose values in the common unit disagree."""
    return units.disagreeing_pairs(_values(spark, d))


def p7_values(spark: SparkSession, d: str) -> DataFrame:
    """Every observation in the common unit of its metric."""
    return _values(spark, d).select("fact_id", "metric_code", "subject_entity_id", "observed_on", "number", "source_unit", "canonical_unit", "common_value")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_reasons": p1_reasons,
        "p1_holdings": p1_holdings,
        "p2_found": p2_found,
        **{f"p2_wide_{name.lower()}": _p2_wide(name) for name in WIDE_LAYOUT},
        "p3_found": p3_found,
        "p3_products": p3_products,
        "p7_found": p7_found,
        "p7_values": p7_values,
    }


# --- SQL ------------------------------------------------------------------------------------------------------------

_FIELD = r'[ \t]*(?:"(?:[^"]|"")*"[ \t]*|[^",\n\r]*)'
_LINE = "^" + ",".join([f"({_FIELD})"] * 11) + r"[\s]*$"
_NAMES = ["gijunYMD", "fId", "totalCnt", "secNm", "itmNo", "applyQ", "curp", "risep", "evalA", "ratio", "pdfType"]


def _p1_sql(select: str, where: str) -> str:
    value = lambda n: f"""(CASE WHEN trim(f.{n}, E' \\t\\n\\r') LIKE '"%' THEN replace(substr(trim(f.{n}, E' \\t\\n\\r'), 2, length(trim(f.{n}, E' \\t\\n\\r')) - 2), '""', '"') ELSE f.{n} END)"""
    fields = ", ".join(f"trim({value(n)}, E' \\t\\n\\r') AS {n}" for n in _NAMES)
    names = ", ".join(f"'{n}'" for n in _NAMES)
    return f"""
WITH parts AS (SELECT line_id, file_name, line_no, raw_line, coalesce(regexp_full_match(raw_line, '{_LINE}'), false) AS laid, regexp_extract(raw_line, '{_LINE}', [{names}]) AS f FROM kodex_raw_lines),
v AS (SELECT line_id, file_name, line_no, raw_line, laid, {fields} FROM parts),
c AS (SELECT *, laid AND regexp_full_match(gijunYMD, '[0-9]{{8}}') AND try_strptime(gijunYMD, '%Y%m%d') IS NOT NULL
  AND (evalA = '' OR regexp_full_match(evalA, '([0-9]+|[0-9]{{1,3}}(,[0-9]{{3}})+)(\\.[0-9]+)?'))
  AND (ratio = '' OR (regexp_full_match(ratio, '[0-9]+(\\.[0-9]+)?') AND try_cast(ratio AS DOUBLE) <= 100)) AS valid FROM v)
SELECT {select} FROM c WHERE {where}"""


def _p1_reasons_sql() -> str:
    """What breaks a line first: the longest legal beginning tells a broken layout, the fields' beginnings the rest."""
    begin = lambda n: f"length(regexp_extract(s, '^(?:{_FIELD},){{{{{n}}}}}'))".replace("{{", "{").replace("}}", "}")
    layout = """CASE WHEN nxt = '"' AND trim(last) = '' THEN 'unterminated_quote' WHEN nxt = '"' AND NOT contains(last, '"') THEN 'bare_quote' WHEN nxt IN (chr(10), chr(13)) THEN 'bare_line_break' ELSE 'text_after_quote' END"""
    day = "coalesce(regexp_full_match(gijunYMD, '[0-9]{8}') AND try_strptime(gijunYMD, '%Y%m%d') IS NOT NULL, false)"
    amount = "coalesce(evalA = '' OR regexp_full_match(evalA, '([0-9]+|[0-9]{1,3}(,[0-9]{3})+)(\\.[0-9]+)?'), false)"
    inner = _p1_sql("line_id, file_name, line_no, raw_line, gijunYMD, evalA, ratio", "NOT valid OR valid IS NULL")
    return f"""
WITH bad AS ({inner}),
a AS (SELECT *, regexp_replace(raw_line, '\\s+$', '') AS s FROM bad),
b AS (SELECT *, regexp_extract(s, '^(?:{_FIELD},)*{_FIELD}') AS ok, regexp_replace(s, '"(?:[^"]|"")*"', '', 'g') AS bare FROM a),
d AS (SELECT *, substr(s, length(ok) + 1, 1) AS nxt, regexp_extract(ok, '^(?:{_FIELD},)*({_FIELD})$', 1) AS last, 1 + length(bare) - length(replace(bare, ',', '')) AS n FROM b)
SELECT line_id, file_name, line_no,
  CASE WHEN raw_line IS NULL THEN 'no_line' WHEN length(ok) < length(s) THEN {layout} WHEN n <> 11 THEN 'field_count' WHEN NOT {day} THEN 'invalid_gijunYMD' WHEN NOT {amount} THEN 'invalid_evalA' ELSE 'invalid_ratio' END AS reason,
  CASE WHEN raw_line IS NULL THEN NULL WHEN length(ok) < length(s) THEN length(ok) WHEN n > 11 THEN length(regexp_extract(s, '^(?:{_FIELD},){{10}}{_FIELD}')) WHEN n < 11 THEN length(s) WHEN NOT {day} THEN 0 WHEN NOT {amount} THEN {begin(8)} ELSE {begin(9)} END::INTEGER AS error_offset
FROM d"""


_P1_HOLDINGS = """line_id, file_name, CAST(try_strptime(gijunYMD, '%Y%m%d') AS DATE) AS "gijunYMD", nullif(fId, '') AS "fId", try_cast(totalCnt AS INTEGER) AS "totalCnt", nullif(secNm, '') AS "secNm", nullif(itmNo, '') AS "itmNo", try_cast(replace(applyQ, ',', '') AS DECIMAL(38,4)) AS "applyQ", try_cast(replace(curp, ',', '') AS DECIMAL(38,4)) AS "curp", try_cast(replace(risep, ',', '') AS DECIMAL(38,4)) AS "risep", try_cast(replace(evalA, ',', '') AS DECIMAL(38,4)) AS "evalA", try_cast(ratio AS DECIMAL(38,10)) AS "ratio", nullif(pdfType, '') AS "pdfType\""""

_CELLS_SQL = r"""
WITH a AS (
  SELECT trim(a.source_record_id) AS source_record_id, t.source_dataset, t.source_column, t.value_type, trim(a.normalized_value, E' \t\n\r') AS value, a.asserted_at, a.assertion_id
  FROM source_field_assertions a JOIN source_column_types t ON upper(trim(a.source_dataset)) = t.source_dataset AND lower(trim(a.source_column)) = t.source_column
  WHERE a.normalized_value IS NOT NULL),
f AS (
  SELECT *, CASE value_type WHEN 'text' THEN true
    WHEN 'numeric' THEN regexp_full_match(value, '[+-]?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)(\.[0-9]+)?')
    WHEN 'integer' THEN regexp_full_match(value, '[+-]?[0-9]+')
    WHEN 'date' THEN regexp_full_match(value, '[0-9]{8}|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}\.[0-9]{2}\.[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}') AND try_strptime(regexp_replace(value, '[-./]', '', 'g'), '%Y%m%d') IS NOT NULL
    ELSE regexp_full_match(value, '[YyNn]') END AS fits FROM a)"""


def _wide_sql(dataset: str) -> str:
    typed = {
        "text": "{}",
        "numeric": "try_cast(replace({}, ',', '') AS DECIMAL(38,10))",
        "integer": "try_cast({} AS BIGINT)",
        "date": "CAST(try_strptime(regexp_replace({}, '[-./]', '', 'g'), '%Y%m%d') AS DATE)",
        "flag": "upper({}) = 'Y'",
    }
    columns = ", ".join(typed[kind].format(f"max(value) FILTER (WHERE source_column = '{name}' AND fits)") + f' AS "{name}"' for name, kind in layout(dataset))
    return f"""{_CELLS_SQL},
n AS (SELECT * FROM f WHERE source_dataset = '{dataset}' QUALIFY row_number() OVER (PARTITION BY source_record_id, source_column ORDER BY fits DESC, asserted_at DESC NULLS LAST, assertion_id DESC) = 1)
SELECT source_record_id, {columns} FROM n GROUP BY source_record_id"""


def _p3_sql(source: str, dataset: str, content: str, version: str) -> str:
    return f"""
WITH ready AS (SELECT dataset_id, day, row_number() OVER (PARTITION BY dataset_id ORDER BY day) AS seq FROM (SELECT DISTINCT dataset_id, CAST(snapshot_date AS DATE) AS day FROM dataset_snapshots WHERE upper(trim(status)) = 'READY')),
r AS (SELECT s.{dataset} AS dataset_id, trim(s.source_record_key) AS key, seq, arg_max({content}, {version}) AS content
  FROM {source} s JOIN ready ON trim(s.{dataset}) = ready.dataset_id AND CAST(strptime(regexp_replace(s.dataset_snapshot, '[^0-9]', '', 'g'), '%Y%m%d') AS DATE) = ready.day
  GROUP BY ALL),
pairs AS (SELECT coalesce(n.dataset_id, o.dataset_id) AS dataset_id, coalesce(n.key, o.key) AS key, coalesce(n.seq, o.seq + 1) AS seq,
    CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'removed' WHEN n.content <> o.content THEN 'changed' END AS change_kind
  FROM r n FULL JOIN r o ON n.dataset_id = o.dataset_id AND n.key = o.key AND n.seq = o.seq + 1)
SELECT pairs.dataset_id AS {dataset}, key AS source_record_key, strftime(day, '%Y-%m-%d') AS snapshot_date, change_kind
FROM pairs JOIN ready ON pairs.dataset_id = ready.dataset_id AND pairs.seq = ready.seq WHERE pairs.seq > 1 AND change_kind IS NOT NULL"""


# The payload's own digest has no SQL: keys of the JSON object sorted, one layout, then SHA-256.
_PAYLOAD = """coalesce(nullif(regexp_extract(lower(raw_payload_hash), '[0-9a-f]{64}'), ''), sha256('{' || list_aggregate(list_transform(list_sort(json_keys(raw_payload)), lambda k: '"' || k || '": ' || json_extract(raw_payload, '$."' || k || '"')::VARCHAR), 'string_agg', ', ') || '}'))"""
_PRODUCT = "concat_ws('|', " + ", ".join(f"coalesce(trim(CAST({c} AS VARCHAR)), '~')" for c in ("canonical_product_id", "product_type", "product_name", "short_name", "normalized_product_name", "ticker", "isin", "asset_manager", "issuer", "asset_type", "invest_region", "currency", "aum", "nav", "price", "expense_ratio", "base_index")) + ")"


def _p7_values_sql() -> str:
    first = lambda pairs: "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in pairs) + " END"
    number = lambda x: f"try_cast(nullif(regexp_replace({x}, '[,\\s]', '', 'g'), '') AS DOUBLE)"
    part = lambda mark: f"coalesce({number(f'regexp_extract(t, $$([0-9][0-9,]*(?:[.][0-9]+)?)\\s*{mark}$$, 1)')}, 0)"
    rate = lambda c: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in units.COLUMN_RATES.items()) + " END"
    scale = lambda c: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in units.COLUMN_SCALES.items()) + " END"
    factor = "CASE scale " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in units.SCALES.items()) + " END"
    rates = "CASE rate " + " ".join(f"WHEN '{k}' THEN {float(v)}::DOUBLE" for k, v in units.RATES.items()) + " END"
    return f"""
m AS (SELECT * FROM metric_observations QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY recorded_at DESC NULLS LAST) = 1),
k AS (SELECT metric, CASE WHEN max(unit) IN ('CURRENCY_AMOUNT', 'COUNT') THEN max(unit) ELSE 'RATE' END AS kind FROM comparison_contracts GROUP BY 1),
r AS (SELECT m.*, k.kind AS k_kind, c.unit AS k_unit, c.scale_basis AS k_scale, c.currency AS k_currency, replace(trim(raw_value, E' \\t\\n\\r'), '％', '%') AS t
  FROM m LEFT JOIN k ON metric_code = k.metric LEFT JOIN comparison_contracts c ON metric_code = c.metric AND source_dataset = c.dataset),
s AS (SELECT *, coalesce(regexp_matches(t, '[0-9]\\s*[조억만천]\\s*[0-9]'), false) AS several, {first(units.TEXT_CURRENCIES)} AS t_currency, {first(units.TEXT_RATES)} AS t_rate, coalesce(regexp_matches(t, '{units.TEXT_COUNTS}'), false) AS t_count, {first(units.TEXT_SCALES)} AS t_scale FROM r),
v AS (SELECT *, coalesce(CASE WHEN several THEN {part('조')} * 1e12 + {part('억')} * 1e8 + {part('만')} * 1e4 + {part('천')} * 1e3 ELSE {number("regexp_extract(t, '([+-]?[ ]*[0-9][0-9,]*(?:[.][0-9]+)?)', 1)")} END, numeric_value::DOUBLE) AS number,
    coalesce(CASE WHEN several THEN 'UNIT' ELSE t_scale END, CASE WHEN t_currency IS NOT NULL OR t_count THEN 'UNIT' END, {scale('scale_basis')}, {scale('k_scale')}) AS scale,
    coalesce(t_currency, currency, k_currency) AS cur,
    coalesce(t_rate, {rate('weight_scale')}, {rate('unit')}, {rate('scale_basis')}, {rate('k_scale')}, {rate('k_unit')}) AS rate,
    coalesce(k_kind, CASE WHEN unit = 'CURRENCY_AMOUNT' OR scale_basis = 'CURRENCY_UNIT' THEN 'CURRENCY_AMOUNT' WHEN unit = 'COUNT' THEN 'COUNT' WHEN unit IS NOT NULL THEN 'RATE' END) AS kind FROM s),
x AS (SELECT v.*, CASE kind WHEN 'RATE' THEN number * {rates} WHEN 'COUNT' THEN number * {factor} WHEN 'CURRENCY_AMOUNT' THEN number * {factor} * CASE WHEN cur = 'KRW' THEN 1 ELSE krw_amount / quoted_units END END AS common_value
  FROM v LEFT JOIN currency_rates f ON v.cur = f.currency AND v.observed_on = f.rate_date)"""


def _p7_sql() -> str:
    return f"WITH {_p7_values_sql()} SELECT a.fact_id AS fact_id_1, b.fact_id AS fact_id_2 FROM x a JOIN x b ON a.subject_entity_id = b.subject_entity_id AND a.metric_code = b.metric_code AND a.observed_on = b.observed_on AND a.fact_id < b.fact_id WHERE abs(a.common_value - b.common_value) > 0.01 * greatest(abs(a.common_value), abs(b.common_value))"


def oracle_sql() -> dict[str, str]:
    return {
        "p7_found": _p7_sql(),
        "p7_values": f"WITH {_p7_values_sql()} SELECT fact_id, metric_code, subject_entity_id, observed_on, number, CASE kind WHEN 'CURRENCY_AMOUNT' THEN CASE WHEN cur = 'KRW' THEN 'KRW' ELSE cur || '@' || observed_on END || ':' || scale WHEN 'COUNT' THEN 'SHARE:' || scale WHEN 'RATE' THEN rate END AS source_unit, CASE kind WHEN 'CURRENCY_AMOUNT' THEN 'KRW' WHEN 'COUNT' THEN 'SHARE' WHEN 'RATE' THEN 'PERCENT' END AS canonical_unit, common_value FROM x",
        "p1_found": _p1_sql("line_id", "NOT valid OR valid IS NULL"),
        "p1_reasons": _p1_reasons_sql(),
        "p1_holdings": _p1_sql(_P1_HOLDINGS, "valid"),
        "p2_found": f"{_CELLS_SQL} SELECT source_record_id, source_column FROM f GROUP BY ALL HAVING NOT bool_or(fits)",
        **{f"p2_wide_{name.lower()}": _wide_sql(name) for name in WIDE_LAYOUT},
        "p3_found": _p3_sql("source_records", "dataset_id", _PAYLOAD, "loaded_at"),
        "p3_products": _p3_sql("canonical_products", "source_dataset", _PRODUCT, "coalesce(observed_at, '')"),
    }
