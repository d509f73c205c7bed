"""Structured requests: what may be asked, defaults, contracts, and the plan they become."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.operators import predicates, projection, ranking
from factweave.operators.predicates import Field, Filter, RequestRefused, Tree

#: Directions that "good" and "bad" mean, and wishes that are recognised and refused.
DIRECTIONS = {"high": True, "low": False}
REFUSED = ("count", "group_by", "not", "historical_snapshot", "recommendation", "holding_weight")


@dataclass(frozen=True)
class Sort:
    field: str
    descending: bool = True


@dataclass(frozen=True)
class Request:
    """A structured question: predicates, candidates, outputs, order and limit."""

    filters: tuple[Filter, ...] = ()
    tree: Tree | str | None = None
    outputs: tuple[str, ...] = ()
    sort: tuple[Sort, ...] = ()
    limit: int | None = None
    wishes: tuple[str, ...] = ()
    universe: str = "all"


@dataclass(frozen=True)
class Contract:
    """What makes a metric comparable: one dataset, unit, scale and currency, and where sorting is allowed.

    ``currency_field``: the currency is what the request says of that field in whatever branch holds, and only then is
    the metric comparable.
    """

    metric: str
    dataset: str
    unit: str
    scale: str | None = None
    currency: str | None = None
    universes: tuple[str, ...] = ("all",)
    #: A field that must have one certain value, which then is the currency compared in.
    currency_field: str | None = None


@dataclass
class Catalog:
    """What a plan can draw on."""

    base: DataFrame
    entity: str
    fields: Mapping[str, Field]
    metrics: DataFrame | None = None
    contracts: Mapping[str, Contract] = field(default_factory=dict)
    universes: Mapping[str, DataFrame] = field(default_factory=dict)


def with_defaults(request: Request) -> tuple[Request, list[str]]:
    """Sorting without a limit means the top five. Says what was assumed."""
    if request.sort and request.limit is None:
        return replace(request, limit=ranking.DEFAULT_TOP), [f"limit {ranking.DEFAULT_TOP}"]
    return request, []


def gate(request: Request, catalog: Catalog) -> list[str]:
    """Reasons to refuse; empty if the request may run. Nothing is executed."""
    reasons = [f"{w} is not offered" for w in request.wishes if w in REFUSED]
    for f in request.filters:
        spec = catalog.fields.get(f.field)
        if spec is None:
            reasons.append(f"unknown field {f.field}")
        elif f.op not in predicates.KIND_OPERATORS[spec.kind]:
            reasons.append(f"{f.field} does not take {f.op}")
    reasons += [f"unknown output {o}" for o in request.outputs if o not in catalog.fields]
    listed = [s for s in request.sort if s.field in catalog.contracts]
    if request.sort and not listed:
        reasons.append(f"{request.sort[0].field} has no contract to sort by")
    for s in listed:
        contract = catalog.contracts[s.field]
        if request.universe not in contract.universes:
            reasons.append(f"{s.field} can't be compared in {request.universe}")
        if contract.currency_field and len(certain_values(request.tree, request.filters, contract.currency_field) or ()) != 1:
            reasons.append(f"{s.field} needs one {contract.currency_field}")
    if request.universe != "all" and request.universe not in catalog.universes:
        reasons.append(f"unknown universe {request.universe}")
    if request.limit is not None and not request.sort and "top" in request.wishes:
        reasons.append("top without an order")
    try:
        ranking.checked_limit(request.limit)
    except RequestRefused as e:
        reasons.append(str(e))
    return reasons


def supported_sorts(sorts: Sequence[Sort], contracts: Mapping[str, Contract]) -> tuple[list[Sort], list[str]]:
    """Sorts with a contract and the names of those without; a lone one without is refused."""
    kept, lost = [s for s in sorts if s.field in contracts], [s.field for s in sorts if s.field not in contracts]
    if lost and not kept:
        raise RequestRefused(f"{lost[0]} has no contract to sort by")
    return kept, lost


def certain_values(tree: Tree | str | None, filters: Sequence[Filter], wanted: str) -> set | None:
    """Values a field must have whatever branch holds: all branches of an AND add, those of an OR must all say so.

    None if nothing is certain. Only equality and membership say something.
    """
    by_key = {f.key: f for f in filters}

    def of(node: Tree | str) -> set | None:
        if isinstance(node, str):
            f = by_key[node]
            return set(f.values) if f.field == wanted and f.op in ("eq", "in") else None
        parts = [of(c) for c in node.children]
        if node.op == "or":
            return None if any(p is None for p in parts) else set().union(*parts)
        known = [p for p in parts if p is not None]
        return set.intersection(*known) if known else None

    in_tree: set[str] = set()

    def keys(node) -> None:
        if isinstance(node, str):
            in_tree.add(node)
        elif node is not None:
            for c in node.children:
                keys(c)

    keys(tree)
    parts = ([of(tree)] if tree is not None else []) + [of(f.key) for f in filters if f.key not in in_tree]
    known = [p for p in parts if p is not None]
    return set.intersection(*known) if known else None


def contracted(metrics: DataFrame, contract: Contract) -> DataFrame:
    """The latest comparable observations of a contract's metric: entity_id, value."""
    rows = metrics.where((F.col("metric") == contract.metric) & (F.col("dataset") == contract.dataset) & (F.col("unit") == contract.unit) & F.col("comparable"))
    if contract.scale is not None:
        rows = rows.where(F.col("scale") == contract.scale)
    if contract.currency is not None:
        rows = rows.where(F.col("currency") == contract.currency)
    return ranking.latest(rows, ["entity_id"], "observed_on", "fact_id", ["value"])


@dataclass
class Answer:
    """Rows, one row of counts, and what was assumed; all lazy."""

    rows: DataFrame
    stats: DataFrame
    notes: list[str]


def run(request: Request, catalog: Catalog, candidates: DataFrame | None = None) -> Answer:
    """Compile a request to one plan: universe, candidates, predicates, ranking, projection. Refuses with all reasons."""
    request, notes = with_defaults(request)
    reasons = gate(request, catalog)
    if reasons:
        raise RequestRefused("; ".join(reasons))
    kept, lost = supported_sorts(request.sort, catalog.contracts)
    request = replace(request, sort=tuple(kept))
    notes += [f"not sorted by {name}" for name in lost]
    if request.limit is not None and request.limit > ranking.MAX_LIMIT:
        notes.append(f"limit {ranking.MAX_LIMIT}")
    key = catalog.entity
    base = catalog.base if request.universe == "all" else catalog.base.join(catalog.universes[request.universe].select(key).distinct(), key, "left_semi")
    chosen = predicates.select_entities(predicates.restrict(base, key, candidates), key, request.filters, catalog.fields, request.tree)
    ranked = chosen
    for s in request.sort:
        contract = catalog.contracts[s.field]
        if contract.currency_field:
            contract = replace(contract, currency=next(iter(certain_values(request.tree, request.filters, contract.currency_field))))
        values = contracted(catalog.metrics, contract).select(F.col("entity_id").alias(key), F.col("value").alias(s.field))
        ranked = ranked.join(values, key, "left")
    stats = ranking.rank_counts(ranked, key, request.sort[0].field) if request.sort else ranked.agg(F.count_distinct(key).alias("filtered_count"))
    rows = ranking.top(ranked, [(s.field, s.descending) for s in request.sort], key, request.limit) if request.sort else ranked.orderBy(key).limit(ranking.checked_limit(request.limit))
    names = projection.select_list([o for o in request.outputs], [s.field for s in request.sort], [f.field for f in request.filters if f.op in ("lt", "lte", "gt", "gte", "between")], default=key)
    for n in names:
        spec = catalog.fields.get(n)
        if spec is not None and spec.kind != "attribute" and n not in rows.columns:
            rows = rows.join(projection.multi_value(spec.facts.join(rows.select(key), key, "left_semi"), key, "value", n), key, "left")
        elif spec is not None and spec.kind == "attribute" and spec.column != n:
            rows = rows.withColumn(n, F.col(spec.column))
    return Answer(rows.select(*dict.fromkeys([key, *[n for n in names if n in rows.columns]])), stats, notes)


def local_tree(tree: Tree | str | None, local: Sequence[str], known: Sequence[str]) -> Tree | str | None:
    """The part of a tree that one store can answer: an AND may lose leaves of other stores, an OR may not."""
    if tree is None or isinstance(tree, str):
        if tree is not None and tree not in known:
            raise RequestRefused(f"filter {tree} is unknown")
        return tree if tree in local else None
    parts = [local_tree(c, local, known) for c in tree.children]
    kept = tuple(p for p in parts if p is not None)
    if tree.op == "or" and len(kept) < len(parts):
        raise RequestRefused("an OR can't be split over stores")
    return None if not kept else kept[0] if len(kept) == 1 else Tree(tree.op, kept)


def without_filters(tree: Tree | str | None, removed: Sequence[str]) -> Tree | str | None:
    """A tree without filters that hold for a group anyway; they can be taken from an AND only."""
    if tree is None or isinstance(tree, str):
        return None if tree in removed else tree
    if tree.op == "or":
        inside = lambda n: n in removed if isinstance(n, str) else any(inside(c) for c in n.children)
        if inside(tree):
            raise RequestRefused("a filter can't be taken out of an OR")
        return tree
    kept = tuple(p for p in (without_filters(c, removed) for c in tree.children) if p is not None)
    return None if not kept else kept[0] if len(kept) == 1 else Tree("and", kept)
