"""Structured predicates over a fact store, compiled to joins on distinct keys.

What must hold in any case, the leaves of an AND, restricts the base: attributes first, by a filter that reaches the
scan, then facts by semi and anti joins. A leaf under an OR becomes a boolean column of the base entities, joined by
equi-joins on distinct keys, so a nested tree is one Column expression and OR needs no nested-loop join.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Operators, the deepest tree, and which operators a kind of field takes.
OPERATORS = ("eq", "ne", "lt", "lte", "gt", "gte", "in", "between", "contains")
MAX_DEPTH = 32
KIND_OPERATORS = {
    "attribute": OPERATORS,
    "classification": ("eq", "ne", "in"),
    "relation": ("eq", "ne", "in"),
    "flag": ("eq", "ne"),
    "metric": ("eq", "ne", "lt", "lte", "gt", "gte", "in", "between"),
    "vocabulary": ("eq", "ne", "lt", "lte", "gt", "gte", "in", "between"),
}


class RequestRefused(ValueError):
    """The request asks for something its fields don't allow."""


@dataclass(frozen=True)
class Filter:
    """One predicate: a field, an operator and its values; ``key`` names it in a tree."""

    key: str
    field: str
    op: str
    values: tuple = ()

    def __post_init__(self) -> None:
        if self.op not in OPERATORS:
            raise RequestRefused(f"unknown operator {self.op}")
        need = {"between": 2, "in": None}.get(self.op, 1)
        if need is not None and len(self.values) != need:
            raise RequestRefused(f"{self.op} takes {need} value(s), got {len(self.values)}")
        if self.op == "between" and self.values[0] > self.values[1]:
            raise RequestRefused("between needs ascending bounds")


@dataclass(frozen=True)
class Tree:
    """AND / OR over filter keys and further trees. NOT is refused: negation belongs to a field (``ne``)."""

    op: str
    children: tuple

    def __post_init__(self) -> None:
        if self.op not in ("and", "or"):
            raise RequestRefused(f"{self.op} is not supported in a predicate tree")


@dataclass
class Field:
    """Where a field lives. Facts are DataFrames of (entity, value)."""

    kind: str
    column: str | None = None
    facts: DataFrame | None = None
    ranks: Mapping[str, int] = field(default_factory=dict)


def compare(value: Column, op: str, values: Sequence) -> Column:
    """A comparison with SQL's three-valued logic; ``contains`` is literal, without wildcards."""
    lits = [F.lit(v) for v in values]
    return {
        "eq": lambda: value == lits[0],
        "ne": lambda: value != lits[0],
        "lt": lambda: value < lits[0],
        "lte": lambda: value <= lits[0],
        "gt": lambda: value > lits[0],
        "gte": lambda: value >= lits[0],
        "in": lambda: value.isin(list(values)) if values else F.lit(False),
        "between": lambda: value.between(lits[0], lits[1]),
        "contains": lambda: F.contains(F.lower(F.regexp_replace(value, r"\s+", "")), F.lower(F.regexp_replace(lits[0], r"\s+", ""))),
    }[op]()


def rank_of(value: Column, ranks: Mapping[str, int]) -> Column:
    """The place of a value in an ordered vocabulary, NULL for others."""
    table = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    return F.try_element_at(table, value)


def _flags(base: DataFrame, entity: str, rows: DataFrame, column: Column, name: str) -> DataFrame:
    """base with a boolean ``name``: whether any of the entity's rows meets the column; False if it has none."""
    keys = rows.where(column).select(entity).where(F.col(entity).isNotNull()).distinct().withColumn(name, F.lit(True))
    return base.join(keys, entity, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def _checked(f: Filter, fields: Mapping[str, Field]) -> Field:
    spec = fields.get(f.field)
    if spec is None:
        raise RequestRefused(f"unknown field {f.field}")
    if f.op not in KIND_OPERATORS[spec.kind]:
        raise RequestRefused(f"{f.field} does not take {f.op}")
    missing = [v for v in f.values if spec.kind == "vocabulary" and v not in spec.ranks]
    if missing:
        raise RequestRefused(f"{f.field} has no value {missing[0]}")
    return spec


def _matching(f: Filter, spec: Field) -> Column:
    """What a fact's value must meet; for a negation of a class, relation or flag, what it must not."""
    value = F.col("value")
    if spec.kind == "vocabulary":
        return compare(rank_of(value, spec.ranks), f.op, [spec.ranks[v] for v in f.values])
    return value.isin(list(f.values)) if f.op == "ne" and spec.kind != "metric" else compare(value, f.op, f.values)


def _known(spec: Field, entity: str) -> DataFrame:
    """Entities of which something is known: of a class exactly one value, of a relation any."""
    facts = spec.facts.where(F.col("value").isNotNull())
    if spec.kind == "relation":
        return facts.select(entity)
    return facts.groupBy(entity).agg((F.min("value") == F.max("value")).alias("_one")).where("_one").select(entity)


def _negated(f: Filter, spec: Field) -> bool:
    return f.op == "ne" and spec.kind in ("classification", "relation", "flag")


def required(base: DataFrame, entity: str, f: Filter, spec: Field) -> DataFrame:
    """Rows of base that meet a filter on facts."""
    matching = spec.facts.where(_matching(f, spec)).select(entity)
    if not _negated(f, spec):
        return base.join(matching, entity, "left_semi")
    kept = base.join(matching, entity, "left_anti")
    return kept if spec.kind == "flag" else kept.join(_known(spec, entity), entity, "left_semi")


def leaf(base: DataFrame, entity: str, f: Filter, spec: Field) -> tuple[DataFrame, Column]:
    """base with what the filter needs, and the filter's condition.

    Negation depends on the kind: a classification or relation must be known and not match; flags are open-world, so
    entities without a fact match; plain attributes and metrics follow SQL.
    """
    if spec.kind == "attribute":
        return base, compare(F.col(spec.column), f.op, f.values)
    match, known = f"_m_{f.key}", f"_k_{f.key}"
    base = _flags(base, entity, spec.facts, _matching(f, spec), match)
    if not _negated(f, spec):
        return base, F.col(match)
    if spec.kind == "flag":
        return base, ~F.col(match)
    base = base.join(_known(spec, entity).distinct().withColumn(known, F.lit(True)), entity, "left")
    return base, ~F.col(match) & F.coalesce(F.col(known), F.lit(False))


def conjuncts(tree: Tree | str | None) -> list[Tree | str]:
    """The parts of a tree that must all hold."""
    if tree is None:
        return []
    if isinstance(tree, Tree) and tree.op == "and":
        return [x for c in tree.children for x in conjuncts(c)]
    return [tree]


def _check_tree(node: Tree | str, known: Mapping[str, Filter], used: set[str], depth: int = 1) -> None:
    if depth > MAX_DEPTH:
        raise RequestRefused(f"a predicate tree is at most {MAX_DEPTH} deep")
    if isinstance(node, str):
        if node not in known or node in used:
            raise RequestRefused(f"filter {node} is unknown or used twice")
        used.add(node)
        return
    if not node.children:
        raise RequestRefused("an empty AND or OR")
    for c in node.children:
        _check_tree(c, known, used, depth + 1)


def select_entities(base: DataFrame, entity: str, filters: Sequence[Filter], fields: Mapping[str, Field], tree: Tree | str | None = None) -> DataFrame:
    """Rows of base that meet the tree; filters the tree leaves out are further conditions.

    A filter may stand in the tree once. Without filters all rows stay.
    """
    by_key: dict[str, Filter] = {}
    for f in filters:
        if f.key in by_key:
            raise RequestRefused(f"filter {f.key} is given twice")
        by_key[f.key] = f
    specs = {k: _checked(f, fields) for k, f in by_key.items()}
    columns = base.columns
    used: set[str] = set()
    if tree is not None:
        _check_tree(tree, by_key, used)
    parts = conjuncts(tree) + [k for k in by_key if k not in used]
    alone = [p for p in parts if isinstance(p, str)]
    for k in alone:
        if specs[k].kind == "attribute":
            base = base.where(compare(F.col(specs[k].column), by_key[k].op, by_key[k].values))
    for k in alone:
        if specs[k].kind != "attribute":
            base = required(base, entity, by_key[k], specs[k])

    def build(node: Tree | str) -> Column:
        nonlocal base
        if isinstance(node, str):
            base, condition = leaf(base, entity, by_key[node], specs[node])
            return condition
        fold: Callable = (lambda a, b: a & b) if node.op == "and" else (lambda a, b: a | b)
        return reduce(fold, [build(c) for c in node.children])

    wanted = [build(p) for p in parts if not isinstance(p, str)]
    return base.where(reduce(lambda a, b: a & b, wanted)).select(*columns) if wanted else base


def restrict(df: DataFrame, entity: str, candidates: DataFrame | None) -> DataFrame:
    """Rows of candidate entities; no candidate frame means no restriction, an empty one no rows."""
    return df if candidates is None else df.join(candidates.select(entity).distinct(), entity, "left_semi")


def rollup_matches(children: DataFrame, parent: str, value: str, wanted: Sequence, any_child: bool) -> DataFrame:
    """Parents by their children's values: any child matches, or some match and none differs."""
    rows = children.where(F.col(value).isNotNull()).groupBy(parent).agg(F.bool_or(F.col(value).isin(list(wanted))).alias("_some"), F.bool_or(~F.col(value).isin(list(wanted))).alias("_other"))
    return rows.where(F.col("_some") if any_child else F.col("_some") & ~F.col("_other")).select(parent)


def known_once(facts: DataFrame, entity: str, value: str) -> DataFrame:
    """Entities with exactly one distinct value."""
    return facts.where(F.col(value).isNotNull()).groupBy(entity).agg(F.count_distinct(value).alias("_n")).where("_n = 1").select(entity)


def same_record_fields(assertions: DataFrame, record: str, entity: str, column: str, value: str, names: Sequence[str]) -> DataFrame:
    """Entities with a record that carries a non-blank value of every named column: one grouping, no self-join."""
    filled = F.collect_set(F.when(F.trim(F.col(value)) != "", F.col(column)))
    return assertions.where(F.col(column).isin(list(names))).groupBy(record, entity).agg(filled.alias("_set")).where(F.size("_set") == len(set(names))).select(entity).distinct()
