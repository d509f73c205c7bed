"""One- and two-hop paths over an edge table (edge_id, subject, relation, object)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.operators.predicates import RequestRefused
from factweave.session import checkpointed

#: Fixed value: longest path.
MAX_HOPS = 2


@dataclass(frozen=True)
class Hop:
    relation: str
    forward: bool = True


def _hop(edges: DataFrame, hop: Hop, i: int) -> DataFrame:
    a, b = ("subject", "object") if hop.forward else ("object", "subject")
    return edges.where(F.col("relation") == hop.relation).select(F.col("edge_id").alias(f"e{i}"), F.col(a).alias(f"n{i}"), F.col(b).alias(f"n{i + 1}"))


def paths(edges: DataFrame, hops: Sequence[Hop], allowed: Sequence[str], start: DataFrame | None = None, end: DataFrame | None = None) -> DataFrame:
    """n0, e0, n1 (, e1, n2) of all paths along the hops whose ends are in ``start`` / ``end`` (frames of ``node``).

    The anchor that is given restricts its hop before the hops meet. A path needs an anchor and an allowed relation.
    """
    if not 1 <= len(hops) <= MAX_HOPS:
        raise RequestRefused(f"a path has 1 to {MAX_HOPS} hops")
    if start is None and end is None:
        raise RequestRefused("a path needs an anchor")
    for hop in hops:
        if hop.relation not in allowed:
            raise RequestRefused(f"{hop.relation} can't be walked")
    steps = [_hop(edges, h, i) for i, h in enumerate(hops)]
    if start is not None:
        steps[0] = steps[0].join(start.select(F.col("node").alias("n0")).distinct(), "n0", "left_semi")
    if end is not None:
        steps[-1] = steps[-1].join(end.select(F.col("node").alias(f"n{len(hops)}")).distinct(), f"n{len(hops)}", "left_semi")
    return steps[0] if len(steps) == 1 else steps[0].join(steps[1], "n1")


def anchors(nodes: DataFrame, values: Sequence[str], node_type: str | None = None) -> DataFrame:
    """node: those whose id, canonical value, display name or identifier is one of the values, of a type if given.

    ``nodes`` has node, type and any of canonical_value, display_name, identifier_value.
    """
    match = F.lit(False)
    for c in ("node", "canonical_value", "display_name", "identifier_value"):
        if c in nodes.columns:
            match |= F.coalesce(F.col(c).isin(list(values)), F.lit(False))
    return nodes.where(match if node_type is None else match & (F.col("type") == node_type)).select("node").distinct()


def of_snapshot(rows: DataFrame, snapshots: Sequence[str]) -> DataFrame:
    """Nodes or edges of the chosen snapshots."""
    return rows.where(F.col("snapshot_id").isin(list(snapshots)))


def touching(found: DataFrame, candidates: DataFrame, nodes: Sequence[str]) -> DataFrame:
    """Paths on which any node is a candidate, with ``result``: the first such node on the path."""
    keys = candidates.select(F.col("node").alias("_c")).distinct()
    for n in nodes:
        found = found.join(keys.select(F.col("_c").alias(n), F.lit(True).alias(f"_in_{n}")), n, "left")
    first = F.coalesce(*[F.when(F.col(f"_in_{n}"), F.col(n)) for n in nodes])
    return found.withColumn("result", first).where("result IS NOT NULL").drop(*[f"_in_{n}" for n in nodes])


def result_entities(found: DataFrame, hops: Sequence[Hop], candidates: DataFrame | None = None) -> DataFrame:
    """Paths with ``result``: the first node that is a candidate, else the first node, or the last if the walk begins backward."""
    nodes = [f"n{i}" for i in range(len(hops) + 1)]
    end = F.col(nodes[0] if hops[0].forward else nodes[-1])
    if candidates is None:
        return found.withColumn("result", end)
    keys = candidates.select(F.col("node").alias("_c")).distinct()
    for n in nodes:
        found = found.join(keys.select(F.col("_c").alias(n), F.lit(True).alias(f"_in_{n}")), n, "left")
    first = F.coalesce(*[F.when(F.col(f"_in_{n}"), F.col(n)) for n in nodes], end)
    return found.withColumn("result", first).drop(*[f"_in_{n}" for n in nodes])


def path_records(found: DataFrame, hops: Sequence[Hop], nodes: DataFrame, edges: DataFrame, provenance: Sequence[str] = ()) -> DataFrame:
    """One record per path: source_id (its edges), field (its relations), value (the last label), text (all labels), ``path``.

    A node without a display name is labelled by its id. ``path`` is an array of structs (edge_id and the provenance
    columns of the edge), in the order of the walk. ``found`` comes from ``result_entities``.
    """
    labels = nodes.groupBy("node").agg(F.min("display_name").alias("_l"))
    facts = edges.select("edge_id", *provenance).dropDuplicates(["edge_id"])
    for i in range(len(hops) + 1):
        found = found.join(labels.select(F.col("node").alias(f"n{i}"), F.col("_l").alias(f"_l{i}")), f"n{i}", "left")
    for i in range(len(hops)):
        found = found.join(facts.select(F.col("edge_id").alias(f"e{i}"), F.struct("edge_id", *provenance).alias(f"_p{i}")), f"e{i}")
    label = [F.coalesce(F.col(f"_l{i}"), F.col(f"n{i}")) for i in range(len(hops) + 1)]
    return found.select(
        F.concat(F.lit("graph:"), F.concat_ws(":", *[f"e{i}" for i in range(len(hops))])).alias("source_id"),
        F.col("result").alias("entity_id"),
        F.lit("graph." + "/".join(h.relation for h in hops)).alias("field"),
        label[-1].alias("value"),
        F.concat_ws(" -> ", *label).alias("text"),
        F.array(*[f"_p{i}" for i in range(len(hops))]).alias("path"),
    )


def path_window(found: DataFrame, limit: int, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(paths, state): the first paths in order, and one row with their number and whether they are all."""
    state = found.limit(limit + 1).agg(F.least(F.count(F.lit(1)), F.lit(limit)).alias("returned"), (F.count(F.lit(1)) <= limit).alias("complete"))
    return found.orderBy(*order).limit(limit), state


def projected(facts: DataFrame, nodes: DataFrame, allowed: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(edges, lost) of relation facts (fact_id, subject, relation, object): allowed relations with both ends known."""
    made = facts.where(F.col("relation").isin(list(allowed))).select(F.col("fact_id").alias("edge_id"), "subject", "relation", "object")
    known = nodes.select("node").distinct()
    whole = made.join(known.withColumnRenamed("node", "subject"), "subject", "left_semi").join(known.withColumnRenamed("node", "object"), "object", "left_semi")
    return whole.select("edge_id", "subject", "relation", "object"), dangling(made, nodes)


def through(edges: DataFrame, first: str, second: str, targets: DataFrame, out: str) -> DataFrame:
    """Edges ``out`` from a subject to the targets it reaches over two relations: a fund holds what a company issued."""
    ends = edges.where(F.col("relation") == second).join(targets.select(F.col("node").alias("object")).distinct(), "object", "left_semi").select(F.col("subject").alias("_via"), "object")
    starts = edges.where(F.col("relation") == first).select("subject", F.col("object").alias("_via"))
    return starts.join(ends, "_via").select("subject", F.lit(out).alias("relation"), "object").distinct()


def all_paths(parts: Sequence[DataFrame], entity: str) -> DataFrame:
    """Entities that every path search found."""
    out = parts[0].select(entity).distinct()
    for p in parts[1:]:
        out = out.join(p.select(entity).distinct(), entity, "left_semi")
    return out


def any_path(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows of all path searches, each key once."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates([key])


def merged_edges(edges: DataFrame, sources: str) -> DataFrame:
    """Edges with the same subject, relation and object as one, with the sorted set of their sources."""
    return edges.groupBy("subject", "relation", "object").agg(F.array_join(F.array_sort(F.collect_set(sources)), "|").alias(sources))


def same_object(rows: DataFrame, subject: str, target: str) -> DataFrame:
    """subject, ``class`` (the shared object) and ``links``: how many other subjects share it.

    All pairs of a class follow from it; a hot object would have them grow with the square. NULL objects share nothing.
    """
    known = rows.where(F.col(target).isNotNull()).select(subject, F.col(target).alias("class"))
    sizes = known.groupBy("class").agg((F.count(F.lit(1)) - 1).alias("links"))
    return known.join(sizes, "class").select(subject, "class", "links")


def manifest(edges: DataFrame) -> DataFrame:
    """One row: edges, and a checksum of their numbers by relation, whatever the order of rows."""
    counts = edges.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))
    told = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "relation", "n"))), ";")
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edges"), F.sha2(told, 256).alias("checksum"))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    known = nodes.select(F.col("node").alias("subject")).distinct()
    missing = edges.join(known, "subject", "left_anti")
    return missing.unionByName(edges.join(known, "subject", "left_semi").join(known.withColumnRenamed("subject", "object"), "object", "left_anti"))


def ancestors(links: DataFrame, child: str, parent: str) -> DataFrame:
    """child, ancestor: all ancestors of every child, the child itself where the hierarchy runs in a circle.

    Each round doubles the length of the known ways, until a round finds nothing new; one count a round comes to the
    driver and every round is checkpointed, so a vocabulary of any size and depth is closed whole.
    """
    known = checkpointed(links.select(F.col(child).alias("child"), F.col(parent).alias("ancestor")).dropna().distinct())
    size = known.count()
    while True:
        longer = known.alias("a").join(known.alias("b"), F.col("a.ancestor") == F.col("b.child")).select(F.col("a.child").alias("child"), F.col("b.ancestor").alias("ancestor"))
        known = checkpointed(known.unionByName(longer).distinct())
        now = known.count()
        if now == size:
            return known
        size = now


def incompatible(edges: DataFrame, types: DataFrame, contract: DataFrame, above: DataFrame) -> DataFrame:
    """edge_id, relation of edges whose ends have types the relation's contract does not allow.

    ``types`` has node and type, ``contract`` relation, domain and range (types or ancestors of them, as small as a
    vocabulary), ``above`` from ``ancestors``. Of a node's types one must fit; relations without a contract and
    ends without a type are incompatible.
    """
    wider = types.select("node", F.col("type").alias("kind")).unionByName(types.join(above, F.col("type") == F.col("child")).select("node", F.col("ancestor").alias("kind"))).distinct()
    starts = edges.join(contract, "relation").join(wider.select(F.col("node").alias("subject"), F.col("kind").alias("domain")), ["subject", "domain"], "left_semi")
    fit = starts.join(wider.select(F.col("node").alias("object"), F.col("kind").alias("range")), ["object", "range"], "left_semi")
    return edges.join(fit.select("edge_id").distinct(), "edge_id", "left_anti").select("edge_id", "relation")


def closure(links: DataFrame, child: str, parent: str) -> dict[str, set[str]]:
    """All ancestors of each child in a small hierarchy (a vocabulary), worked out on the driver."""
    up: dict[str, set[str]] = {}
    for r in links.select(child, parent).distinct().collect():
        up.setdefault(r[0], set()).add(r[1])

    def reach(node: str) -> set[str]:
        seen: set[str] = set()
        todo = [node]
        while todo:
            new = up.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        return seen

    return {c: reach(c) for c in up}
