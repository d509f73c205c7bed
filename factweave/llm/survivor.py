"""The best representative of each group of duplicates by token-level consensus.

Every field of the members is cut into tokens. Progressive alignment brings the members' tokens into columns, heaviest
member first, and the tokens of a column vote with their member's trust; the winning tokens are the group's consensus.
Members are tried by their distance to the consensus, and the first that no other member beats survives (the exact
check); each field of the built record is the existing value closest to the consensus of the field.

Groups of up to BLOCK members meet in one shuffle and are worked off whole. A larger one is never gathered: its members
are aligned in blocks of bounded size, the blocks' profiles are aligned with each other level by level, and distances
are taken row by row.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.session import checkpointed

#: Members aligned in one block, and profiles in one step of a level.
BLOCK = 256
#: Alignments of more cells than this are halved until they are smaller, so memory stays bounded; the gain is the same.
MAX_CELLS = 250_000
GAP_COST = 0.01
TOKEN = re.compile(r"\d+|[^\W\d_]+|\S")
GAP = ""

Profile = list[dict[str, float]]


def tokens(value: str) -> list[str]:
    return TOKEN.findall(value)


def _last_row(n: int, m: int, gain) -> list[float]:
    """Best gain of aligning all n columns with the first j, for each j up to m."""
    cost = GAP_COST
    row = [-cost * j for j in range(m + 1)]
    for i in range(1, n + 1):
        above, row = row, [-cost * i]
        for j in range(1, m + 1):
            row.append(max(above[j - 1] + gain(i - 1, j - 1), above[j] - cost, row[j - 1] - cost))
    return row


def _paired(n: int, m: int, gain) -> list[tuple[int | None, int | None]]:
    """Global alignment of n and m columns that maximizes the gain of the pairs; gaps cost a little."""
    cost = GAP_COST
    if n * m > MAX_CELLS and n > 1:
        half = n // 2
        fore, back = _last_row(half, m, gain), _last_row(n - half, m, lambda i, j: gain(n - 1 - i, m - 1 - j))
        cut = max(range(m + 1), key=lambda j: fore[j] + back[m - j])
        rest = _paired(n - half, m - cut, lambda i, j: gain(half + i, cut + j))
        return _paired(half, cut, gain) + [(None if i is None else half + i, None if j is None else cut + j) for i, j in rest]
    best = [[-cost * (i + j) if not i * j else 0.0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        row, above = best[i], best[i - 1]
        for j in range(1, m + 1):
            row[j] = max(above[j - 1] + gain(i - 1, j - 1), above[j] - cost, row[j - 1] - cost)
    out, i, j = [], n, m
    while i or j:
        if i and j and abs(best[i][j] - best[i - 1][j - 1] - gain(i - 1, j - 1)) < 1e-12:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and abs(best[i][j] - best[i - 1][j] + cost) < 1e-12:
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


def merge(left: Profile, right: Profile) -> Profile:
    """Two profiles aligned into one; a column is a map from token to weight, GAP where a side has no token."""
    if not left or not right:
        return left or right
    w_left, w_right = sum(left[0].values()), sum(right[0].values())
    share = lambda i, j: sum(min(w / w_left, right[j].get(t, 0.0) / w_right) for t, w in left[i].items() if t != GAP) - 1e-3
    same = len(left) == len(right) and all(a.keys() == b.keys() for a, b in zip(left, right))
    out: Profile = []
    for i, j in [(k, k) for k in range(len(left))] if same else _paired(len(left), len(right), share):
        column = dict(left[i]) if i is not None else {GAP: w_left}
        for token, w in (right[j] if j is not None else {GAP: w_right}).items():
            column[token] = column.get(token, 0.0) + w
        out.append(column)
    return out


def profile(values: Sequence[tuple[str, float]]) -> Profile:
    """Progressive alignment of weighted values, heaviest first; equal values are one with the sum of their weights."""
    weight: dict[str, float] = {}
    for value, w in sorted(values):  # sums of floats must not depend on the order of arrival
        weight[value] = weight.get(value, 0.0) + w
    out: Profile = []
    for value, w in sorted(weight.items(), key=lambda x: (-x[1], x[0])):
        out = merge(out, [{t: w} for t in tokens(value)])
    return out


def consensus(columns: Profile) -> list[str]:
    """The heaviest token of each column; of equal ones a token before a gap, then the least."""
    chosen = [min(c.items(), key=lambda x: (-x[1], x[0] == GAP, x[0]))[0] for c in columns]
    return [t for t in chosen if t != GAP]


def distance(value: str | None, target: list[str]) -> float:
    """0 for the consensus itself, 1 for nothing in common or no value where the consensus has one."""
    have = tokens(value or "")
    if have == target:
        return 0.0
    if not have or not target:
        return 1.0
    hits = sum(1 for i, j in _paired(len(have), len(target), lambda i, j: 1.0 if have[i] == target[j] else -0.1) if i is not None and j is not None and have[i] == target[j])
    return 1 - hits / max(len(have), len(target))


def _map_lists(df: DataFrame, keys: list[str], column: str, out: str, function) -> DataFrame:
    """keys and ``out`` = function(list in column), a JSON string."""
    schema = ", ".join(f"{k} {t}" for k, t in df.dtypes if k in keys) + f", {out} string"
    ordered = df.select(*keys, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([function(x) for x in batch.column(len(keys)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], made], names=[*keys, out])

    return ordered.mapInArrow(run, schema)


def _texts(names: Sequence[str]) -> list[Column]:
    return [F.col(n).cast("string").alias(f"t_{n}") for n in names]


def group_consensus(members: DataFrame, group: str, member: str, fields: Sequence[str], trust: Column) -> DataFrame:
    """group and ``target``: JSON of the consensus tokens of each field, NULL values not voting.

    Fields are compared as text. One number, the largest group's size, comes to the driver; it gives the levels.
    """
    names = list(fields)

    def align(rows: list[dict]) -> str:
        return json.dumps({n: profile([(r[n], r["_w"]) for r in rows if r[n] is not None]) for n in names})

    def align_profiles(rows: list[str]) -> str:
        many = [json.loads(r) for r in sorted(rows)]
        out = {}
        for n in names:
            parts = sorted((p[n] for p in many if p[n]), key=lambda c: -sum(c[0].values()))
            whole: Profile = []
            for p in parts:
                whole = merge(whole, p)
            out[n] = whole
        return json.dumps(out)

    rows = members.where(F.col(group).isNotNull()).select(group, F.col(member).cast("string").alias("_m"), trust.cast("double").alias("_w"), *[F.col(n).cast("string").alias(n) for n in names])
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"))
    largest = sizes.agg(F.max("_n")).first()[0] or 0
    rows = rows.join(sizes, group).withColumn("_block", F.pmod(F.xxhash64("_m"), F.ceil(F.col("_n") / BLOCK)))
    lists = rows.groupBy(group, "_block").agg(F.collect_list(F.struct("_w", *names)).alias("_rows"))
    profiles = _map_lists(lists, [group, "_block"], "_rows", "profile", align)
    for _ in range(math.ceil(math.log(max(1, largest / BLOCK), BLOCK))):
        profiles = profiles.groupBy(group, F.floor(F.col("_block") / BLOCK).cast("long").alias("_block")).agg(F.collect_list("profile").alias("_rows"))
        profiles = _map_lists(profiles, [group, "_block"], "_rows", "profile", align_profiles)
    profiles = _map_lists(profiles.groupBy(group).agg(F.collect_list("profile").alias("_rows")), [group], "_rows", "profile", align_profiles)
    return _map_lists(profiles, [group], "profile", "target", lambda text: json.dumps({n: consensus(c) for n, c in json.loads(text).items()}))


def member_distances(members: DataFrame, targets: DataFrame, group: str, member: str, fields: Sequence[str]) -> DataFrame:
    """group, member and the distance of each field (``d_<field>``) and of all (``distance``) to the consensus."""
    names = list(fields)
    rows = members.join(targets, group).select(group, member, "target", *_texts(names))
    types = dict(members.dtypes)
    schema = f"{group} {types[group]}, {member} {types[member]}, distance double, " + ", ".join(f"d_{n} double" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            target = [json.loads(t) for t in batch.column(2).to_pylist()]
            by_field = [[distance(v, t[n]) for v, t in zip(batch.column(3 + i).to_pylist(), target)] for i, n in enumerate(names)]
            arrays = [batch.column(0), batch.column(1), pa.array([sum(x) for x in zip(*by_field)], pa.float64()), *(pa.array(x, pa.float64()) for x in by_field)]
            yield pa.RecordBatch.from_arrays(arrays, names=[group, member, "distance", *(f"d_{n}" for n in names)])

    return rows.mapInArrow(run, schema)


def _no_worse(a: Column, b: Column, quality: Sequence[str]) -> Column:
    """Whether a is at least b in every quality; NULL is the least."""
    out = F.lit(True)
    for q in quality:
        out &= b[q].isNull() | F.coalesce(a[q] >= b[q], F.lit(False))
    return out


def beaten(one: Column, others: Column, quality: Sequence[str]) -> Column:
    """Whether one of an array of structs is no worse in all qualities and better in one."""
    return F.exists(others, lambda o: _no_worse(o, one, quality) & ~_no_worse(one, o, quality))


def _whole_groups(rows: DataFrame, group: str, member: str, names: list[str], quality: Sequence[str]) -> DataFrame:
    """Survivors of groups of at most BLOCK members: one grouping; Python tells places in the group's list of members."""
    sent = F.transform("_rows", lambda r: F.struct(r["_id"].alias("id"), r["_trust"].alias("w"), F.array(*[r[f"t_{n}"] for n in names]).alias("t"), beaten(r["_q"], F.col("_fronts"), quality).alias("beaten")))
    packed = F.struct(F.col(member).cast("string").alias("_id"), F.col(member).alias("_member"), "_trust", *_texts(names), *[F.col(n).alias(f"v_{n}") for n in names], F.struct(*quality).alias("_q"))
    listed = rows.groupBy(group).agg(F.collect_list(packed).alias("_rows"))
    listed = listed.withColumn("_fronts", F.transform("_rows", lambda r: r["_q"])).select(group, "_rows", sent.alias("_sent"))
    kept = [(f.name, f.dataType.simpleString()) for f in listed.select(group, "_rows").schema]
    schema = ", ".join(f"{n} {t}" for n, t in kept) + ", _at array<int>"

    def choose(members: list[dict]) -> list[int | None]:
        order = sorted(range(len(members)), key=lambda i: members[i]["id"])
        targets = [consensus(profile([(m["t"][k], m["w"]) for m in members if m["t"][k] is not None])) for k in range(len(names))]
        near = [[distance(m["t"][k], targets[k]) for k in range(len(names))] for m in members]
        rank = lambda i: (members[i]["beaten"], members[i]["id"])
        first = min((i for i in order if not members[i]["beaten"]), key=lambda i: (sum(near[i]), members[i]["id"]))
        return [first, *(min((i for i in order if members[i]["t"][k] is not None), key=lambda i: (near[i][k], *rank(i)), default=None) for k in range(len(names)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = pa.array([choose(m) for m in batch.column(2).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), at], names=[group, "_rows", "_at"])

    got = listed.mapInArrow(run, schema)
    value = lambda k, field: F.when(F.col("_at")[k].isNotNull(), F.col("_rows")[F.col("_at")[k]][field])
    return got.select(group, value(0, "_member").alias("survivor"), *[value(k + 1, f"v_{n}").alias(f"best_{n}") for k, n in enumerate(names)])


def _spread_groups(rows: DataFrame, group: str, member: str, names: list[str], quality: Sequence[str]) -> DataFrame:
    """Survivors of larger groups. A group's list of qualities has one entry for each value of all but the last one."""
    targets = group_consensus(rows, group, member, names, F.col("_trust"))
    near = member_distances(rows, targets, group, member, names).dropDuplicates([group, member])
    *others, last = quality
    fronts = rows.groupBy(group, *others).agg(F.max(last).alias(last)).groupBy(group).agg(F.collect_list(F.struct(*quality)).alias("_fronts"))
    both = rows.dropDuplicates([group, member]).join(near, [group, member]).join(fronts, group)
    both = both.withColumn("_beaten", beaten(F.struct(*quality), F.col("_fronts"), quality))
    identity = F.col(member).cast("string")
    pick = F.min(F.when(~F.col("_beaten"), F.struct(F.col("distance").alias("d"), identity.alias("id"), F.col(member).alias("m"))))["m"].alias("survivor")
    best = [F.min(F.when(F.col(n).isNotNull(), F.struct(F.col(f"d_{n}").alias("d"), "_beaten", identity.alias("id"), F.col(n).alias("v"))))["v"].alias(f"best_{n}") for n in names]
    return both.groupBy(group).agg(pick, *best)


def survivors(members: DataFrame, group: str, member: str, fields: Sequence[str], quality: Sequence[str], trust: Column) -> DataFrame:
    """group, ``survivor`` and one ``best_<field>`` per field.

    ``quality`` names orderable columns, more is better; those but the last should have few values. A member is beaten
    if another is no worse in all and better in one; of those not beaten the one nearest the consensus survives, of
    equal ones the least id as text. Members given twice count twice in the vote. A field's value is the nearest to its
    consensus, of equal ones that of a member not beaten, then the least id; it is NULL only if all are. Rows without a
    group are left out, an empty table gives no rows; further columns are dropped, whatever their names. NULL fields
    do not vote, and NULL qualities are the least. Whether any group is larger than BLOCK comes to the driver.
    """
    names = list(fields)
    needed = dict.fromkeys([group, member, *names, *quality])
    rows = checkpointed(members.where(F.col(group).isNotNull()).select(*needed, trust.cast("double").alias("_trust")))
    large = rows.groupBy(group).count().where(F.col("count") > BLOCK).select(group)
    if not large.limit(1).count():
        return _whole_groups(rows, group, member, names, quality)
    whole = _whole_groups(rows.join(large, group, "left_anti"), group, member, names, quality)
    return whole.unionByName(_spread_groups(rows.join(large, group, "left_semi"), group, member, names, quality))


# --- Conflicting facts ------------------------------------------------------------------------------------------------

#: Standing of an entity's name, and qualities that rule a fact out.
NAME_STANDING = {"AUTHORITATIVE": 3, "SOURCE_ONLY": 2, "NO_AUTHORITATIVE_FAMILY_NAME": 1, "UNKNOWN": 0}
UNUSABLE = ["INVALID", "MISSING", "NOT_APPLICABLE"]
LAST_DAY = "2026-08-24"
COMPLETE_FIELDS = ["raw_value", "numeric_value", "unit", "currency"]
VOTED_FIELDS = ["raw_value", "numeric_value", "unit", "currency", "observed_on"]


def _notation(column: str) -> Column:
    return F.regexp_replace(F.upper(F.trim(F.col(column))), r"[\s-]+", "_")


def case_candidates(cases: DataFrame, facts: DataFrame, entities: DataFrame) -> DataFrame:
    """conflict_case_id, fact_id, the fact's fields, and standing, completeness and day: candidates of open cases.

    Open is a case that is not REJECTED and has no winner among its candidates. Of a repeated case the latest row
    counts, of equal ones the greatest; repeated candidates count once; candidates without a row or with an unusable
    quality are out.
    """
    state = F.struct("created_at", _notation("status").alias("status"), F.trim("winning_fact_id").alias("winner"), "candidate_fact_ids")
    one = cases.where("conflict_case_id IS NOT NULL").groupBy("conflict_case_id").agg(F.max(state).alias("c")).select("conflict_case_id", "c.status", "c.winner", F.from_json("c.candidate_fact_ids", "array<string>").alias("ids"))
    ids = F.transform("ids", lambda x: F.trim(x))
    undecided = ~F.coalesce(F.array_contains(ids, F.col("winner")), F.lit(False)) & ~F.col("status").eqNullSafe("REJECTED")
    asked = one.where(undecided).select("conflict_case_id", F.explode(F.array_distinct(ids)).alias("fact_id"))
    columns = [*dict.fromkeys(["subject_entity_id", "metric_code", *COMPLETE_FIELDS, "scale_basis", "observed_on", "quality_status"])]
    fact = facts.where("fact_id IS NOT NULL").groupBy(F.trim("fact_id").alias("fact_id")).agg(F.max(F.struct("recorded_at", *columns)).alias("f")).select("fact_id", *[f"f.{c}" for c in columns])
    usable = fact.where(~F.coalesce(_notation("quality_status").isin(UNUSABLE), F.lit(False)))
    standing_of = F.create_map(*[F.lit(x) for pair in NAME_STANDING.items() for x in pair])
    named = entities.where("entity_id IS NOT NULL").groupBy(F.trim("entity_id").alias("subject_entity_id")).agg(F.max(F.struct("updated_at", _notation("name_status").alias("s")))["s"].alias("name_status"))
    rows = asked.join(usable, "fact_id").withColumn("subject_entity_id", F.trim("subject_entity_id")).join(named, "subject_entity_id", "left")
    complete = sum((F.col(c).isNotNull().cast("int") for c in COMPLETE_FIELDS), F.lit(0))
    day = F.when(F.col("observed_on") <= F.lit(LAST_DAY).cast("date"), F.datediff("observed_on", F.lit("1900-01-01").cast("date"))).otherwise(F.lit(-(10**6)))
    return rows.select("conflict_case_id", "fact_id", *[c for c in columns if c != "quality_status"], F.coalesce(F.try_element_at(standing_of, F.col("name_status")), F.lit(0)).alias("standing"), complete.alias("completeness"), day.alias("day"))


def surviving_facts(candidates: DataFrame) -> DataFrame:
    """conflict_case_id, survivor, best_<field>: the vote's weight grows with standing, completeness and day."""
    trust = F.pow(F.lit(16.0), F.col("standing")) * F.pow(F.lit(4.0), F.col("completeness")) * (1 + F.greatest(F.col("day"), F.lit(0)) / 50000)
    return survivors(candidates, "conflict_case_id", "fact_id", VOTED_FIELDS, ["standing", "completeness", "day"], trust)
