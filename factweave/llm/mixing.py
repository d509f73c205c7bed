"""Sources mixed to target weights by Pfair scheduling.

The largest selection is taken in which every source has its target share of all tokens and no document is used more
often than its source allows. Each source is a stream of blocks; block j of a source of weight w is released at slot
floor(j / w) and due at ceil((j + 1) / w). Earliest deadline first interleaves the blocks, so at every slot each source
is within one block of its target. The schedule repeats after the least common denominator of the weights and is
computed once.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.session import checkpointed

#: Tokens of a block of the schedule.
BLOCK_TOKENS = 8192
#: Slots after which a schedule must repeat; weights that need more are refused, not rounded.
MAX_PERIOD = 1_000_000
#: Documents of a source that are sorted in one task for running sums, on average.
BUCKET_ROWS = 50_000


def notation(source: Column) -> Column:
    """One notation of a source's name."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s-]+", "_")


def quotas(shares: dict[str, Fraction]) -> tuple[int, dict[str, int]]:
    """Slots of a period and each source's number of them, exactly; an error where the period is too long."""
    period = math.lcm(*(s.denominator for s in shares.values())) if shares else 1
    if period > MAX_PERIOD:
        raise ValueError(f"the shares repeat only after {period} slots, more than {MAX_PERIOD}: give rounder ones")
    return period, {k: int(s * period) for k, s in shares.items()}


def schedule(period: int, slots_of: dict[str, int]) -> list[str]:
    """The source of each slot of a period: earliest deadline first among released blocks."""
    waiting = [(0, 0, math.ceil(Fraction(period, q)), k) for k, q in sorted(slots_of.items()) if q]  # release, j, deadline
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, j, deadline, k = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, k, j))
        deadline, k, j = heapq.heappop(ready)
        if deadline <= slot:
            raise AssertionError(f"{k} misses slot {deadline}")
        out.append(k)
        if j + 1 < slots_of[k]:
            heapq.heappush(waiting, ((j + 1) * period // slots_of[k], j + 1, -(-(j + 2) * period // slots_of[k]), k))
    return out


@dataclass(frozen=True)
class Quota:
    source: str
    available: int
    wanted: int
    passes: int
    rest: int


def plan(available: dict[str, int], targets: dict[str, tuple[Fraction, int]]) -> list[Quota]:
    """What each source gives to the largest selection with the target shares.

    Sources without tokens or weight can't take part; the shares of the others are scaled to 1.
    """
    part = {k: share for k, (share, repeats) in targets.items() if share > 0 and repeats > 0 and available.get(k, 0) > 0}
    whole = sum(part.values())
    part = {k: s / whole for k, s in part.items()}
    total = min((Fraction(available[k] * targets[k][1]) / s for k, s in part.items()), default=Fraction(0))
    out = []
    for k, s in sorted(part.items()):
        wanted = int(total * s)
        out.append(Quota(k, available[k], wanted, wanted // available[k], wanted % available[k]))
    return out


def _in_order(docs: DataFrame, buckets: int) -> DataFrame:
    """docs with ``start``: tokens of the source's documents before this one, in the order of bucket, hash and id.

    Sums by bucket first, then within buckets, so no source is sorted in one task.
    """
    hashed = docs.withColumn("_h", F.xxhash64("doc_id", "_copy")).withColumn("_bucket", F.pmod("_h", F.lit(buckets)))
    sums = hashed.groupBy("source", "_bucket").agg(F.sum("tokens").alias("_sum"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = sums.select("source", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("source", "_bucket").orderBy("_h", "doc_id", "_copy").rowsBetween(Window.unboundedPreceding, -1)
    ordered = hashed.withColumn("_inner", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    return ordered.join(offset, ["source", "_bucket"]).withColumn("start", F.col("_before") + F.col("_inner")).drop("_before", "_inner", "_bucket")


def _fillers(docs: DataFrame, give: list[Quota]) -> tuple[list[tuple[str, int, int]], dict[str, int]]:
    """(source, tokens, start) of later documents that fill the gap before each source's cut, and the ends of what is whole.

    Documents that end within the rest are taken whole; the next one does not fit. Of each size that fits into the gap
    one later document is a candidate, so the sizes, fewer than the tokens of that one document, are all that reaches
    the driver; the largest that still fits is taken first and lies where the one before it ends.
    """
    rests = F.create_map(*[F.lit(x) for q in give for x in (q.source, q.rest)])
    sided = docs.withColumn("_left", F.try_element_at(rests, F.col("source")))
    inside = F.col("start") + F.col("tokens") <= F.col("_left")
    taken = {q.source: 0 for q in give} | {r["source"]: r["n"] for r in sided.where(inside).groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    gaps = {q.source: q.rest - taken[q.source] for q in give}
    gap = F.try_element_at(F.create_map(*[F.lit(x) for k, g in gaps.items() for x in (k, g)]), F.col("source"))
    sizes = sided.where(~inside & (F.col("tokens") <= gap)).select("source", "tokens").distinct().collect()
    out, at = [], dict(taken)
    for r in sorted(sizes, key=lambda r: (r["source"], -r["tokens"])):
        if r["tokens"] <= gaps[r["source"]]:
            gaps[r["source"]] -= r["tokens"]
            out.append((r["source"], r["tokens"], at[r["source"]]))
            at[r["source"]] += r["tokens"]
    return out, taken


def mixture(sized: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, source, use, tokens, slot, offset: one row for each use of a document, to be read by slot and offset.

    ``sized`` has doc_id, source, tokens. Documents without tokens and those of other sources are left out; a document
    given twice counts as two; an empty table gives no rows. Only the sources' totals and sizes below one document's
    reach the driver; the targets are a small table. Shares with a period of over MAX_PERIOD slots are an error.
    """
    wanted = {}
    for r in targets.select(notation(F.col("source")).alias("source"), "target_share", "max_repeats").dropna().collect():
        wanted[r["source"]] = (Fraction(str(r["target_share"])), int(r["max_repeats"]))
    docs = sized.select("doc_id", notation(F.col("source")).alias("source"), F.col("tokens").cast("bigint").alias("tokens")).where(F.col("source").isin(list(wanted)) & (F.col("tokens") > 0))
    copies = docs.groupBy("doc_id", "source", "tokens").agg(F.count(F.lit(1)).alias("_n"))
    docs = checkpointed(copies.select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1).cast("bigint"), "_n")).alias("_copy")))
    totals = docs.groupBy("source").agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    available = {r["source"]: r["n"] for r in totals}
    docs = checkpointed(_in_order(docs, max(1, math.ceil(max((r["rows"] for r in totals), default=0) / BUCKET_ROWS))))
    give = plan(available, wanted)
    spark = sized.sparkSession
    whole = sum((wanted[q.source][0] for q in give), Fraction(0))
    period, slots = quotas({q.source: wanted[q.source][0] / whole for q in give})
    places: dict[str, list[int]] = {q.source: [] for q in give}
    for slot, k in enumerate(schedule(period, slots) if slots else []):
        places[k].append(slot)

    chosen, _ = _fillers(docs, give) if give else ([], {})
    quota = F.broadcast(spark.createDataFrame([(q.source, q.available, q.passes, q.rest) for q in give], "source string, _available bigint, _passes int, _rest bigint"))
    rows = docs.join(quota, "source")
    inside = F.col("start") + F.col("tokens") <= F.col("_rest")
    whole_uses = F.col("_passes") + inside.cast("int")
    used = rows.where(whole_uses > 0).select("doc_id", "source", "tokens", "start", "_available", F.explode(F.sequence(F.lit(1), whole_uses)).alias("use"))
    # one document of a filler's size: the first after the cut
    filler = F.broadcast(spark.createDataFrame(chosen, "source string, tokens bigint, _at bigint"))
    first = rows.where(~inside).join(filler, ["source", "tokens"]).groupBy("source", "tokens", "_at", "_available", "_passes").agg(F.min(F.struct("start", "doc_id"))["doc_id"].alias("doc_id"))
    used = used.unionByName(first.select("doc_id", "source", "tokens", F.col("_at").alias("start"), "_available", (F.col("_passes") + 1).alias("use")))
    position = (F.col("use") - 1) * F.col("_available") + F.col("start")
    block = F.floor(position / block_tokens)
    table = F.broadcast(spark.createDataFrame([(k, p) for k, p in places.items()], "source string, _slots array<int>"))
    placed = used.withColumn("_block", block).withColumn("offset", F.pmod(position, F.lit(block_tokens).cast("bigint"))).join(table, "source")
    n = F.size("_slots").cast("bigint")
    slot = F.floor(F.col("_block") / n) * period + F.element_at("_slots", (F.pmod(F.col("_block"), n) + 1).cast("int"))
    return placed.select("doc_id", "source", "use", "tokens", slot.cast("bigint").alias("slot"), "offset")


def shares_reached(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, tokens, actual_share, documents, most_uses for every target, reached or not."""
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count_distinct("doc_id").alias("documents"), F.max("use").alias("most_uses"))
    total = got.agg(F.sum("tokens")).scalar()
    rows = targets.select(notation(F.col("source")).alias("source"), "target_share", "max_repeats").join(got, "source", "left").withColumn("_total", total)
    return rows.select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), (F.coalesce("tokens", F.lit(0)) / F.col("_total")).alias("actual_share"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"))
