"""Names in requests resolved to entities: exact tiers, ambiguity, near matches, identifiers."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of near matching.
ACCEPT, MARGIN, LEAST, MAX_CANDIDATES, MIN_LENGTH, MIN_LENGTH_PRODUCT, FRAGMENT = 0.9, 0.03, 0.55, 10, 3, 5, 3
#: Fixed values that change no result: mentions of a task, buckets of characters, the most that rounding adds.
PART, BUCKETS, ROUNDING = 256, 64, 1e-6


def exact_tiers(mentions: DataFrame, mention: str, tiers: Sequence[DataFrame]) -> DataFrame:
    """mention, entity_id, tier: the matches of the first tier that has any. Tiers are frames of (key, entity_id)."""
    keyed = None
    for i, t in enumerate(tiers):
        part = t.select(F.col("key").alias(mention), "entity_id", F.lit(i + 1).alias("tier"))
        keyed = part if keyed is None else keyed.unionByName(part)
    hits = mentions.select(mention).distinct().join(keyed.distinct(), mention)
    first = hits.groupBy(mention).agg(F.min("tier").alias("tier"))
    return hits.join(first, [mention, "tier"]).select(mention, "entity_id", "tier").distinct()


def resolution(mentions: DataFrame, mention: str, hits: DataFrame) -> DataFrame:
    """mention, candidates, status (RESOLVED, AMBIGUOUS, UNRESOLVED) and the entity if there is one only."""
    counted = hits.groupBy(mention).agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("_e"))
    rows = mentions.select(mention).distinct().join(counted, mention, "left")
    n = F.coalesce("n", F.lit(0))
    return rows.select(mention, n.alias("candidates"), F.when(n == 1, "RESOLVED").when(n > 1, "AMBIGUOUS").otherwise("UNRESOLVED").alias("status"), F.when(n == 1, F.col("_e")).alias("entity_id"))


def _bags(names: Sequence[str]) -> np.ndarray:
    """Characters of each name counted in buckets."""
    out = np.zeros((len(names), BUCKETS), np.uint16)
    for i, name in enumerate(names):
        for c in name:
            out[i, ord(c) * 2654435761 % 2**32 % BUCKETS] += 1
    return out


def _common(masks: dict[str, int], length: int, name: str) -> int:
    """Length of the longest common subsequence with the text that the masks hold: no fewer characters than blocks match."""
    v = whole = (1 << length) - 1
    for c in name:
        u = v & masks.get(c, 0)
        v = (v + u | v - u) & whole
    return length - v.bit_count()


def _best(mention: str, names: Sequence[str], entities: Sequence[str], lengths: np.ndarray, bags: np.ndarray, allowed: np.ndarray) -> list[tuple[str, float]]:
    """The likest entities, in order. Names are tried by an upper bound of likeness, until none can be among the first."""
    near = np.flatnonzero(allowed & (2 * np.minimum(lengths, len(mention)) / (lengths + len(mention)) >= LEAST - ROUNDING))
    bounds = 2 * np.minimum(bags[near], _bags([mention])).sum(1) / (lengths[near] + len(mention))
    masks: dict[str, int] = {}
    for i, c in enumerate(mention):
        masks[c] = masks.get(c, 0) | 1 << i
    found: dict[str, float] = {}
    least = LEAST
    for at in np.argsort(-bounds, kind="stable"):
        if bounds[at] < least - ROUNDING:
            break
        name, e = names[near[at]], entities[near[at]]
        total = len(mention) + len(name)
        if 2 * _common(masks, len(mention), name) / total < max(least, found.get(e, 0)) - ROUNDING:
            continue
        ratio = round(SequenceMatcher(None, mention, name, autojunk=False).ratio(), 6)
        if ratio >= least and ratio > found.get(e, 0):
            found[e] = ratio
            if len(found) >= MAX_CANDIDATES:
                least = sorted(found.values())[-MAX_CANDIDATES]
    return sorted(found.items(), key=lambda x: (-x[1], x[0]))[:MAX_CANDIDATES]


def near_matches(mentions: DataFrame, mention: str, names: DataFrame, least_length: int = MIN_LENGTH, kinds: dict[str, str] | None = None) -> DataFrame:
    """mention, entity_id, likeness, status: entities with the mention's first or last three characters anywhere in a name.

    Names (name, entity_id) are normalized before; an entity may have several and counts by the likest. Names whose
    endings tell different kinds are no match. The best is RESOLVED if it is like enough and ahead of the next entity by the
    margin; otherwise at most ten CANDIDATE rows remain.
    """
    ends = F.array_distinct(F.array(F.substring(mention, 1, FRAGMENT), F.right(F.col(mention), F.lit(FRAGMENT))))
    left = mentions.select(mention).distinct().where(F.length(mention) >= max(least_length, FRAGMENT)).select(mention, F.explode(ends).alias("_f"))
    parts = left.groupBy("_f").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("_parts"))
    asked = left.join(parts, "_f").select(mention, "_f", F.pmod(F.xxhash64(mention), "_parts").cast("int").alias("_part"))
    fragments = lambda n: F.when(F.length(n) >= FRAGMENT, F.transform(F.sequence(F.lit(1), F.length(n) - (FRAGMENT - 1)), lambda i: F.substring(n, i, F.lit(FRAGMENT)))).otherwise(F.array().cast("array<string>"))
    known = names.where(F.length("name") > 0).groupBy("entity_id").agg(F.collect_set("name").alias("_names"))
    known = known.select("entity_id", "_names", F.explode(F.array_distinct(F.flatten(F.transform("_names", fragments)))).alias("_f"))
    known = known.join(parts, "_f").select("_f", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), "entity_id", "_names")
    endings = sorted((kinds or {}).items(), key=lambda x: -len(x[0]))

    def likest(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(l) and len(r):
            label, owner = zip(*[(n, e) for e, ns in zip(r["entity_id"], r["_names"]) for n in ns])
            kind = lambda n: next((k for end, k in endings if n.endswith(end)), "")
            lengths, bags, ends_in = np.array([len(n) for n in label]), _bags(label), np.array([kind(n) for n in label])
            for m in l[mention]:
                k = kind(m)
                rows += [(m, e, x) for e, x in _best(m, label, owner, lengths, bags, (ends_in == k) | (ends_in == "") | (k == ""))]
        return pd.DataFrame(rows, columns=[mention, "entity_id", "likeness"])

    scored = asked.groupBy("_f", "_part").cogroup(known.groupBy("_f", "_part")).applyInPandas(likest, f"`{mention}` string, entity_id string, likeness double").distinct()
    order = F.array_sort(F.collect_list(F.struct((-F.col("likeness")).alias("l"), "entity_id")))
    listed = scored.groupBy(mention).agg(F.slice(order, 1, MAX_CANDIDATES).alias("_all"))
    best, second = F.try_element_at("_all", F.lit(1))["l"], F.try_element_at("_all", F.lit(2))["l"]
    sure = (-best >= ACCEPT) & (second.isNull() | (-best + second >= MARGIN))
    rows = listed.withColumn("_sure", sure).select(mention, "_sure", F.posexplode("_all").alias("_i", "c"))
    return rows.where(~F.col("_sure") | (F.col("_i") == 0)).select(mention, "c.entity_id", (-F.col("c.l")).alias("likeness"), F.when(F.col("_sure"), "RESOLVED").otherwise("CANDIDATE").alias("status"))


def by_identifiers(rows: DataFrame, key: str, schemes: Sequence[tuple[Sequence[str], DataFrame]]) -> DataFrame:
    """key, entity_id, status from several identifiers in order of trust.

    A scheme is (columns, frame of those columns and entity_id). All that match must agree, else AMBIGUOUS. Each
    identifier is brought to its least and greatest entity before the join, so a shared one multiplies no rows.
    """
    hits = None
    for columns, table in schemes:
        ends = table.dropna(subset=[*columns, "entity_id"]).groupBy(*columns).agg(F.min("entity_id").alias("_least"), F.max("entity_id").alias("_most"))
        part = rows.dropna(subset=list(columns)).select(key, *columns).distinct().join(ends, list(columns)).select(key, "_least", "_most")
        hits = part if hits is None else hits.unionByName(part)
    agreed = hits.groupBy(key).agg(F.min("_least").alias("_e"), F.max("_most").alias("_m"))
    joined = rows.select(key).distinct().join(agreed, key, "left")
    one = F.col("_e") == F.col("_m")
    return joined.select(key, F.when(one, F.col("_e")).alias("entity_id"), F.when(one, "RESOLVED").when(F.col("_e").isNotNull(), "AMBIGUOUS").otherwise("UNRESOLVED").alias("status"))


def name_key(name: Column) -> Column:
    """A lookup key in the JVM: lower case, no blanks, legal forms dropped."""
    bare = F.regexp_replace(F.lower(F.trim(name)), r"\(주\)|㈜|주식회사|\b(co|inc|ltd|corp|plc)\b\.?", "")
    return F.regexp_replace(bare, r"[\s.,]+", "")


def lookup_keys(name: Column, suffixes: Sequence[str]) -> Column:
    """The name's key and the keys without one of the suffixes, each once: what a lookup tries."""
    whole = name_key(name)
    cut = [F.when(F.endswith(whole, F.lit(s)) & (F.length(whole) > len(s)), F.substring(whole, F.lit(1), F.length(whole) - len(s))) for s in suffixes]
    return F.array_distinct(F.array_compact(F.array(F.nullif(whole, F.lit("")), *cut)))


def in_role(hits: DataFrame, relations: DataFrame, relation: str) -> DataFrame:
    """Hits that are targets of a relation: a manager's name binds to managers only."""
    targets = relations.where(F.col("relation") == relation).select(F.col("object").alias("entity_id")).distinct()
    return hits.join(targets, "entity_id", "left_semi")


def with_open_cases(hits: DataFrame, mention: str, cases: DataFrame, closed: Sequence[str] = ("RESOLVED", "REJECTED")) -> DataFrame:
    """hits and the candidates (a JSON list) of collisions still open for the mention, so that they show as ambiguous."""
    still = cases.where(~F.upper(F.trim("status")).isin(list(closed)) | F.col("status").isNull())
    found = still.select(F.col("key").alias(mention), F.explode(F.from_json("candidates", "array<string>")).alias("entity_id"))
    return hits.select(mention, "entity_id").unionByName(found.join(hits.select(mention).distinct(), mention, "left_semi")).distinct()


def exchange_ticker(text: Column) -> tuple[Column, Column, Column]:
    """(ticker, exchange, bound) of "KRX:005930", "AAPL.O" or "005930". A bare foreign ticker names no one security."""
    plain = F.upper(F.trim(text))
    before, after = F.regexp_extract(plain, r"^([A-Z]+):([A-Z0-9]+)$", 1), F.regexp_extract(plain, r"^([A-Z0-9]+)\.([A-Z]{1,3})$", 2)
    exchange = F.coalesce(F.nullif(before, F.lit("")), F.nullif(after, F.lit("")))
    ticker = F.regexp_replace(plain, r"^[A-Z]+:|\.[A-Z]{1,3}$", "")
    return ticker, exchange, exchange.isNotNull() | ticker.rlike("^[0-9A-Z]{6}$") & ticker.rlike("[0-9]")


def compatible_kinds(mention: Column, name: Column, kinds: Sequence[str]) -> Column:
    """Whether two organisation names end in the same kind, or one of them in none."""
    of = lambda c: F.coalesce(*[F.when(F.endswith(name_key(c), F.lit(k)), F.lit(k)) for k in sorted(kinds, key=len, reverse=True)])
    return F.coalesce(of(mention) == of(name), F.lit(True))


def integrated_issuers(securities: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, conflicts) of securities (security_id, ticker, name) and companies (issuer_code, ticker, name).

    A ticker of several issuers, and a security whose ticker and name tell different issuers, is a conflict; else the
    ticker decides, then the name's key. Shared tickers and keys are reduced before the join.
    """
    def keyed(column: Column) -> DataFrame:
        return companies.select(column.alias("_k"), "issuer_code").where("_k IS NOT NULL AND issuer_code IS NOT NULL").groupBy("_k").agg(F.min("issuer_code").alias("_least"), F.max("issuer_code").alias("_most"))

    by_ticker, by_name = keyed(F.upper(F.trim("ticker"))), keyed(F.nullif(name_key(F.col("name")), F.lit("")))
    rows = securities.select("security_id", F.upper(F.trim("ticker")).alias("_t"), F.nullif(name_key(F.col("name")), F.lit("")).alias("_n")).distinct()
    rows = rows.join(by_ticker.select(F.col("_k").alias("_t"), F.col("_least").alias("_t_least"), F.col("_most").alias("_t_most")), "_t", "left")
    rows = rows.join(by_name.select(F.col("_k").alias("_n"), F.col("_least").alias("_n_least"), F.col("_most").alias("_n_most")), "_n", "left")
    ticker, name = F.when(F.col("_t_least") == F.col("_t_most"), F.col("_t_least")), F.when(F.col("_n_least") == F.col("_n_most"), F.col("_n_least"))
    found = rows.groupBy("security_id").agg(F.bool_or(F.coalesce(F.col("_t_least") != F.col("_t_most"), F.lit(False))).alias("_shared"), F.min(ticker).alias("_a"), F.max(ticker).alias("_b"), F.min(name).alias("_c"), F.max(name).alias("_d"))
    least, most = F.least("_a", "_c"), F.greatest("_b", "_d")
    reason = F.when(F.col("_shared") & F.col("_a").isNull(), "SHARED_TICKER").when(least != most, "DIFFERENT_ISSUERS")
    told = found.withColumn("reason", reason)
    links = told.where("reason IS NULL").select("security_id", F.coalesce("_a", "_c").alias("issuer_code")).where("issuer_code IS NOT NULL")
    return links, told.where("reason IS NOT NULL").select("security_id", "reason")
