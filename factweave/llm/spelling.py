"""Variant spellings of typed names, linked by a pigeonhole segment join.

A name is read into exact parts (what kind it is, theme, series, class) and a spelled part. Spelled parts are brought
to Latin letters and cut into k + 1 segments; two strings within k edits share a segment at a position shifted by at
most k, so an inverted index over segments finds every pair, and a banded edit distance verifies it. The exact parts
belong to the index key.

Aliases are first joined to proper names, which bounds the fan-out by the number of proper names near a spelling; the
spellings without one are joined among themselves.

Words and endings that many proper names share are learned from them: they tell theme, kind or manager. A glossary adds
what they are called in either language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave.llm import names, vocabulary
from factweave.session import checkpointed

#: Edits a spelling may be away from another.
MAX_EDITS = 2
#: Names whose index is broadcast; more are joined by a shuffle.
MAX_BROADCAST_NAMES = 100_000
#: Letters of a spelling for each edit it may be away: short names allow fewer.
LETTERS_PER_EDIT = 4
#: Longer names get no spellings with exchanged syllables: their number would grow with the square of the length.
MAX_SWAPPED = 64
#: The exact parts of a name that leaves some of them open.
OPEN = "?"
PARTS_SCHEMA = "kind string, exact string, part string, swaps int"

# A glossary of themes, kinds of organisations and words without meaning, as people write them.
THEMES = {
    "글로벌반도체": "semiconductor", "반도체": "semiconductor", "global semiconductor": "semiconductor", "semiconductor": "semiconductor", "semicon": "semiconductor", "글로벌반도": "semiconductor",
    "로봇자동화": "robotics", "로봇": "robotics", "robotics": "robotics", "robot": "robotics",
    "친환경에너지": "energy", "그린에너지": "energy", "clean energy": "energy", "green energy": "energy",
    "부동산리츠": "reits", "리츠": "reits", "reits": "reits", "reit": "reits",
    "단기채권": "short bond", "단기채": "short bond", "short-term bond": "short bond", "short term bond": "short bond",
    "물가연동": "inflation", "물가채": "inflation", "물가연동채": "inflation", "inflation-linked": "inflation", "inflation linked": "inflation",
    "국공채": "treasury", "국채": "treasury", "treasury bond": "treasury", "treasury": "treasury",
    "배당성장": "dividend", "배당": "dividend", "dividend growth": "dividend", "dividend": "dividend",
    "중소형주": "small cap", "중소형": "small cap", "small cap": "small cap", "smallcap": "small cap",
    "소비재": "consumer", "컨슈머": "consumer", "consumer goods": "consumer", "consumer": "consumer",
    "헬스케어": "healthcare", "hc": "healthcare", "healthcare": "healthcare", "health care": "healthcare",
    "인프라": "infrastructure", "soc": "infrastructure", "infrastructure": "infrastructure",
}
ORGANISATIONS = {
    "캐피탈": "capital", "캐피털": "capital", "capital": "capital", "cap": "capital",
    "인베스트먼트": "investment", "인베스트": "investment", "인베": "investment", "investment": "investment", "investments": "investment", "inv": "investment",
    "신탁": "trust", "신탁사": "trust", "트러스트": "trust", "trust": "trust",
    "투자증권": "securities", "증권": "securities", "투증": "securities", "securities": "securities", "sec": "securities",
    "저축은행": "savings bank", "저축": "savings bank", "savings bank": "savings bank", "sb": "savings bank",
    "자산운용": "asset management", "에셋운용": "asset management", "asset management": "asset management", "am": "asset management",
    "생명보험": "life insurance", "생명": "life insurance", "life insurance": "life insurance", "life": "life insurance",
    "투자신탁운용": "investment trust", "투신운용": "investment trust", "투신": "investment trust", "investment trust": "investment trust", "itm": "investment trust",
    "운용": "management",
}
THEMES, ORGANISATIONS = names.longest_first(THEMES), names.longest_first(ORGANISATIONS)
#: A short form that may stand for either kind.
OPEN_KINDS = {"management": ("asset management", "investment trust")}
FUND_WORDS = ["증권자투자신탁", "증권투자신탁", "자투자신탁", "투자신탁", "증권자", "신탁", "펀드", "fund", "etf", "trust"]
ASSET_TYPE = re.compile(r"(?<=[0-9호])[\s\-·_\[(]*(?:재간접|주식|채권|혼합)형?[\s\])]*")
CLASS = re.compile(r"(?:(?:종류|클래스|(?<![a-z])class|(?<![a-z])cl\.?)[\s\-_·.]*\(?|(?<![a-z])\(?\s*)(a-e|c-e|c-p|s-p|a|c|s)\)?\s*$")
SERIES = re.compile(r"(?:제|no\.?|series|#|nr\.?)?[\s\-_·]*([0-9]{1,3})[\s\-_·]*호?")
MANAGER = re.compile(r"(\S+?)운용(?=\s|$)")


def _swapped(part: str) -> list[str]:
    """Spellings with two neighbouring syllables exchanged."""
    if not names.HANGUL.fullmatch(part[:1] or " ") or len(part) > MAX_SWAPPED:
        return []
    return [part[:i] + part[i + 1] + part[i] + part[i + 2 :] for i in range(len(part) - 1) if part[i] != part[i + 1]]


@dataclass(frozen=True)
class Words:
    """What is known of names: words for themes and kinds of organisations, and words to leave out of products' names."""

    themes: dict[str, str]
    kinds: dict[str, str]
    others: re.Pattern

    @staticmethod
    def of(themes: dict[str, str], kinds: dict[str, str], others: Sequence[str]) -> Words:
        """The glossary and learned words; what the glossary does not know means itself, also in Latin letters."""
        spelled = lambda words, known: {x: known.get(w, w) for w in words for x in (names.latin(w), w)}
        dropped = sorted({*FUND_WORDS, *others, *map(names.latin, others)}, key=lambda w: (-len(w), w))
        pattern = re.compile("|".join(names.word_pattern(w).pattern for w in dropped))
        return Words(names.longest_first({**spelled(themes, THEMES), **THEMES}), names.longest_first({**spelled(kinds, ORGANISATIONS), **ORGANISATIONS}), pattern)


def read_organisation(alias: str, words: Words) -> list[tuple[str, str, str, int]]:
    """(kind, exact, spelled part, swaps made) for the ways to read an organisation's name."""
    text = names.without_legal(names.folded(alias))
    outside = re.sub(r"\([^)]*\)", " ", text)
    text = outside if re.search(r"[a-z가-힣]{2}", outside) else text
    text = re.sub(r"[,.]+", " ", text).strip()
    glued = re.sub(r"\s", "", text) if names.HANGUL.search(text) else text
    for where in ("end", "start"):
        rest, kind = names.pulled(glued, words.kinds, where)
        if kind is None and glued is not text:
            rest, kind = names.pulled(text, words.kinds, where)
        if kind is None and where == "end" and re.search(r"[가-힣]([a-z]+)$", glued):
            rest, kind = names.pulled(re.sub(r"([가-힣])([a-z]+)$", r"\1 \2", glued), words.kinds, "end")
        if kind is not None:
            break
    if kind is None and re.search(r"([a-z]+)([가-힣]+)$", glued):
        rest, kind = names.pulled(re.sub(r"([a-z])([가-힣])", r"\1 \2", glued), words.kinds, "end")
    if kind is None:
        rest, kind = names.pulled(glued, words.kinds)
    rest = re.sub(r"[^a-z0-9가-힣]", "", rest)
    out = []
    for one in OPEN_KINDS.get(kind, (kind or "none",)):
        out += [("ORGANIZATION", one, names.letters(rest), 0)] + [("ORGANIZATION", one, names.letters(x), 1) for x in _swapped(rest)]
    return [x for x in out if x[2]]


def _spelled(text: str, exact: str, words: Words) -> list[tuple[str, str, str, int]]:
    """Readings of what is left of a product's name: each word, and the words a missing blank may hide."""
    text = words.others.sub(" ", text)
    parts = [p for p in re.split(r"[^a-z가-힣]+", text) if len(p) > 1 or names.HANGUL.search(p)]
    spelled: dict[str, None] = {}
    for part in parts:
        spelled[part] = None
        if names.HANGUL.fullmatch(part[:1]) and len(part) > 5:  # manager and brand without a blank between
            for cut in (3, 4, 5):
                spelled[part[cut:]] = spelled[part[:-cut]] = spelled[part[:cut]] = spelled[part[-cut:]] = None
    if len(parts) > 1:
        spelled["".join(parts)] = None  # a blank within the brand
    out: list[tuple[str, str, str, int]] = []
    for part in spelled:
        out += [("PRODUCT", exact, names.letters(part), 0)] + [("PRODUCT", exact, names.letters(x), 1) for x in _swapped(part)]
    return [x for x in dict.fromkeys(out) if len(x[2]) > 1]


def read_product(alias: str, words: Words) -> list[tuple[str, str, str, int]]:
    """The same for a product; its exact parts are theme, series and class.

    A name without all three is read as OPEN: it names a product only if its brand has no other. With series and class
    but no known theme it is read with the theme "" as well.
    """
    folded = names.folded(alias)
    share = CLASS.search(folded)
    text = ASSET_TYPE.sub(" ", folded[: share.start()].strip(" -_·.,([")) if share else folded
    numbers = list(SERIES.finditer(text))
    if share and numbers:
        rest = MANAGER.sub(" ", f"{text[: numbers[-1].start()]} {text[numbers[-1].end() :]}")
        rest, theme = names.pulled(rest, words.themes)
        if theme is None:
            return _spelled(rest, f"|{numbers[-1][1].lstrip('0')}|{share[1]}", words) + _spelled(MANAGER.sub(" ", folded), OPEN, words)
        return _spelled(rest, f"{theme}|{numbers[-1][1].lstrip('0')}|{share[1]}", words)
    return _spelled(MANAGER.sub(" ", folded), OPEN, words)


def read_names(df: DataFrame, keep: str, name: str, kind: str, words: Words) -> DataFrame:
    """``keep``, kind, exact, part, swaps for every reading of every name; NULL and unreadable names have none."""
    names_df = df.select(F.col(keep), F.col(name).alias("_name"), F.upper(F.trim(F.col(kind))).alias("_kind")).where("_name IS NOT NULL")
    schema = f"{keep} {dict(names_df.dtypes)[keep]}, {PARTS_SCHEMA}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, (text, which) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                read = read_organisation(text, words) if which == "ORGANIZATION" else read_product(text, words)
                at += [i] * len(read)
                rows += read
            columns = list(zip(*rows)) or [(), (), (), ()]
            types = [pa.string(), pa.string(), pa.string(), pa.int32()]
            arrays = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types))]
            yield pa.RecordBatch.from_arrays(arrays, names=[keep, "kind", "exact", "part", "swaps"])

    return names_df.mapInArrow(run, schema)


def _segment_bounds(length: Column, i: Column, k: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i of k + 1 even segments; later ones are longer by one."""
    size = F.floor(length / (k + 1)).cast("int")
    first_longer = F.lit(k + 1) - (length - size * (k + 1))
    start = size * i + F.greatest(i - first_longer, F.lit(0)) + 1
    return start.cast("int"), (size + (i >= first_longer).cast("int")).cast("int")


def segments(strings: DataFrame, text: str, k: int = MAX_EDITS) -> DataFrame:
    """The index: every string with its k + 1 segments as (``_len``, ``_seg``, ``_piece``)."""
    n = F.length(text)

    def entry(i: Column) -> Column:
        start, size = _segment_bounds(n, i, k)
        return F.struct(n.alias("_len"), i.alias("_seg"), F.substring(F.col(text), start, size).alias("_piece"))

    return strings.select("*", F.inline(F.transform(F.sequence(F.lit(0), F.lit(k)), entry)))


def shifted_substrings(strings: DataFrame, text: str, k: int = MAX_EDITS) -> DataFrame:
    """The probes: substrings that equal some segment of a string within k edits.

    For each length within k, segment i may start at most min(i, k) before or after its own place, counted from the
    left, and the same counted from the right (the multi-match bounds). One small expression is applied to the list of
    such cases; written out for each case it would take longer to compile than to run.
    """
    n = F.length(text)
    cases = [(d, i, s) for d in range(-k, k + 1) for i in range(k + 1) for s in range(-k, k + 1) if abs(s) <= i and abs(s + d) <= k - i]

    def probe(c: Column) -> Column:
        other = n + c["d"]
        start, size = _segment_bounds(other, c["i"], k)
        at = start + c["s"]
        fits = (other > 0) & (size > 0) & (at >= 1) & (at + size - 1 <= n)
        return F.when(fits, F.struct(other.alias("_len"), c["i"].alias("_seg"), F.substring(F.col(text), at, size).alias("_piece")))

    listed = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(s).alias("s")) for d, i, s in cases])
    return strings.select("*", F.inline(F.array_distinct(F.array_compact(F.transform(listed, probe)))))


def few(strings: DataFrame) -> bool:
    """Whether an index over these (checkpointed) strings is small enough to broadcast."""
    return strings.limit(MAX_BROADCAST_NAMES + 1).count() <= MAX_BROADCAST_NAMES


def within_edits(left: DataFrame, right: DataFrame, exact: list[str], text: str, k: int = MAX_EDITS, small: bool = False) -> DataFrame:
    """All pairs of distinct strings of the same exact parts within k edits: ``exact``, ``text``, ``near``, ``edits``.

    Strings shorter than k + 1 letters have empty segments that match everything; they are joined by equality only.
    ``small`` (see ``few``) sends the index to the probes, which then need no shuffle.
    """
    lookup = segments(right.select(*exact, F.col(text).alias("near")).where(F.length("near") > k), "near", k)
    probe = shifted_substrings(left.select(*exact, text).where(F.length(text) > 0), text, k)
    # exploding outgrows the planner's estimate, which would broadcast a side of any size
    pairs = probe.join(F.broadcast(lookup) if small else lookup.hint("merge"), [*exact, "_len", "_seg", "_piece"]).select(*exact, text, "near").distinct()
    verified = pairs.withColumn("edits", F.levenshtein(F.col(text), F.col("near"), k)).where("edits >= 0")
    short = left.select(*exact, text).join(right.select(*exact, text, F.col(text).alias("near")).where(F.length("near").between(1, k)), [*exact, text]).withColumn("edits", F.lit(0))
    return verified.unionByName(short)


@F.pandas_udf(T.StringType())
def latin_letters(text: pd.Series) -> pd.Series:
    return text.map(names.letters, na_action="ignore")


def organisation_names(products: DataFrame, entities: DataFrame) -> DataFrame:
    """name: managers, issuers and organisations as they are properly called."""
    named = products.select(F.explode(F.array("asset_manager", "issuer")).alias("name")).unionByName(entities.where(F.upper(F.trim("entity_kind")) == "ORGANIZATION").select(F.col("preferred_name").alias("name")))
    return named.where("name IS NOT NULL").distinct()


def learned_words(products: DataFrame, organisations: DataFrame) -> Words:
    """The words that proper names share, with the glossary."""
    themes, others = vocabulary.common_words(products, "product_name", "asset_manager")
    return Words.of(themes, vocabulary.learned_endings(organisations, "name"), others)


def proper_names(products: DataFrame, organisations: DataFrame, words: Words) -> DataFrame:
    """kind, exact, part: the spelled parts of proper names.

    Funds are named "manager brand theme vehicle number class": the second word is the brand, and the only spelled part.
    """
    fund = products.select(F.trim("product_name").alias("name")).distinct()
    split = F.split("name", r"\s+")
    fund = fund.where(F.size(split) >= 5).select(F.concat_ws(" ", F.slice(split, 2, 100)).alias("name"), F.lit("PRODUCT").alias("type"))
    named = fund.unionByName(organisations.select("name", F.lit("ORGANIZATION").alias("type")))
    read = read_names(named, "name", "name", "type", words).where("swaps = 0")
    # what follows the brand is no spelling of it; a name with its class and series is not open
    brand = F.regexp_replace(F.lower(F.split("name", " ")[0]), "[^a-z가-힣]", "")
    own = (F.col("kind") != "PRODUCT") | ((F.col("exact") != OPEN) & (F.col("part") == latin_letters(brand)))
    return read.where(own).select("kind", "exact", "part").distinct()


def _components(links: DataFrame) -> DataFrame:
    """node, root for undirected links (a, b): the least node each reaches, by min-label with pointer jumping.

    Rounds go on until nothing changes. One count a round comes to the driver; every round is checkpointed.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = checkpointed(both)
    label = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root"))
    while True:
        near = both.join(label.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("root").alias("m"))
        step = label.join(near, "a").select("a", "root", F.least("root", "m").alias("m"))
        jump = step.select(F.col("a").alias("m"), F.col("m").alias("j"))
        new = step.join(jump, "m", "left").select("a", F.least("m", F.coalesce("j", "m")).alias("next"), "root")
        new = checkpointed(new)
        changed = new.where("next <> root").limit(1).count()
        label = new.select("a", F.col("next").alias("root"))
        if not changed:
            return label.select(F.col("a").alias("node"), "root")


def _allowed(length: Column, k: int) -> Column:
    """Edits that a name of this length may be away."""
    return F.least(F.lit(k), F.floor(length / LETTERS_PER_EDIT).cast("int"))


def link_aliases(aliases: DataFrame, products: DataFrame, entities: DataFrame, k: int = MAX_EDITS) -> DataFrame:
    """alias_id, kind, exact, root, candidates: aliases with equal kind, exact and root name the same entity.

    ``root`` is the proper name nearest in edits (an exchange of syllables counts as one); where there is none, the
    least spelling of those linked to each other. ``candidates`` is the number of proper names equally near: with more
    than one the alias is ambiguous and goes with the least of them. Aliases that can't be read, or leave theme, series
    or class of a brand with several products open, name no single entity and are left out, as are NULL and empty
    ones; equal aliases get equal roots; an empty table gives no rows; other columns are dropped, whatever their names.
    """
    exact = ["kind", "exact"]
    organisations = organisation_names(products, entities)
    words = learned_words(products, organisations)
    read = checkpointed(read_names(aliases, "alias_id", "alias", "alias_type", words))
    spellings = read.select(*exact, "part").distinct()
    proper = checkpointed(proper_names(products, organisations, words))
    index_is_small = few(proper)
    single = proper.where("kind = 'PRODUCT'").groupBy("kind", "part").agg(F.count_distinct("exact").alias("n"), F.min("exact").alias("full")).where("n = 1").select("kind", F.lit(OPEN).alias("exact"), "part", "full")
    proper = proper.withColumn("full", F.col("exact")).unionByName(single)
    near = within_edits(spellings, proper, exact, "part", k, index_is_small).join(proper.withColumnRenamed("part", "near"), [*exact, "near"])
    scored = read.join(near, [*exact, "part"]).withColumn("cost", F.col("edits") + F.col("swaps")).where(F.col("cost") <= _allowed(F.greatest(F.length("near"), F.length("part")), k))
    least = scored.groupBy("alias_id", "kind", "full", "near").agg(F.min("cost").alias("cost"))
    level = least.groupBy("alias_id", "cost").agg(F.min(F.struct("kind", "full", "near")).alias("b"), F.count(F.lit(1)).cast("int").alias("candidates"))
    best = level.groupBy("alias_id").agg(F.min(F.struct("cost", "b", "candidates")).alias("l"))
    best = checkpointed(best.select("alias_id", "l.b.kind", F.col("l.b.full").alias("exact"), F.col("l.b.near").alias("root"), "l.candidates"))

    left = read.where((F.col("exact") != OPEN) & ~F.startswith("exact", F.lit("|"))).join(best.select("alias_id"), "alias_id", "left_anti")
    own = left.where("swaps = 0").groupBy("alias_id").agg(F.max(F.struct(F.length("part"), "kind", "exact", "part")).alias("o")).select("alias_id", "o.kind", "o.exact", "o.part")
    own = checkpointed(own)
    strings = own.select(*exact, "part").distinct()
    probes = left.join(own.select("alias_id"), "alias_id").select(*exact, "part").distinct()
    node = lambda part: F.concat_ws("\0", "kind", "exact", part)
    pairs = within_edits(probes, strings, exact, "part", k, few(own))
    first = left.join(pairs, [*exact, "part"]).where(F.col("edits") + F.col("swaps") <= _allowed(F.greatest(F.length("near"), F.length("part")), k)).select("alias_id", *exact, "near")
    links = first.join(own.select("alias_id", "part"), "alias_id").where("part <> near").select(node(F.col("part")).alias("a"), node(F.col("near")).alias("b"))
    roots = _components(links)
    rest = own.withColumn("node", node(F.col("part"))).join(roots, "node", "left").select("alias_id", *exact, F.coalesce(F.element_at(F.split("root", "\0"), -1), F.col("part")).alias("root"), F.lit(0).alias("candidates"))
    return best.unionByName(rest)


def same_entity_pairs(linked: DataFrame) -> DataFrame:
    """alias_id_1 < alias_id_2 of aliases that name the same entity; the pairs are the result asked for."""
    keys = ["kind", "exact", "root"]
    a = linked.select(*keys, F.col("alias_id").alias("alias_id_1"))
    b = linked.select(*keys, F.col("alias_id").alias("alias_id_2"))
    return a.join(b, keys).where("alias_id_1 < alias_id_2").select("alias_id_1", "alias_id_2").distinct()
