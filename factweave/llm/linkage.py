"""Securities linked to their issuers without a common key, by collective graph linkage.

Mentions (a name and a code as delivered) and companies are nodes. Shared attributes (code, whole name, letter grams of
the name within a line of business) make candidate edges, weighted by how rare the attribute is among companies.
Meta-blocking keeps, for each mention, the edges near its heaviest. Edges are scored by name and code, then the scores
are refined with those of their neighbours, the edges to the same company in the same fund and in all funds, until
they are stable. The best edge of a mention is its link if its stable score is high enough; that score, brought to
0..1, is the link's confidence.

Lines of business are endings that many companies' names share, learned from the companies, and a glossary of what they
are called in either language. A name without one is compared as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.llm import names
from factweave.llm.vocabulary import learned_endings
from factweave.session import checkpointed

#: Companies whose attributes are broadcast; more are joined by a shuffle.
MAX_BROADCAST_COMPANIES = 50_000
#: Meta-blocking keeps edges of at least this part of the heaviest edge of their mention.
KEEP_WEIGHT = 0.4
#: Pull of the same fund's and of all funds' edges to a company; their sum is below 1, so scores converge.
FUND_PULL, ALL_PULL = 0.05, 0.01
#: Likeness from which a name counts at all; what a name and a code add to an edge's own score, of 1 in all.
NAME_FROM, NAME_PART, CODE_PART = 0.4, 0.6, 0.4
#: Least confidence of a link: about one letter in five wrong, or an equal code and half of the name.
MIN_CONFIDENCE = 0.36

# A glossary of lines of business as names write them, share classes and marks of what is no listed share.
SECTORS = {
    "화학": "화학", "케미칼": "화학", "chemical": "화학", "chemicals": "화학", "chem": "화학",
    "전자": "전자", "일렉": "전자", "electronics": "전자", "elec": "전자",
    "소프트": "소프트", "소프트웨어": "소프트", "software": "소프트", "soft": "소프트",
    "텔레콤": "텔레콤", "통신": "텔레콤", "telecom": "텔레콤", "tel": "텔레콤",
    "해운": "해운", "상선": "해운", "쉬핑": "해운", "shipping": "해운",
    "제약": "제약", "약품": "제약", "pharma": "제약", "pharm": "제약",
    "바이오": "바이오", "바이오텍": "바이오", "biotech": "바이오", "bio": "바이오",
    "금속": "금속", "메탈": "금속", "금속공업": "금속", "metal": "금속",
    "정밀": "정밀", "정밀공업": "정밀", "precision": "정밀", "prec": "정밀",
    "홀딩스": "홀딩스", "지주": "홀딩스", "holdings": "홀딩스", "hd": "홀딩스",
    "건설": "건설", "건설산업": "건설", "construction": "건설", "e&c": "건설",
    "물류": "물류", "로지스": "물류", "logistics": "물류", "logis": "물류",
    "식품": "식품", "푸드": "식품", "foods": "식품", "f&b": "식품",
    "에너지": "에너지", "에너": "에너지", "energy": "에너지",
}
SECTORS = names.longest_first(SECTORS)
SHARE_CLASS = re.compile(r"[\s\-(]*(?:(?P<preferred>[1-9]?\s*우선?주?\s*b?)|보통주?|신주|구주)\)?\s*$")
UNLISTED = re.compile(r"비상장|unlisted|private placement|제3시장")
#: Codes of other instruments: a foreign ticker with its market, cash, futures.
OTHER_CODE = re.compile(r"[A-Z]{1,6}[. ][A-Z]{2}|CASH.*|FU\d+")
DOMESTIC_CODE = re.compile(r"A?(\d{1,6})|KR7(\d{6})\d{3}")
NODE_SCHEMA = "code string, stem string, swaps array<string>, sector string, attributes array<string>"
#: Longer names get no spellings with exchanged syllables: their number would grow with the square of the length.
MAX_SWAPPED = 64


def read_code(code: str | None) -> tuple[str | None, bool]:
    """Six digits of the common share, and whether the code belongs to another instrument."""
    code = re.sub(r"\s+", " ", names.folded(code or "")).upper()
    found = DOMESTIC_CODE.fullmatch(code)
    if found:
        digits = (found[1] or found[2]).zfill(6)
        return digits[:5] + "0" if digits[5] in "5790KLM" or digits[5] != "0" else digits, False
    return None, bool(OTHER_CODE.fullmatch(code))


def _ends_with_sector(text: str, sectors: dict[str, str]) -> bool:
    return names.pulled(text, sectors, "end")[1] is not None


def read_security(name: str | None, code: str | None, sectors: dict[str, str] = SECTORS) -> list[tuple[str | None, str, list[str], str, list[str]]]:
    """(code, stem, stems with exchanged syllables, sector, attributes) for the ways to read a name.

    What is no listed share has none. A name without a known line of business is read as a whole, with the sector "",
    and, if it may end in one cut short, that way too.
    """
    digits, other = read_code(code)
    text = names.without_legal(names.folded(name or "")).strip(" .")
    if other or UNLISTED.search(text):
        return []
    share = SHARE_CLASS.search(text)
    if share and (_ends_with_sector(text[: share.start()], sectors) or share[0][:1] in " -("):
        text = text[: share.start()]
    text = re.sub(r"[\"']", "", text).strip(" .,-")
    found, sector = names.pulled(text, sectors, "end")
    parts = [(found, sector or "")]
    if sector is None and names.HANGUL.search(text):
        glued = re.sub(r"\s", "", text)
        for size in (2, 1):  # a line of business cut short
            cut = [x for x in dict.fromkeys(sectors.values()) if len(glued) > size + 1 and x != glued[-size:] and x.startswith(glued[-size:])]
            if cut:
                parts.append((glued[:-size], cut[0]))
                break
    out = []
    for rest, kind in parts:
        rest = re.sub(r"[^a-z0-9가-힣]", "", rest)
        stem = names.letters(rest)
        swaps = []
        if names.HANGUL.fullmatch(rest[:1]) and len(rest) <= MAX_SWAPPED:
            swaps = [names.letters(rest[:i] + rest[i + 1] + rest[i] + rest[i + 2 :]) for i in range(len(rest) - 1)]
        attributes = [f"c:{digits}"] if digits else []
        if stem:
            padded = f"^{stem}$"
            grams = {padded[i : i + 4] for i in range(max(1, len(padded) - 3))}
            for swap in swaps:
                grams |= {swap[i : i + 6] for i in range(max(1, len(swap) - 5))} if len(swap) > 5 else set()
            attributes += [f"n:{kind}:{stem}", *sorted(f"g:{kind}:{g}" for g in grams)]
        if attributes:
            out.append((digits, stem, swaps, kind, attributes))
    return out


def read_nodes(df: DataFrame, keep: list[str], name: str, code: str, sectors: dict[str, str]) -> DataFrame:
    """``keep`` and the attributes of every reading of every node that may be a listed share; others are left out."""
    types = dict(df.dtypes)
    source = df.select(*keep, F.col(name).alias("_name"), F.col(code).alias("_code"))
    schema = ", ".join(f"{c} {types[c]}" for c in keep) + ", " + NODE_SCHEMA
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, (a, b) in enumerate(zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist())):
                read = read_security(a, b, sectors)
                at += [i] * len(read)
                rows += read
            columns = list(zip(*rows)) or [()] * 5
            types_out = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.list_(pa.string())]
            arrays = [*(batch.column(i).take(pa.array(at, pa.int64())) for i in range(n)), *(pa.array(c, t) for c, t in zip(columns, types_out))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "code", "stem", "swaps", "sector", "attributes"])

    return source.mapInArrow(run, schema)


def candidate_edges(nodes: DataFrame, companies: DataFrame, small: bool) -> DataFrame:
    """node, issuer_code: the graph after meta-blocking.

    An attribute's weight is the logarithm of the companies' number over those that have it. Companies are few, so a
    node's edges are too, whatever number of nodes there is.
    """
    company = companies.select("issuer_code", F.explode("attributes").alias("attribute")).distinct()
    total = companies.agg(F.count_distinct("issuer_code")).scalar()
    df = company.groupBy("attribute").agg(F.count("*").alias("df"))
    weight = F.when(F.col("attribute").startswith("c:"), 4.0).when(F.col("attribute").startswith("n:"), 3.0).otherwise(1.0)
    index = company.join(df, "attribute").withColumn("n", total).select("attribute", "issuer_code", (weight * F.log(1 + F.col("n") / F.col("df"))).alias("w"))
    index = F.broadcast(index) if small else index.hint("merge")
    edges = nodes.select("node", F.explode("attributes").alias("attribute")).join(index, "attribute").groupBy("node", "issuer_code").agg(F.sum("w").alias("weight"))
    heaviest = edges.withColumn("top", F.max("weight").over(Window.partitionBy("node")))
    return heaviest.where(F.col("weight") >= KEEP_WEIGHT * F.col("top")).select("node", "issuer_code")


def _code_likeness(a, b):
    """1 for equal codes, 0.5 for one digit changed or two neighbours exchanged, else 0; NULL if one is missing."""
    wrong = F.size(F.filter(F.sequence(F.lit(1), F.lit(6)), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))
    exchanged = (wrong == 2) & (F.array_join(F.array_sort(F.split(a, "")), "") == F.array_join(F.array_sort(F.split(b, "")), ""))
    return F.when(a.isNull() | b.isNull(), None).when(a == b, 1.0).when((wrong <= 1) | exchanged, 0.5).otherwise(0.0)


def scored_edges(edges: DataFrame, nodes: DataFrame, companies: DataFrame, small: bool) -> DataFrame:
    """node, issuer_code, base: what an edge's own names and codes say, from 0 to 1."""
    c = companies.select("issuer_code", F.col("stem").alias("c_stem"), F.col("sector").alias("c_sector"), F.col("code").alias("c_code"))
    both = edges.join(nodes.select("node", "stem", "swaps", "sector", "code"), "node").join(F.broadcast(c) if small else c, "issuer_code")
    away = F.least(F.levenshtein("stem", "c_stem"), F.coalesce(F.array_min(F.transform("swaps", lambda s: F.levenshtein(s, F.col("c_stem")) + 1)), F.lit(2**30)))
    likeness = 1 - away / F.greatest(F.length("stem"), F.length("c_stem"), F.lit(1))
    rows = both.where(F.col("sector") == F.col("c_sector")).withColumn("likeness", likeness).where(F.col("likeness") > NAME_FROM)
    base = NAME_PART * (F.col("likeness") - NAME_FROM) / (1 - NAME_FROM) + CODE_PART * F.coalesce(_code_likeness(F.col("code"), F.col("c_code")), F.lit(0.0))
    return rows.groupBy("node", "issuer_code").agg(F.max(base).alias("base"))


def refine(edges: DataFrame, small: bool = False) -> DataFrame:
    """Edges (fund_code, node, issuer_code, base) with their stable ``score``.

    A round adds to ``base`` FUND_PULL times the mean score of the same company's edges in the fund and ALL_PULL times
    their mean in all funds. The rounds contract to one solution, and it is linear in the means of ``base``, so two
    aggregations give it exactly, with no rounds and nothing on the driver: averaging a round over a company's edges
    gives all = base mean / (1 - FUND_PULL - ALL_PULL), over those of one fund (base mean + ALL_PULL * all) / (1 - FUND_PULL).
    """
    in_fund = edges.groupBy("fund_code", "issuer_code").agg(F.sum("base").alias("_s"), F.count(F.lit(1)).alias("_n"))
    in_all = in_fund.groupBy("issuer_code").agg((F.sum("_s") / F.sum("_n") / (1 - FUND_PULL - ALL_PULL)).alias("_all"))
    stable = in_fund.join(F.broadcast(in_all) if small else in_all, "issuer_code")
    stable = stable.select("fund_code", "issuer_code", "_all", ((F.col("_s") / F.col("_n") + ALL_PULL * F.col("_all")) / (1 - FUND_PULL)).alias("_fund"))
    return edges.join(stable, ["fund_code", "issuer_code"]).withColumn("score", F.col("base") + FUND_PULL * F.col("_fund") + ALL_PULL * F.col("_all")).drop("_fund", "_all")


def link_securities(items: DataFrame, companies: DataFrame) -> DataFrame:
    """item_id, issuer_code, confidence: each item that is a common or preferred share of a company.

    Items with the same name and code in one fund share one link. A NULL name or code is taken as empty; companies
    without a code or name are left out; a company given several times keeps all its names. Of equal edges the least
    issuer_code wins; an empty table gives no rows; other columns are dropped, whatever their names. The endings of
    companies' names are the only rows that reach the driver.
    """
    mention = F.concat_ws("\1", F.coalesce("sec_nm", F.lit("")), F.coalesce("itm_no", F.lit("")))
    fund = F.coalesce("fund_code", F.lit(""))
    keyed = items.select("item_id", fund.alias("fund_code"), "sec_nm", "itm_no", mention.alias("mention"))
    known = companies.where("issuer_code IS NOT NULL").select("issuer_code", "issuer_name", "representative_ticker").distinct()
    endings = learned_endings(known, "issuer_name")
    sectors = names.longest_first({**{names.latin(e): e for e in endings}, **endings, **SECTORS})
    company = checkpointed(read_nodes(known, ["issuer_code"], "issuer_name", "representative_ticker", sectors))
    small = company.limit(MAX_BROADCAST_COMPANIES + 1).count() <= MAX_BROADCAST_COMPANIES
    # spellings that read alike are one node
    # a stated number of partitions: adaptive execution would read many names, small in bytes, in one task
    partitions = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spelled = keyed.select("mention", "sec_nm", "itm_no").repartition(partitions, "mention").dropDuplicates(["mention"])
    read = read_nodes(spelled, ["mention"], "sec_nm", "itm_no", sectors)
    node = F.concat_ws("\1", F.coalesce("code", F.lit("")), "sector", "stem", (F.size("swaps") > 0).cast("string"))
    read = checkpointed(read.withColumn("node", node))
    nodes = read.drop("mention").dropDuplicates(["node"])
    scored = checkpointed(scored_edges(candidate_edges(nodes, company, small), nodes, company, small))
    mentions = keyed.select("fund_code", "mention").distinct().join(read.select("mention", "node"), "mention")
    contexts = checkpointed(mentions.join(scored, "node"))
    refined = refine(contexts.select("fund_code", "node", "issuer_code", "base").distinct(), small)
    best = contexts.join(refined.select("fund_code", "node", "issuer_code", "score"), ["fund_code", "node", "issuer_code"]).groupBy("fund_code", "mention").agg(F.min(F.struct((-F.col("score")).alias("s"), "issuer_code")).alias("b"))
    confidence = F.least(-F.col("b.s") * (1 - FUND_PULL - ALL_PULL), F.lit(1.0))
    links = best.select("fund_code", "mention", F.col("b.issuer_code").alias("issuer_code"), F.round(confidence, 4).alias("confidence")).where(F.col("confidence") >= MIN_CONFIDENCE)
    return keyed.select("item_id", "fund_code", "mention").join(links, ["fund_code", "mention"]).select("item_id", "issuer_code", "confidence")
