"""Text normalization and hashing that Spark has no built-in for."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed patterns of tokens.
TOKEN = r"[a-z0-9]+(?:[.&+\-][a-z0-9]+)*|[가-힣]+"
#: Fixed values of the hash embedding.
DIMENSIONS, TOKEN_WEIGHT, PAIR_WEIGHT, CONCEPT_WEIGHT = 384, 1.0, 0.65, 4.0
#: Features whose places a task keeps at most; more are worked out again.
KNOWN_FEATURES = 500_000
#: Fixed table: words that tell a concept, in either language.
CONCEPTS = {
    "artificial_intelligence": ("artificial intelligence", "machine learning", "deep learning", "인공지능", "머신러닝", "딥러닝", "ai 기술", "ai 산업", "ai 기업"),
    "semiconductor": ("semiconductor", "semiconductors", "반도체"),
    "us_treasury": ("u.s. treasury", "us treasury", "united states treasury", "treasury securities", "미국 국채", "미 국채"),
    "gold": ("physical gold", "gold bullion", "gold", "금 현물", "금"),
    "covered_call": ("covered call", "call writing", "buy-write", "커버드콜", "커버드 콜"),
    "healthcare": ("healthcare", "health care", "medical technology", "헬스케어", "의료"),
    "clean_energy": ("clean energy", "renewable energy", "solar energy", "친환경 에너지", "재생 에너지", "청정 에너지"),
    "robotics": ("robotics", "automation", "로봇", "자동화"),
    "cybersecurity": ("cybersecurity", "cyber security", "사이버 보안"),
    "blockchain": ("blockchain", "digital assets", "블록체인"),
    "technology": ("technology companies", "technology sector", "기술 기업"),
    "income": ("income generation", "current income", "인컴", "수익 창출"),
}


@F.pandas_udf(T.StringType())
def lookup_form(text: pd.Series) -> pd.Series:
    """NFKC, case folded, without any blanks."""
    return text.map(lambda t: re.sub(r"\s+", "", unicodedata.normalize("NFKC", t).casefold()), na_action="ignore")


@F.pandas_udf(T.StringType())
def search_form(text: pd.Series) -> pd.Series:
    """NFKC, case folded, blanks collapsed."""
    return text.map(lambda t: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t).casefold()).strip(), na_action="ignore")


def tokens(text: Column, pattern: str = TOKEN) -> Column:
    """Tokens of lower-cased text, in the JVM."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def _place(feature: str) -> tuple[int, float]:
    digest = hashlib.blake2b(feature.encode(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little") % DIMENSIONS, 1.0 if digest[8] & 1 else -1.0


@F.pandas_udf(T.ArrayType(T.FloatType()))
def hash_embedding(text: pd.Series) -> pd.Series:
    """A fixed-size signed hash of tokens, neighbouring pairs and concepts, of length 1 (all zeros for no feature)."""
    pattern = re.compile(TOKEN)
    norm = lambda t: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t).casefold()).strip()
    places: dict[str, tuple[int, float]] = {}  # features met before: words repeat, and hashing one costs most

    def place(feature: str) -> tuple[int, float]:
        if len(places) > KNOWN_FEATURES:
            places.clear()
        found = places.get(feature)
        if found is None:
            found = places[feature] = _place(feature)
        return found

    def one(value: str | None) -> np.ndarray | None:
        if value is None:
            return None
        plain = norm(value)
        words = pattern.findall(norm(plain))
        concepts = [f"concept:{c}" for c, aliases in CONCEPTS.items() if any(a in plain for a in aliases)]
        out = np.zeros(DIMENSIONS)
        for weight, features in ((TOKEN_WEIGHT, [f"token:{w}" for w in words]), (PAIR_WEIGHT, [f"bigram:{a}_{b}" for a, b in zip(words, words[1:])]), (CONCEPT_WEIGHT, concepts)):
            if features:
                at, sign = zip(*map(place, features))
                out += np.bincount(at, np.multiply(sign, weight), DIMENSIONS)
        length = float(np.linalg.norm(out))
        return (out / length if length else out).astype(np.float32)

    return text.map(one)


def normalized_url(url: Column) -> Column:
    """Lower scheme and host, default ports and fragments dropped, query in order, no credentials."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    authority = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)), r"^[^@]*@", "")
    host = F.when(scheme == "http", F.regexp_replace(authority, ":80$", "")).when(scheme == "https", F.regexp_replace(authority, ":443$", "")).otherwise(authority)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    ordered = F.array_join(F.array_sort(F.split(query, "&")), "&")
    return F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), ordered)))
