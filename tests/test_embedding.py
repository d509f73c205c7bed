import pytest

from factweave.functions import text as ftext


def test_embedding_has_named_features_and_concepts(spark):
    rows = spark.createDataFrame([("Gold \n ETF",), ("Semiconductor",), ("반도체",), ("...",), (None,)], "t string").select(ftext.hash_embedding("t").alias("e")).collect()
    gold, english, korean, none, null = [r["e"] for r in rows]
    # blake2b-128 of token:gold, token:etf, bigram:gold_etf, concept:gold, worked out apart; length = sqrt(1 + 1 + 0.65 ** 2 + 4 ** 2)
    assert {i: x for i, x in enumerate(gold) if x} == pytest.approx({156: -1 / 4.292144, 66: 1 / 4.292144, 303: 0.65 / 4.292144, 263: -4 / 4.292144}, abs=1e-6)
    assert sum(a * b for a, b in zip(english, korean)) == pytest.approx(16 / 17, abs=1e-6)  # the concept ties the languages
    assert not any(none) and len(none) == 384 and null is None
