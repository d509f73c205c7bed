import random
from difflib import SequenceMatcher

from factweave.operators import entity


def near(spark, mentions, names, *how):
    rows = entity.near_matches(spark.createDataFrame([(m,) for m in mentions], "m string"), "m", spark.createDataFrame(names, "name string, entity_id string"), *how).collect()
    return {(r["m"], r["entity_id"]): (r["likeness"], r["status"]) for r in rows}


def test_fragments_may_stand_anywhere_in_any_name(spark):
    names = [("헤레셍해신탁", "1"), ("뱀하핸롬생명보험", "2"), ("unlike", "3"), ("xx신탁헤yy레셍해", "3"), ("가나다라은행", "4"), ("가나다라증권", "5")]
    got = near(spark, ["신탁헤레셍해", "뱀핸하롬생명", "가나다라증권사"], names, 3, {"증권사": "증권", "증권": "증권", "은행": "은행"})
    assert got == {("신탁헤레셍해", "1"): (0.666667, "CANDIDATE"), ("신탁헤레셍해", "3"): (0.75, "CANDIDATE"), ("뱀핸하롬생명", "2"): (0.714286, "CANDIDATE"), ("가나다라증권사", "5"): (0.923077, "RESOLVED")}
    assert near(spark, ["abcd"], [("abcd", "1")], 5) == {}


def test_bounds_lose_no_match(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randint(3, 12)))
    names, mentions = [(word(), str(i % 90)) for i in range(120)], {word() for _ in range(60)}
    want = {}
    for m in mentions:
        met = {e for n, e in names if m[:3] in n or m[-3:] in n}
        best = {}
        for n, e in names:
            if e in met:
                best[e] = max(best.get(e, 0), round(SequenceMatcher(None, m, n, autojunk=False).ratio(), 6))
        first = sorted(((e, x) for e, x in best.items() if x >= 0.55), key=lambda x: (-x[1], x[0]))[:10]
        sure = first and first[0][1] >= 0.9 and (len(first) == 1 or first[0][1] - first[1][1] >= 0.03)
        want |= {(m, e): x for e, x in (first[:1] if sure else first)}
    assert {k: v[0] for k, v in near(spark, mentions, names).items()} == want
