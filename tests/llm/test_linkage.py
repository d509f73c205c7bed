import random

from factweave.llm import linkage, names, vocabulary

COMPANIES = [("굴셍델조텔레콤", "C1", "337770"), ("굴셍델조화학", "C2", "111110"), ("㈜멀해굼널소프트", "C3", "119860"), ("허룬맴몽바이오", "C4", "340400"), ("허룬맴몽바이오", "C5", "375200"), ("뱀셀낭벨전자", "C6", None), (None, "C7", None), ("무명", None, "999990")]
ITEMS = {
    "굴셍델조텔레콤": ("337770", "C1"), " 굴셍델조 통신 ": ("A337770", "C1"), "굴셍델조텔": (None, "C1"), "Gulsengdeljo Telecom Co., Ltd.": ("-", "C1"), "굴델셍조텔레콤": ("KR7337770001", "C1"), "굴셍델조텔레콤우": ("337775", "C1"), "굴셍델조텔레콤2우B": ("337777", "C1"), "굴셍댈조 TEL": ("", "C1"),
    "굴셍델조화학": (None, "C2"), "굴셍델조식품": ("123450", None), "굴셍델조텔레콤 비상장": ("337770", None), "멀해굼널소프트": ("119806", "C3"), "멀해굼널 ＳＯＦＴ": ("119870", "C3"),
    "허룬맴몽바이오": ("375200", "C5"), "허룬맴몽 BIO": ("340400", "C4"), "뱀셀낭벨 일렉": ("555550", "C6"),
    "원화 예치금": ("CASHKRW00001", None), "국채3년 선물 2609": ("FU45773184", None), "GULSENGDELJO CORP": ("GULS US", None), "멀해굼널텔레콤": (None, None), None: (None, None), "": (None, None), "가" * 5000: ("1", None),
}


def run(spark, items, companies=COMPANIES):
    df = spark.createDataFrame(items, "item_id long, fund_code string, sec_nm string, itm_no string, issuer_code string")
    return linkage.link_securities(df, spark.createDataFrame(companies, "issuer_name string, issuer_code string, representative_ticker string"))


def test_links(spark):
    rows = [(i, "F", n, code, "x") for i, (n, (code, _)) in enumerate(ITEMS.items())]
    got = {r["item_id"]: (r["issuer_code"], r["confidence"]) for r in run(spark, rows + rows[:2]).collect()}
    assert {i: c for i, (c, _) in got.items()} == {i: c for i, (_, c) in enumerate(ITEMS.values()) if c}
    assert all(0 < c <= 1 for _, c in got.values())


def test_neighbours_in_a_fund_decide_between_namesakes(spark):
    rows = [(1, "F", "허룬맴몽바이오", "375200", ""), (2, "F", "허룬맴몽바이오", None, ""), (3, "G", "허룬맴몽바이오", "340400", ""), (4, "G", "허룬맴몽 바이오", None, "")]
    assert {r["item_id"]: r["issuer_code"] for r in run(spark, rows).collect()} == {1: "C5", 2: "C5", 3: "C4", 4: "C4"}


def test_empty_tables(spark):
    assert run(spark, []).count() == 0
    assert run(spark, [(1, None, "굴셍델조텔레콤", None, "")], []).count() == 0


def test_names_outside_the_glossary_link_as_a_whole(spark):
    companies = [("삼성생명", "S1", "032830"), ("현대자동차", "S2", "005380"), ("NAVER", "S3", "035420"), ("기아", "S4", None), ("굴셍델조텔레콤", "C1", "337770")]
    rows = [(1, "F", "삼성생명", None, ""), (2, "F", "현대자동차우", "005385", ""), (3, "F", "NAVER Corp.", None, ""), (4, "F", "기아", "-", ""), (5, "F", "현대 자동차", None, ""), (6, "F", "삼성전자", None, "")]
    assert {r["item_id"]: r["issuer_code"] for r in run(spark, rows, companies).collect()} == {1: "S1", 2: "S2", 3: "S3", 4: "S4", 5: "S2"}


def test_endings_are_learned_from_the_companies(spark):
    stems = ["가나다", "라마바", "사아자", "차카타", "파하거", "너더러"]
    df = spark.createDataFrame([(s + "조선",) for s in stems] + [(s + "중공업",) for s in stems] + [("혼자만",), (None,), ("",)], "issuer_name string")
    assert vocabulary.learned_endings(df, "issuer_name") == {"조선": "조선", "중공업": "중공업"}
    assert vocabulary.learned_endings(df.limit(0), "issuer_name") == {}


def test_stable_scores_are_where_the_rounds_lead(spark):
    rng = random.Random(5)
    edges = [(f"F{rng.randrange(3)}", f"n{i}", f"C{rng.randrange(4)}", rng.random()) for i in range(60)]
    got = {r["node"]: r["score"] for r in linkage.refine(spark.createDataFrame(edges, "fund_code string, node string, issuer_code string, base double")).collect()}
    score = {n: b for _, n, _, b in edges}
    for _ in range(60):
        mean = lambda of: sum(of) / len(of)
        score = {n: b + linkage.FUND_PULL * mean([score[m] for g, m, d, _ in edges if (g, d) == (f, c)]) + linkage.ALL_PULL * mean([score[m] for _, m, d, _ in edges if d == c]) for f, n, c, b in edges}
    assert all(abs(score[n] - got[n]) < 1e-9 for n in score)


def test_recall_on_planted_spellings(spark):
    """Every spelling of every company but one letter or the ending's language off must be found, and no stranger."""
    rng = random.Random(9)
    syllables = [chr(0xAC00 + 588 * i + 28 * v + f) for i in (0, 2, 3, 5, 6, 7, 9, 11, 18) for v in (0, 4, 8, 13, 20) for f in (0, 4, 16, 21)]
    word = lambda: "".join(rng.choice(syllables) for _ in range(4))
    firms = [(word(), rng.choice([("화학", "CHEM"), ("조선", "조선"), ("", ""), ("건설", "E&C")]), f"I{i}", f"{100000 + 10 * i}") for i in range(300)]
    rows, want = [], {}
    for i, (stem, (kind, other), code, ticker) in enumerate(firms):
        typo = stem[:1] + rng.choice(syllables) + stem[2:]
        for name, t in ((stem + kind, None), (f"{stem} {other}", None), (f"㈜{stem}{kind}", ""), (names.latin(stem).title() + " " + (other if other.isascii() else names.latin(other)), ticker), (stem[0] + stem[2] + stem[1] + stem[3] + kind, None), (typo + kind, f"A{ticker}")):
            want[len(rows)] = code
            rows.append((len(rows), f"F{i % 7}", name, t, ""))
        rows.append((len(rows), "F0", word() + kind, None, ""))  # a stranger
    got = {r["item_id"]: r["issuer_code"] for r in run(spark, rows, [(s + k, c, t) for s, (k, _), c, t in firms]).collect()}
    assert sum(got.get(i) == c for i, c in want.items()) / len(want) >= 0.99
    assert sum(want.get(i) == c for i, c in got.items()) / len(got) >= 0.99
