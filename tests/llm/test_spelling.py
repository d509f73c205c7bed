import itertools
import random

from factweave.llm import names, spelling


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_segment_join_finds_every_pair_within_k(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(0, 11))) for _ in range(160)} | {"", "a", "ab"}
    left, right = sorted(words)[::2], sorted(words)
    for k in (1, 2, 3):
        got = {(r["part"], r["near"], r["edits"]) for r in spelling.within_edits(spark.createDataFrame([("x", w) for w in left], "exact string, part string"), spark.createDataFrame([("x", w) for w in right] + [("y", w) for w in right], "exact string, part string"), ["exact"], "part", k).collect()}
        want = {(a, b, edits(a, b)) for a in left for b in right if a and b and (edits(a, b) <= k if len(b) > k else a == b)}
        assert got == want


def test_romanization():
    assert names.latin("뱀셀낭벨") == "baemselnangbel" and names.latin("ab한글") == "abhangeul"
    assert names.letters("Kim 김!") == "imgim" or names.letters("kim 김!") == "kimgim"


SAME = ["핸댄골디 수뱀짐핸 로봇자동화 증권자투자신탁 제2호[혼합] 종류A-e", "수뱀짐핸 핸댄골디 로봇 2호 (A-e)", "로봇자동화 수뱀짐핸 펀드2 핸댄골디운용 Class A-e", "핸댄골디수뱀짐핸로봇자동화신탁2-혼합클래스A-e", "Haendaengoldi Subaemjimhaen Robotics Fund No.2 (Class A-e)", "subaemjimhae robotics fund 2 a-e", "수뱀짐핸로봇_제2호_종류A-e", "핸댄골디 수짐뱀핸 로봇자동화 자투자신탁 제 2 호 A-e"]
OTHER = ["핸댄골디 수뱀짐핸 로봇자동화 증권자투자신탁 제1호[혼합] 종류A-e", "핸댄골디 수뱀짐핸 로봇자동화 증권자투자신탁 제2호[혼합] 종류C-e", "핸댄골디 오멜핼홈 로봇자동화 증권자투자신탁 제2호[혼합] 종류A-e", "핸댄골디 수뱀짐핸 헬스케어 증권자투자신탁 제2호[혼합] 종류A-e"]
ORGS = ["델문문건저축은행", "㈜델문문건 저축은행", "Delmunmungeon Savings Bank Co., Ltd.", "Savings Bank, Delmunmungeon", "저축은행 델문문건", "델문문건 SB", "델문건문저축은행", "델문문건저축은행 (Delmunmungeon SB)"]


def linked(spark, aliases, products=(), entities=()):
    a = spark.createDataFrame([(i, x, k, None) for i, (x, k) in enumerate(aliases)], "alias_id long, alias string, alias_type string, kind string")
    p = spark.createDataFrame([(x, None, None) for x in products], "product_name string, asset_manager string, issuer string")
    e = spark.createDataFrame([("ORGANIZATION", x) for x in entities], "entity_kind string, preferred_name string")
    link = spelling.link_aliases(a, p, e)
    return link, {(r["alias_id_1"], r["alias_id_2"]) for r in spelling.same_entity_pairs(link).collect()}


def test_spellings_of_one_product_with_and_without_its_proper_name(spark):
    aliases = [(x, "PRODUCT") for x in SAME + OTHER]
    want = set(itertools.combinations(range(len(SAME)), 2))
    assert linked(spark, aliases, [SAME[0], *OTHER])[1] == want
    assert linked(spark, aliases)[1] == want


def test_spellings_of_one_organisation(spark):
    aliases = [(x, "ORGANIZATION") for x in [*ORGS, "델문문건캐피탈"]]
    want = set(itertools.combinations(range(len(ORGS)), 2))
    assert linked(spark, aliases, entities=[ORGS[0]])[1] == want
    assert linked(spark, aliases)[1] == want


def test_open_names_need_a_brand_with_one_product(spark):
    aliases = [("수뱀짐핸 펀드", "PRODUCT"), (SAME[0], "PRODUCT")]
    assert linked(spark, aliases, [SAME[0]])[1] == {(0, 1)}
    assert linked(spark, aliases, [SAME[0], OTHER[0]])[1] == set()


def test_null_empty_long_and_repeated_names(spark):
    link, pairs = linked(spark, [(None, "PRODUCT"), ("", "PRODUCT"), ("가" * 20_000, "PRODUCT"), (ORGS[0], "ORGANIZATION"), (ORGS[0], "ORGANIZATION"), ("x", None)])
    assert pairs == {(3, 4)}
    assert linked(spark, [])[1] == set()


def test_themes_and_kinds_outside_the_glossary_are_learned(spark):
    brands = ["가나다라", "마바사아", "자차카타", "너더러머", "버서어저"]
    others = [f"핸댄골디 {b[::-1]} {t} 증권자투자신탁 제1호[주식] 종류A" for b in brands for t in ("헬스케어", "인프라")]
    products = [f"핸댄골디 {b} 금현물 증권자투자신탁 제{n}호[주식] 종류A" for b in brands for n in (1, 2)] + others
    aliases = [(products[0], "PRODUCT"), ("가나다라 금현물 펀드 1호 A", "PRODUCT"), ("가나다라금현물_제1호_Class_A", "PRODUCT"), ("가나다라 금현물 2호 A", "PRODUCT"), ("마바사아 금현물 1호 A", "PRODUCT")]
    assert linked(spark, aliases, products)[1] == {(0, 1), (0, 2), (1, 2)}
    firms = [b + "신용정보" for b in brands]
    names_ = [("가나다라신용정보", "ORGANIZATION"), ("가나다라 신용정보(주)", "ORGANIZATION"), ("Ganadara sinyongjeongbo", "ORGANIZATION"), ("마바사아신용정보", "ORGANIZATION"), ("신용정보 가나다라", "ORGANIZATION")]
    assert linked(spark, names_, entities=firms)[1] == {(0, 1), (0, 2), (0, 4), (1, 2), (1, 4), (2, 4)}


def test_short_names_allow_fewer_edits_and_ties_are_told(spark):
    link, pairs = linked(spark, [("가나캐피탈", "ORGANIZATION"), ("가노캐피탈", "ORGANIZATION"), ("너너캐피탈", "ORGANIZATION")], entities=["가나캐피탈", "가노캐피탈"])
    assert pairs == set()
    link, _ = linked(spark, [("Delmunmungean Capital", "ORGANIZATION")], entities=["델문문건캐피탈", "델문문간캐피탈"])
    assert [r["candidates"] for r in link.collect()] == [2]


def test_recall_on_planted_spellings(spark):
    rng = random.Random(11)
    syllables = [chr(0xAC00 + 588 * i + 28 * v + f) for i in (0, 2, 3, 5, 6, 7, 9, 11, 18) for v in (0, 4, 8, 13, 20) for f in (0, 4, 16, 21)]
    word = lambda: "".join(rng.choice(syllables) for _ in range(4))
    kinds = ["신용정보", "캐피탈", "파트너스"]
    firms = [(word(), rng.choice(kinds)) for _ in range(150)]
    aliases, owner = [], []
    for i, (stem, kind) in enumerate(firms):
        for a in (stem + kind, f"{stem} {kind}", f"(주){stem}{kind}", f"{kind} {stem}", stem[1] + stem[0] + stem[2:] + kind, names.latin(stem) + " " + names.latin(kind), stem[:2] + rng.choice("각난달") + stem[3:] + kind):
            aliases.append((a, "ORGANIZATION"))
            owner.append(i)
    pairs = linked(spark, aliases, entities=[s + k for s, k in firms])[1]
    want = {(a, b) for a, b in itertools.combinations(range(len(owner)), 2) if owner[a] == owner[b]}
    # one spelling in seven has a syllable replaced, which may be more than two letters
    sure = {(a, b) for a, b in want if a % 7 < 6 and b % 7 < 6}
    assert len(sure & pairs) / len(sure) >= 0.99 and len(pairs & want) / len(pairs) >= 0.99
