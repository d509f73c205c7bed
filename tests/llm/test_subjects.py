import random

import numpy as np

from factweave.llm import subjects

WORDS = {"law": ["court", "appeal", "statute", "verdict", "lawyer", "clause"], "sport": ["goal", "league", "coach", "stadium", "match", "ticket"], "energy": ["turbine", "pipeline", "biofuel", "refinery", "battery", "carbon"]}
KOREAN = {"law": ["재판부", "항소", "조문", "판결", "변호사", "소송"], "sport": ["득점", "리그", "감독", "경기장", "입장권", "심판"], "energy": ["발전소", "송전망", "정유", "배터리", "탄소", "풍력"]}
NEUTRAL = ["please read the prospectus for details.", "past returns do not promise results.", "이 문서는 안내를 위해 작성되었다.", "수익률은 성과를 보장하지 않는다."]
P = subjects.Parameters(features=4096, rank=16, block=256)


def corpus(n=700, seed=4):
    rng = random.Random(seed)
    docs, truth, labels = [], {}, []
    for i in range(n):
        picked = rng.sample(sorted(WORDS), rng.choice([1, 1, 2]))
        table = rng.choice([WORDS, KOREAN])
        say = lambda s: f"the desk reviewed {rng.choice(table[s])} and {rng.choice(table[s])} again 12.5%." if table is WORDS else f"이번 분기에는 {rng.choice(table[s])} 관련 {rng.choice(table[s])} 문의가 늘었다."
        lines = [say(s) for s in picked for _ in range(4)] + rng.sample(NEUTRAL, 2)
        other = rng.choice([s for s in WORDS if s not in picked])
        if rng.random() < 0.3 and len(picked) == 2:
            lines.append(say(other))  # a passing mention
        rng.shuffle(lines)
        docs.append((i, " ".join(lines), "x"))
        truth[i] = set(picked)
        if i % 6 == 0:
            labels += [(i, s) for s in (picked if rng.random() > 0.05 else [other])]
    return docs, truth, labels


def run(spark, docs, labels, areas=tuple(WORDS)):
    out = subjects.document_subjects(spark.createDataFrame(docs, "doc_id long, text string, subject string").repartition(4), spark.createDataFrame(labels, "doc_id long, subject string"), spark.createDataFrame([(a, a) for a in areas], "subject string, title string"), P)
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    return got


def test_held_out_accuracy(spark):
    docs, truth, labels = corpus()
    got = run(spark, docs + [(9001, None, ""), (9002, "", ""), (9003, "12 %", "")], labels)
    held = [i for i in truth if i % 6]
    right = sum(len(got.get(i, set()) & truth[i]) for i in held)
    assert right / sum(len(truth[i]) for i in held) > 0.93
    assert right / sum(len(got.get(i, set())) for i in held) > 0.93
    assert not {9001, 9002, 9003} & set(got)


def test_no_documents(spark):
    assert run(spark, [], []) == {}


def test_sentences():
    text = "<p>Overview\nThe NAV was 1,234.5 on 2026-01-02. 가나 다라 마바.\nNotes</p> &amp; [공지]"
    assert subjects.sentences(text) == ["the nav was 0 on 0.", "가나 다라 마바."]
    assert subjects.sentences("") == []


def test_gathered_equals_a_loop():
    rng = np.random.default_rng(1)
    matrix, rows, groups, weights = rng.random((9, 3)), rng.integers(0, 9, 500), rng.integers(0, 7, 500), rng.random(500)
    want = np.zeros((7, 3))
    for r, g, w in zip(rows, groups, weights):
        want[g] += w * matrix[r]
    assert np.allclose(subjects.gathered(matrix, rows, groups, 7, weights), want)
