"""Files whose quoted records cross lines and splits."""

import csv
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from factweave.operators import raw_records as rr
from factweave.sources import raw_files as rf


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='a,"\\ ', max_size=8), min_size=1, max_size=15), st.booleans())
def test_states_equal_a_loop(lines, entry):
    out, into = rf.line_functions(lines)
    state, want = entry, []
    for a, b in zip(out.tolist(), into.tolist()):
        want.append(state)
        state = b if state else a
    before, after = rf.states_before(out, into, entry)
    assert before.tolist() == want and after == state


def records(spark, path, **options):
    rows = rf.delivered_records(spark, str(path), **options).collect()
    return [r["raw_line"] for r in sorted(rows, key=lambda r: (r["file"], r["split"], r["line_no"]))]


def test_records_across_splits(spark, tmp_path):
    rng = random.Random(2)
    text = lambda: "".join(rng.choice(['x', ',', '"', "\n", "가", "long words "]) for _ in range(rng.randrange(0, 60)))
    for n in range(3):
        with open(tmp_path / f"f{n}.csv", "w", newline="") as f:
            w = csv.writer(f, quoting=csv.QUOTE_ALL, lineterminator="\n")
            w.writerows([[text(), text(), str(i)] for i in range(300)])
    want = []
    for n in range(3):
        with open(tmp_path / f"f{n}.csv", newline="") as f:
            want += [tuple(r) for r in csv.reader(f)]
    for size in ("1000", "134217728"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        got = records(spark, tmp_path)
        parsed = [tuple(x[0]) if x[0] else x for x in rr.tokenize(got, 3)]
        # blanks around a field do not matter: inside quotes they do
        assert parsed == want
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_quote_that_never_closes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1,ok\n2,"open\n3,x\n4,y\n')
    (tmp_path / "b.csv").write_text('5,fine\n\n6,"a\nb"\n')
    (tmp_path / "c.csv").write_text("")
    assert records(spark, tmp_path) == ["1,ok", '2,"open\n3,x\n4,y', "5,fine", "", '6,"a\nb"']
    assert [x[1] for x in rr.tokenize(records(spark, tmp_path), 2)] == [None, "unterminated_quote", None, "field_count", None]
