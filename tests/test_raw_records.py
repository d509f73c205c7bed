import csv
import io

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factweave.operators import raw_records as rr


def brute(line: str, n: int):
    """A plain character loop with the same rules."""
    state, fields, text = "start", 1, line.rstrip()
    for c in text:
        blank = c in " \t\x0b\x0c 　 "
        if state == "start":
            state = {'"': "quoted", ",": "start", "\n": "bad", "\r": "bad"}.get(c, "start" if blank else "plain")
            fields += c == ","
        elif state == "plain":
            if c == ",":
                state, fields = "start", fields + 1
            elif c in '"\n\r':
                return False
        elif state == "quoted":
            if c == '"':
                state = "closing"
        elif state == "closing":
            if c == '"':
                state = "quoted"
            elif c == ",":
                state, fields = "start", fields + 1
            elif blank:
                state = "closed"
            else:
                return False
        elif state == "closed":
            if c == ",":
                state, fields = "start", fields + 1
            elif not blank:
                return False
        if state == "bad":
            return False
    return state != "quoted" and fields == n


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='ab",\n \t가', max_size=40), max_size=12), st.integers(1, 7))
def test_tokenizer_equals_a_loop_for_any_chunk(lines, chunk):
    got = rr.tokenize(lines, 3, chunk=chunk)
    assert [g[1] is None for g in got] == [brute(x, 3) for x in lines]
    assert got == rr.tokenize(lines, 3)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='xy",\n가', max_size=8), min_size=3, max_size=3), min_size=1, max_size=6))
def test_written_records_come_back(rows):
    lines = []
    for r in rows:
        out = io.StringIO()
        csv.writer(out, quoting=csv.QUOTE_ALL).writerow(r)
        lines.append(out.getvalue())
    assert [g[0] for g in rr.tokenize(lines, 3, chunk=5)] == rows


def test_offsets_and_reasons():
    got = rr.tokenize(['a,"b', 'a,b"c,d', '"a"x,b,c', "a,b", "a,b,c,d", None, "", "a\nb,c,d"], 3)
    assert [g[1:] for g in got] == [("unterminated_quote", 2), ("bare_quote", 3), ("text_after_quote", 3), ("field_count", 3), ("field_count", 5), ("no_line", None), ("field_count", 0), ("bare_line_break", 1)]


def test_no_lines():
    assert rr.tokenize([], 3) == []


GOOD = "20260223,F1,60,이름,069460,55,71,446,{},{},EQ"


def test_rules_of_the_holdings_layout(spark):
    cases = {
        GOOD.format("4171395", "1.10"): None, GOOD.format("", ""): None, GOOD.format('"4,171,395"', " 100 "): None,
        GOOD.format("4,171", "1"): "field_count", GOOD.format("-1", "1"): "invalid_evalA", GOOD.format('"4,17"', "1"): "invalid_evalA",
        GOOD.format("1", "100.01"): "invalid_ratio", GOOD.format("1", "-0.1"): "invalid_ratio", GOOD.format("1", "1e1"): "invalid_ratio",
        GOOD.format("1", "1").replace("20260223", "20260230"): "invalid_gijunYMD", GOOD.format("1", "1").replace("20260223", ""): "invalid_gijunYMD",
        None: "no_line", "": "field_count", "x" * 100_000: "field_count",
    }
    rows = [(i, line, "k") for i, line in enumerate(cases)]
    df = spark.createDataFrame(rows, "line_id long, raw_line string, _reason string")
    checked = rr.checked_records(df, "raw_line", rr.holding_fields())
    bad = {r["line_id"]: r["reason"] for r in rr.rejected_rows(checked, ["line_id"]).collect()}
    assert bad == {i: reason for i, reason in enumerate(cases.values()) if reason}
    good = rr.typed_rows(checked, rr.holding_fields(), ["line_id", "raw_line"]).orderBy("line_id").collect()
    assert [float(r["evalA"]) if r["evalA"] is not None else None for r in good] == [4171395, None, 4171395]


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([], "line_id long, raw_line string, ratio int")
    checked = rr.checked_records(df, "raw_line", rr.holding_fields())
    assert rr.typed_rows(checked, rr.holding_fields(), ["line_id", "ratio"]).count() == 0
    assert rr.rejected_rows(checked, ["line_id", "ratio"]).count() == 0


def test_value_errors_tell_their_field(spark):
    lines = ['20260101,f,1,"a, b",i,1,1,1,5,2,t', '2026-01-01,f,1,n,i,1,1,1,5,2,t', '20260101,f,1,"a, b",i,1,1,1,-5,2,t', '20260101,f,1,n,i,1,1,1,"1,000",101,t', None]
    df = spark.createDataFrame(list(enumerate(lines)), "line_id int, raw_line string").withColumn("_starts", F.lit(1))
    checked = rr.checked_records(df, "raw_line", rr.holding_fields())
    got = {r["line_id"]: (r["reason"], r["error_offset"]) for r in rr.rejected_rows(checked, ["line_id"]).collect()}
    assert got == {1: ("invalid_gijunYMD", 0), 2: ("invalid_evalA", lines[2].index("-5")), 3: ("invalid_ratio", lines[3].rindex("101")), 4: ("no_line", None)}
