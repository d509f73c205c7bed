import datetime as dt
import random

from pyspark.sql import functions as F

from factweave.operators import wide

TYPES = [("D", "a", "numeric"), ("D", "b", "date"), ("D", "c", "flag"), ("D", "d", "integer"), ("D", "e", "text")]
SCHEMA = "assertion_id string, source_record_id string, source_dataset string, source_column string, normalized_value string, asserted_at timestamp_ntz, a string"


def compacted(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return wide.compacted_assertions(df, spark.createDataFrame(TYPES, "source_dataset string, source_column string, value_type string"))


def at(day, hour=0):
    return dt.datetime(2026, 1, day, hour)


def test_latest_fitting_version_wins_in_any_order(spark):
    rng = random.Random(1)
    values = ["1", "2,5", "1,000.5", "x", None, "-3", " 7 ", ""]
    rows = [(f"a{i:03}", f"r{rng.randrange(6)}", "D", rng.choice(["a", "A ", "d", "b"]), rng.choice([*values, "2026-01-31", "20260230"]), at(1 + i % 9, i % 5) if i % 11 else None, "k") for i in range(300)]
    expected = {}
    fit = {"a": lambda v: v in ("1", "1,000.5", "-3", "7", "20260230"), "d": lambda v: v in ("1", "-3", "7", "20260230"), "b": lambda v: v == "2026-01-31"}
    for i, r, _, c, v, t, _ in rows:
        if v is not None:
            key = (r, c.strip().lower())
            version = (fit[key[1]](v.strip()), t is not None, t or at(1), i, v.strip())
            expected[key] = max(expected.get(key, version), version)
    for order in (rows, rows[::-1]):
        got = {(r["source_record_id"], k): (c["fits"], c["value"]) for r in compacted(spark, order).collect() for k, c in r["cells"].items()}
        assert got == {k: (v[0], v[4]) for k, v in expected.items()}


def test_wide_columns_are_typed_and_names_do_not_clash(spark):
    rows = [("1", "r", "D", "a", "1,234.5", at(1), ""), ("2", "r", "D", "b", "2026/02/28", at(1), ""), ("3", "r", "D", "c", "y", at(1), ""), ("4", "r", "D", "d", "x", at(1), ""), ("5", "r", "D", "zz", "x", at(1), "")]
    out = wide.wide(compacted(spark, rows).withColumnRenamed("source_record_id", "e"), ["e"], [(c, t) for _, c, t in TYPES])
    r = out.collect()[0]
    assert out.columns == ["e", "a", "b", "c", "d", "e_value"]
    assert (float(r["a"]), r["b"], r["c"], r["d"], r["e_value"]) == (1234.5, dt.date(2026, 2, 28), True, None, None)
    assert [x["col"] for x in wide.unfit_cells(compacted(spark, rows), ["source_record_id"], "col").collect()] == ["d"]


def test_one_hot_record_and_repeated_rows(spark):
    hot = [(f"h{i}", "hot", "D", "a", str(i % 7), at(1 + i % 28), "") for i in range(3000)]
    rows = hot + hot[:100] + [("x", None, "D", "a", "1", at(1), ""), ("y", "r", "D", None, "1", at(1), "")]
    assert compacted(spark, rows).select("source_record_id", F.size("cells").alias("n")).collect() == [("hot", 1)]


def test_no_rows(spark):
    assert compacted(spark, []).count() == 0


def test_long_text_is_kept_whole(spark):
    text = "가" * 200_000
    assert compacted(spark, [("1", "r", "D", "e", text, at(1), "")]).collect()[0]["cells"]["e"]["value"] == text
