import datetime as dt
import hashlib
import json
import random

from pyspark.sql import functions as F

from factweave.operators import snapshot_diff as sd


def changes(spark, rows, snapshots, mean_chunk=4):
    ready = sd.ready_sequence(spark.createDataFrame(snapshots, "dataset_id string, snapshot_date date, status string"))
    df = spark.createDataFrame(rows, "ds string, snap string, k string, payload string, given string, at timestamp_ntz, dataset string")
    content = sd.content_hash(F.col("given"), F.col("payload"))
    kept = sd.snapshot_rows(df, F.col("ds"), F.col("snap"), F.col("k"), content, F.col("at"), ready)
    return {(r["dataset"], r["key"], str(r["day"]), r["change_kind"]) for r in sd.classify_changes(sd.unmatched_rows(kept, ready, mean_chunk), ready).collect()}


def brute(rows, snapshots):
    days = {}
    for d, day, status in snapshots:
        if status.strip().upper() == "READY":
            days.setdefault(d, set()).add(day)
    state = {}
    for ds, snap, k, payload, given, at, _ in rows:
        if ds and k and snap:
            text = snap.replace("-", "")
            body = hashlib.sha256(json.dumps(json.loads(payload), sort_keys=True, ensure_ascii=False).encode()).hexdigest() if payload else ""
            key = (ds.strip(), dt.date(int(text[:4]), int(text[4:6]), int(text[6:])), k.strip())
            state[key] = max(state.get(key, (at, body)), (at, body))
    out = set()
    for d, all_days in days.items():
        ordered = sorted(all_days)
        for before, after in zip(ordered, ordered[1:]):
            a = {k: v[1] for (ds, day, k), v in state.items() if (ds, day) == (d, before)}
            b = {k: v[1] for (ds, day, k), v in state.items() if (ds, day) == (d, after)}
            out |= {(d, k, str(after), "added") for k in b.keys() - a.keys()} | {(d, k, str(after), "removed") for k in a.keys() - b.keys()} | {(d, k, str(after), "changed") for k in a.keys() & b.keys() if a[k] != b[k]}
    return out


def test_equals_brute_force_for_all_chunk_lengths(spark):
    rng = random.Random(5)
    snapshots = [("A", dt.date(2026, 1, d), "READY" if d != 3 else "FAILED") for d in range(1, 7)] + [("B", dt.date(2026, 1, d), " ready ") for d in (2, 4)]
    rows = []
    for ds, day, _ in snapshots:
        for i in range(120):
            if rng.random() < 0.9:
                payload = json.dumps({"b": str(i), "a": str(rng.random() < 0.1)})
                digest = hashlib.sha256(json.dumps(json.loads(payload), sort_keys=True).encode()).hexdigest()
                given = rng.choice([None, digest, digest.upper(), f"sha256:{digest} "])
                snap = rng.choice([day.isoformat(), day.isoformat().replace("-", "")])
                rows.append((f" {ds}", snap, f"k{i} ", payload, given, dt.datetime(2026, 1, 1, rng.randrange(3)), "x"))
    rows += rows[:50]
    want = brute(rows, snapshots)
    for mean in (1, 3, 8, 1000):
        assert changes(spark, rows, snapshots, mean) == want


def test_nulls_first_snapshot_and_empty_tables(spark):
    one = [("A", dt.date(2026, 1, 1), "READY")]
    row = ("A", "2026-01-01", "k", "{}", None, dt.datetime(2026, 1, 1), "x")
    assert changes(spark, [row, (None, "2026-01-01", "k", "{}", None, None, None), ("A", None, "k", None, None, None, None), ("A", "2026-01-01", None, None, None, None, None)], one) == set()
    assert changes(spark, [], one) == set()
    assert changes(spark, [row], []) == set()


def test_a_whole_snapshot_of_one_key_goes_and_comes(spark):
    snaps = [("A", dt.date(2026, 1, d), "READY") for d in (1, 2, 3)]
    row = lambda d: ("A", f"2026-01-0{d}", "k", "text that is no json", None, dt.datetime(2026, 1, 1), "x")
    assert changes(spark, [row(1), row(3)], snaps) == {("A", "k", "2026-01-02", "removed"), ("A", "k", "2026-01-03", "added")}
