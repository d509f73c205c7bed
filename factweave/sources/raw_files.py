"""Delivered text files as raw records, also where a quoted record crosses lines or the splits a file is read in.

Each line is a function of the state it is entered in, inside a quoted field or outside; a split's function is the
composition of its lines'. The splits' functions, a few bytes each, are composed file by file, which gives the state every
split is entered in; then the lines are read again from that state and put together to records. What one split leaves
open meets its continuation by the split it began in.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.operators.raw_records import BREAK, END, QUOTED, START, classify, states_after

#: Letters up to which fragments of one record are put together; a longer one is a quote that never closes.
MOST_LETTERS = 10_000_000


def _inside_after(lines: Sequence[str], delimiter: str) -> np.ndarray:
    """Whether each line, entered outside, ends inside a quoted field."""
    codes = np.frombuffer("\0".join([*lines, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    ends = np.cumsum(lengths + 1) - 1
    classes = classify(codes, delimiter)
    classes[classes == BREAK] = END  # a line holds no break
    classes[ends] = END
    states = states_after(classes)
    return np.where(lengths > 0, states[np.maximum(ends - 1, 0)], START) == QUOTED


def line_functions(lines: Sequence[str], delimiter: str = ",") -> tuple[np.ndarray, np.ndarray]:
    """The state after each line, True for inside, entered outside and entered inside."""
    return _inside_after(lines, delimiter), _inside_after(['"' + x for x in lines], delimiter)


def states_before(outside: np.ndarray, inside: np.ndarray, entry: bool) -> tuple[np.ndarray, bool]:
    """The state before each line and after the last, from the functions of lines and the state the first is entered in.

    A line either sets the state whatever it was, or keeps it, or turns it round: since the last that sets it, the number
    of turns decides.
    """
    sets = outside == inside
    turns = np.cumsum(outside & ~inside)
    last = np.maximum.accumulate(np.where(sets, np.arange(len(sets)), -1))
    base = np.where(last >= 0, outside[last], entry)
    since = turns - np.where(last >= 0, turns[last], 0)
    after = base ^ (since % 2 == 1)
    return np.concatenate([[entry], after[:-1]]).astype(bool), bool(after[-1]) if len(after) else entry


def file_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """file, split, value: lines in order within each split; what divides lines is not kept."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, list[str]]]:
    """Stretches of a batch from one split."""
    files, splits, values = (batch.column(i).to_pylist() for i in range(3))
    at = 0
    for i in range(1, len(files) + 1):
        if i == len(files) or (files[i], splits[i]) != (files[at], splits[at]):
            yield files[at], splits[at], values[at:i]
            at = i


def split_entries(lines: DataFrame, delimiter: str = ",") -> DataFrame:
    """file, split, entry (inside?), owner: the state every split is entered in, and the split its first record began in."""

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, starts = None, [False, True], [False, False]
        made = lambda: pa.RecordBatch.from_pylist([{"file": key[0], "split": key[1], "f0": state[0], "f1": state[1], "g0": starts[0], "g1": starts[1]}])
        for batch in batches:
            for file, split, values in _runs(batch):
                if key != (file, split):
                    if key:
                        yield made()
                    key, state, starts = (file, split), [False, True], [False, False]
                out, into = line_functions(values, delimiter)
                for e in (0, 1):
                    before, state[e] = states_before(out, into, state[e])
                    starts[e] |= bool((~before).any())
        if key:
            yield made()

    def compose(table: pa.Table) -> pa.Table:
        rows, state, owner = [], False, None
        for r in sorted(table.to_pylist(), key=lambda r: r["split"]):
            rows.append({"file": r["file"], "split": r["split"], "entry": state, "owner": owner})
            owner = r["split"] if r["g1" if state else "g0"] else owner
            state = r["f1" if state else "f0"]
        return pa.Table.from_pylist(rows, pa.schema([("file", pa.string()), ("split", pa.int64()), ("entry", pa.bool_()), ("owner", pa.int64())]))

    split_functions = lines.mapInArrow(functions, "file string, split bigint, f0 boolean, f1 boolean, g0 boolean, g1 boolean")
    return split_functions.groupBy("file").applyInArrow(compose, "file string, split bigint, entry boolean, owner bigint")


def delivered_records(spark: SparkSession, path: str | Sequence[str], delimiter: str = ",", most_letters: int = MOST_LETTERS) -> DataFrame:
    """file, split, line_no, raw_line of every record: the line it begins on, counted within its split from 1, and its text.

    Lines of a record are joined by a line feed. A quote that never closes takes the rest of its file; beyond
    ``most_letters`` only what its own split holds of it is kept, which is an unterminated quote all the same. Empty lines
    are records, empty files have none. Only one row per split is broadcast, some 50 bytes for 128 MB of text.
    """
    lines = file_lines(spark, path)
    entered = lines.join(F.broadcast(split_entries(lines, delimiter)), ["file", "split"]).select("file", "split", "value", "entry", "owner")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, owner, held, began, line = None, False, None, [], 0, 0
        rows: list[tuple] = []

        def close(open_: bool) -> None:
            if held or began:
                if began == 0:  # before the split's first record: goes on from an earlier split
                    rows.append((key[0], owner, key[1], 0, "\n".join(held), True))
                else:
                    rows.append((key[0], key[1], key[1], began, "\n".join(held), open_))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "split", "part", "line_no", "raw_line", "fragment"])
            rows.clear()
            return out

        for batch in batches:
            entries, owners = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            at = 0
            for file, split, values in _runs(batch):
                if key != (file, split):
                    if key:
                        close(state)
                    key, state, owner, held, began, line = (file, split), entries[at], owners[at], [], 0, 0
                at += len(values)
                before, state = states_before(*line_functions(values, delimiter), state)
                for inside, value in zip(before.tolist(), values):
                    line += 1
                    if not inside:
                        close(False)
                        held, began = [], line
                    held.append(value)
            yield flush()
        if key:
            close(state)
            yield flush()

    parts = entered.mapInArrow(assemble, "file string, split bigint, part bigint, line_no int, raw_line string, fragment boolean")
    whole = parts.where(~F.col("fragment")).select("file", "split", "line_no", "raw_line")
    open_ = parts.where("fragment")
    letters = open_.groupBy("file", "split").agg(F.sum(F.length("raw_line")).alias("_letters"))
    kept = open_.join(letters, ["file", "split"]).where((F.col("_letters") <= most_letters) | (F.col("part") == F.col("split")))
    joined = kept.groupBy("file", "split").agg(F.max("line_no").alias("line_no"), F.array_sort(F.collect_list(F.struct("part", "raw_line"))).alias("_p"))
    return whole.unionByName(joined.select("file", "split", "line_no", F.array_join(F.transform("_p", lambda x: x["raw_line"]), "\n").alias("raw_line")))
