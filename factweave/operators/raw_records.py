"""Delimited raw records: typed rows for the valid, an offset and a reason for the rest.

A finite-state tokenizer reads each Arrow batch as one stream of characters cut into equal chunks. Every chunk is
run from all states at once, which gives its transition function; the functions are composed across chunks by a
doubling scan, so each chunk learns its true entry state without waiting for the one before; a second run from that
state marks every character. No step over characters loops in Python, and a record may cross any number of chunks; fields
are then cut out record by record. Every error has the offset of the character, or of the field, it is about.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions import parsing

# Fixed states of the tokenizer.
START, PLAIN, QUOTED, QUOTE_IN_QUOTED, CLOSED, BARE_QUOTE, TEXT_AFTER_QUOTE, BARE_BREAK = range(8)
# Fixed classes of characters; END separates records.
OTHER, COMMA, QUOTE, BREAK, BLANK, END = range(6)
#: Reasons by the state a record ends in.
STATE_REASON = {BARE_QUOTE: "bare_quote", TEXT_AFTER_QUOTE: "text_after_quote", BARE_BREAK: "bare_line_break", QUOTED: "unterminated_quote"}
CHUNK = 256


def _transitions() -> np.ndarray:
    step = np.tile(np.arange(8, dtype=np.int8), (6, 1))  # error states keep themselves
    step[OTHER, :5] = [PLAIN, PLAIN, QUOTED, TEXT_AFTER_QUOTE, TEXT_AFTER_QUOTE]
    step[COMMA, :5] = [START, START, QUOTED, START, START]
    step[QUOTE, :5] = [QUOTED, BARE_QUOTE, QUOTE_IN_QUOTED, QUOTED, TEXT_AFTER_QUOTE]
    step[BREAK, :5] = [BARE_BREAK, BARE_BREAK, QUOTED, BARE_BREAK, BARE_BREAK]
    step[BLANK, :5] = [START, PLAIN, QUOTED, CLOSED, CLOSED]
    step[END, :] = START
    return step


STEP = _transitions()


def classify(codes: np.ndarray, delimiter: str = ",") -> np.ndarray:
    low = np.zeros(256, dtype=np.int8)
    for char in " \t\x0b\x0c ":
        low[ord(char)] = BLANK
    for char in "\n\r":
        low[ord(char)] = BREAK
    low[ord('"')], low[ord(delimiter)] = QUOTE, COMMA
    classes = low[np.minimum(codes, 255)]
    classes[codes > 255] = OTHER
    classes[(codes == 0x3000) | (codes == 0x2003)] = BLANK
    return classes


def states_after(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """The state after every character, by composing the chunks' transition functions."""
    n = len(classes)
    if n == 0:
        return np.zeros(0, dtype=np.int8)
    chunks = -(-n // chunk)
    grid = np.full(chunks * chunk, END, dtype=np.int8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(chunks, chunk).T)
    ends = np.tile(np.arange(8, dtype=np.int8), (chunks, 1))
    for row in grid:
        ends = STEP[row[:, None], ends]
    prefix, width = ends, 1  # prefix[i] leads from the first chunk's entry to the exit of chunk i
    while width < chunks:
        longer = prefix.copy()
        longer[width:] = np.take_along_axis(prefix[width:], prefix[:-width].astype(np.intp), axis=1)
        prefix, width = longer, width * 2
    state = np.concatenate([[START], prefix[:-1, START]]).astype(np.int8)
    out = np.empty((chunk, chunks), dtype=np.int8)
    for j, row in enumerate(grid):
        state = STEP[row, state]
        out[j] = state
    return out.T.reshape(-1)[:n]


def _unquoted(text: str) -> str:
    text = text.strip()
    return text[1:-1].replace('""', '"') if text[:1] == '"' else text


def tokenize(lines: Sequence[str | None], n_fields: int, delimiter: str = ",", chunk: int = CHUNK) -> list[tuple]:
    """(fields or None, reason or None, offset or None) for every line."""
    return [x[:3] for x in cut_records(lines, n_fields, delimiter, chunk)]


def cut_records(lines: Sequence[str | None], n_fields: int, delimiter: str = ",", chunk: int = CHUNK) -> list[tuple]:
    """(fields or None, reason or None, offset or None, starts or None) for every line.

    Offsets count characters from 0; starts are the offsets of the fields.
    """
    texts = ["" if x is None else x.rstrip() for x in lines]
    codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    classes = classify(codes, delimiter)
    classes[ends] = END
    states = states_after(classes, chunk)
    before = np.concatenate([[START], states[:-1]])
    last = np.where(lengths > 0, states[np.maximum(ends - 1, 0)], START)
    broken = (states >= BARE_QUOTE) & (before < BARE_QUOTE)
    broken_at = np.flatnonzero(broken)
    opened_at = np.flatnonzero((states == QUOTED) & (before == START))
    cuts = np.flatnonzero((classes == COMMA) & (states == START))
    first, past = np.searchsorted(cuts, starts), np.searchsorted(cuts, ends)
    out: list[tuple] = []
    for i, text in enumerate(texts):
        if lines[i] is None:
            out.append((None, "no_line", None, None))
        elif last[i] >= BARE_QUOTE:
            at = broken_at[np.searchsorted(broken_at, starts[i])]
            out.append((None, STATE_REASON[int(last[i])], int(at - starts[i]), None))
        elif last[i] == QUOTED:
            at = opened_at[np.searchsorted(opened_at, ends[i]) - 1]
            out.append((None, STATE_REASON[QUOTED], int(at - starts[i]), None))
        elif past[i] - first[i] + 1 != n_fields:
            extra = cuts[first[i] + n_fields - 1] - starts[i] if past[i] - first[i] >= n_fields else lengths[i]
            out.append((None, "field_count", int(extra), None))
        else:
            at = [-1, *(cuts[first[i] : past[i]] - starts[i]).tolist(), len(text)]
            out.append(([_unquoted(text[a + 1 : b]) for a, b in zip(at, at[1:])], None, None, [a + 1 for a in at[:-1]]))
    return out


@dataclass(frozen=True)
class Field:
    """A field of the layout: typed is NULL where the value is empty or wrong, ok is the rule it must meet."""

    name: str
    typed: Column | None = None
    ok: Column | None = None


def split_records(df: DataFrame, line: str, fields: Sequence[str], delimiter: str = ",") -> DataFrame:
    """df with ``_fields`` (array, NULL if the layout is broken), ``_reason``, ``_offset`` and ``_starts`` of the fields.

    Null lines give ``no_line``, empty lines ``field_count``; an empty table an empty result. Other columns pass
    unchanged; columns that already bear one of the four names are left out.
    """
    n = len(fields)
    df = df.drop(*[c for c in df.columns if c.lower() in ("_fields", "_reason", "_offset", "_starts")])
    schema = df.select("*", F.lit(None).cast("array<string>").alias("_fields"), F.lit(None).cast("string").alias("_reason"), F.lit(None).cast("int").alias("_offset"), F.lit(None).cast("array<int>").alias("_starts")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = cut_records(batch.column(batch.schema.get_field_index(line)).to_pylist(), n, delimiter)
            parts = list(zip(*got)) or [(), (), (), ()]
            arrays = [pa.array(parts[0], pa.list_(pa.string())), pa.array(parts[1], pa.string()), pa.array(parts[2], pa.int32()), pa.array(parts[3], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, "_fields", "_reason", "_offset", "_starts"])

    return df.mapInArrow(run, schema)


def holding_fields() -> list[Field]:
    """The eleven fields of a holdings line with their rules."""
    value = lambda i: parsing.stripped(F.col("_fields")[i])
    whole = lambda i: parsing.decimal(value(i)).cast("decimal(38,4)")
    day = parsing.day_compact(value(0))
    eval_a = parsing.decimal(value(8), parsing.DECIMAL_NON_NEGATIVE, 38, 4)
    ratio = parsing.decimal(value(9), parsing.DECIMAL_PLAIN, 38, 10)
    return [
        Field("gijunYMD", day, day.isNotNull()),
        Field("fId"),
        Field("totalCnt", value(2).try_cast("int")),
        Field("secNm"),
        Field("itmNo"),
        Field("applyQ", whole(5)),
        Field("curp", whole(6)),
        Field("risep", whole(7)),
        Field("evalA", eval_a, (value(8) == "") | value(8).rlike(parsing.DECIMAL_NON_NEGATIVE)),
        Field("ratio", ratio, (value(9) == "") | (value(9).rlike(parsing.DECIMAL_PLAIN) & (value(9).try_cast("double") <= 100))),
        Field("pdfType"),
    ]


def checked_records(df: DataFrame, line: str, fields: Sequence[Field]) -> DataFrame:
    """split_records, with the rules of the fields applied: the first rule broken gives ``invalid_<name>`` at its field."""
    rows = split_records(df, line, [f.name for f in fields])
    reason, offset = F.col("_reason"), F.col("_offset")
    for i, field in enumerate(fields):
        if field.ok is not None:
            broken = F.col("_fields").isNotNull() & ~F.coalesce(field.ok, F.lit(False))
            reason = F.coalesce(reason, F.when(broken, F.lit(f"invalid_{field.name}")))
            offset = F.coalesce(offset, F.when(broken, F.col("_starts")[i]))
    return rows.withColumns({"_reason": reason, "_offset": offset})


def typed_rows(checked: DataFrame, fields: Sequence[Field], keep: Sequence[str]) -> DataFrame:
    """Valid records with typed fields. A kept column with the name of a field gives way to the field."""
    names = {f.name.lower() for f in fields}
    value = [(f.typed if f.typed is not None else F.nullif(parsing.stripped(F.col("_fields")[i]), F.lit(""))).alias(f.name) for i, f in enumerate(fields)]
    return checked.where(F.col("_reason").isNull()).select(*[c for c in keep if c.lower() not in names], *value)


def rejected_rows(checked: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Every other record with the reason and the offset of the character or field it is about."""
    return checked.where(F.col("_reason").isNotNull()).select(*keep, F.col("_reason").alias("reason"), F.col("_offset").alias("error_offset"))
