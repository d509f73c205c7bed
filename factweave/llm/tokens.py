"""Sizes of documents in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary is a parameter; every executor reads it from this path.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how this family of vocabularies cuts text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer runs of text are encoded piece by piece at line breaks or blanks, which bounds a call's memory.
PIECE = 200_000


def encoder(path: str):
    """A function from text to its number of tokens, for a .tiktoken, .json or .model file."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("sizes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(encoding.encode_ordinary(text))
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda text: len(processor.encode(text, num_threads=1))


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in order, cut before a blank where one is near, so that no token crosses a cut."""
    at = 0
    while len(text) - at > size:
        cut = max(text.rfind(" ", at + size // 2, at + size), text.rfind("\n", at + size // 2, at + size))
        cut = cut if cut > at else at + size
        yield text[at:cut]
        at = cut
    yield text[at:]


def token_counts(documents: DataFrame, keep: list[str], text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``keep`` and ``tokens`` of every document; NULL and empty texts have 0. Texts are not shuffled."""
    source = documents.select(*keep, F.col(text).alias("_text"))
    types = dict(source.dtypes)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(tokenizer)
        for batch in batches:
            sizes = [sum(count(p) for p in pieces(t)) if t else 0 for t in batch.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(sizes, pa.int64())], names=[*keep, "tokens"])

    return source.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in keep) + ", tokens bigint")
