"""Subject areas of documents by latent semantic embedding and refined seed centroids.

Terms are words with their letter grams, hashed into a fixed number of features, so that no model grows with the
corpus. All documents make the term statistics and the truncated singular value decomposition (subspace iteration;
each pass sums one small matrix per task). Seed centroids come from labelled documents and the titles of the subjects,
one per subject and script, because either script has its own words. They are refined in rounds over all documents,
and the weight of a term with them: a term spread over subjects as the corpus is weighs nothing. At last sentences are
embedded with these weights, their centroids refined, and a document gets the subjects that enough of its sentences
are nearest to.

Texts are read once, into chunks of flat arrays of numbers; every pass works on those alone.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.session import checkpointed


@dataclass(frozen=True)
class Parameters:
    features: int = 1 << 15
    rank: int = 40
    #: Leading directions that only tell the scripts apart.
    skipped: int = 2
    power_passes: int = 3
    weight_rounds: int = 2
    sentence_rounds: int = 2
    #: Labelled documents that seed the centroids; of more, those with the least hash of their id.
    max_labelled: int = 20_000
    softness: float = 8.0
    #: Sentences nearer than this to a centroid, and of at least these parts of the mean length, are on a subject.
    near: float = 0.5
    strong: float = 0.25
    weak: float = 0.1
    #: Part of a document's sentences that makes a subject of it: midway between a passing mention (under a tenth) and a
    #: subject (a fifth), as single sentences are assigned with errors. On the hand labels of sf0.1 a fifth itself finds
    #: 94.4 % of the labels where this finds 95.4 %, with 95.0 and 94.7 % of the found labelled.
    share: float = 0.15
    #: Rows of a partial matrix in one message.
    block: int = 1024


TAG = re.compile(r"<[^<>]{1,80}>|&[A-Za-z#0-9]{2,8};")
BREAK = re.compile(r"(?<=[.!?。])\s+|\n+")
WORD = re.compile(r"[a-z]+|[가-힣]+")
NUMBER = re.compile(r"[0-9]+(?:[.,:/\-][0-9]+)*")


def sentences(text: str) -> list[str]:
    """Sentences without markup, in lower case, numbers as 0; headings (no end mark, under three words) are none."""
    text = TAG.sub(" ", unicodedata.normalize("NFKC", text)).lower()
    out = []
    for part in BREAK.split(text):
        part = NUMBER.sub("0", part.strip())
        n = len(WORD.findall(part))
        if n >= 3 or (n and part[-1] in ".!?。"):
            out.append(part)
    return out


def word_features(word: str, size: int) -> np.ndarray:
    if "가" <= word[0] <= "힣":
        padded = "^" + word
        grams = {padded[i : i + n] for n in (2, 3) for i in range(len(padded) - n + 1)}
    else:
        padded = f"^{word}$"
        grams = {padded[i : i + 4] for i in range(len(padded) - 3)}
    return np.array(sorted({zlib.crc32(g.encode()) % size for g in grams | {"=" + word}}), dtype=np.int64)


#: Rows summed at a time, and documents and characters that make a chunk (a longer text is a chunk of its own).
GATHER, CHUNK, CHUNK_LETTERS = 100_000, 4000, 4_000_000


def spread(counts: np.ndarray) -> np.ndarray:
    """0 as often as the first count says, 1 as the second, and so on."""
    return np.repeat(np.arange(len(counts)), counts)


@dataclass
class Chunk:
    """Some documents, read once and kept as flat arrays: sentences, their words, and the words' features.

    Sentences and words are numbered within the chunk; equal sentences are one. Word numbers say nothing outside, so no
    lexicon of the corpus is needed.
    """

    doc: np.ndarray  # the document of every sentence, and which sentence of the chunk it is
    sentence: np.ndarray
    korean: np.ndarray  # by sentence of the chunk
    lengths: np.ndarray
    word: np.ndarray  # words of all sentences of the chunk in a row
    features: np.ndarray  # of all words in a row, and how many each has
    counts: np.ndarray
    in_doc: np.ndarray  # how many words each document has, which, and their damped counts
    held: np.ndarray
    tf: np.ndarray
    by_word: np.ndarray  # the order of those by word, and of the features of words by feature
    by_feature: np.ndarray

    @staticmethod
    def of(texts: list[list[str] | None], size: int) -> Chunk:
        words: dict[str, int] = {}
        known: dict[str, int] = {}
        rows: list[list[int]] = []
        doc, sentence, korean = [], [], []
        for d, parts in enumerate(texts):
            for s in parts or ():
                i = known.get(s)
                if i is None:
                    i = known[s] = len(rows)
                    rows.append([words.setdefault(w, len(words)) for w in WORD.findall(s)])
                    korean.append(HANGUL.search(s) is not None)
                doc.append(d)
                sentence.append(i)
        features = [word_features(w, size) for w in words]
        lengths = np.fromiter(map(len, rows), np.int32, len(rows))
        flat = np.fromiter((w for r in rows for w in r), np.int32, int(lengths.sum()))
        doc_, sentence_ = np.array(doc, np.int32), np.array(sentence, np.int32)
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1] if len(lengths) else np.zeros(0, np.int64)
        n = lengths[sentence_] if len(sentence_) else np.zeros(0, np.int32)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        all_words = flat[np.repeat(starts[sentence_], n) + inner] if len(n) else np.zeros(0, np.int32)
        pairs, times = np.unique(np.repeat(doc_, n).astype(np.int64) * max(len(words), 1) + all_words, return_counts=True)
        in_doc = np.bincount(pairs // max(len(words), 1), minlength=len(texts)).astype(np.int32)
        counts = np.fromiter(map(len, features), np.int32, len(features))
        held = (pairs % max(len(words), 1)).astype(np.int32)
        all_features = np.concatenate(features).astype(np.int32) if features else np.zeros(0, np.int32)
        order = lambda x: np.argsort(x, kind="stable").astype(np.int32)
        return Chunk(doc_, sentence_, np.array(korean, np.int8), lengths, flat, all_features, counts, in_doc, held, (1 + np.log(times)).astype(np.float32), order(held), order(all_features))

    def packed(self) -> list[bytes]:
        return [getattr(self, name).tobytes() for name in CHUNK_ARRAYS]

    @staticmethod
    def unpacked(parts: list) -> Chunk:
        return Chunk(*(np.frombuffer(part, kind) for part, kind in zip(parts, CHUNK_ARRAYS.values())))

    @property
    def n(self) -> int:
        return len(self.in_doc)

    def embedded(self, matrix: np.ndarray) -> np.ndarray:
        """Mean of the matrix's rows over each word's features."""
        sums = gathered(matrix, self.features, spread(self.counts), len(self.counts))
        return (sums / np.maximum(self.counts, 1)[:, None]).astype(np.float32)

    def to_features(self, by_word: np.ndarray, size: int) -> np.ndarray:
        """Rows of words added to the rows of their features."""
        return gathered(by_word, spread(self.counts)[self.by_feature], self.features[self.by_feature], size)

    def scripts(self) -> np.ndarray:
        """1 for documents mostly in Korean sentences, else 0."""
        total = np.bincount(self.doc, minlength=self.n)
        return (np.bincount(self.doc, self.korean[self.sentence], minlength=self.n) * 2 > total).astype(np.int64)


#: The arrays of a chunk in order, with their types.
CHUNK_ARRAYS = {"doc": np.int32, "sentence": np.int32, "korean": np.int8, "lengths": np.int32, "word": np.int32, "features": np.int32, "counts": np.int32, "in_doc": np.int32, "held": np.int32, "tf": np.float32, "by_word": np.int32, "by_feature": np.int32}
HANGUL = re.compile("[가-힣]")


def gathered(matrix: np.ndarray, rows: np.ndarray, groups: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Weighted sums of a matrix's rows by group, worked off in blocks, so memory does not follow the text."""
    out = np.zeros((n, matrix.shape[1]), dtype=np.float64)
    if len(groups) and (groups[1:] < groups[:-1]).any():
        order = np.argsort(groups, kind="stable")
        rows, groups, weights = rows[order], groups[order], None if weights is None else weights[order]
    for i in range(0, len(groups), GATHER):
        g = groups[i : i + GATHER]
        values = matrix[rows[i : i + GATHER]]
        if weights is not None:
            values = values * weights[i : i + GATHER, None]
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        out[g[first]] += np.add.reduceat(values, first, axis=0, dtype=np.float64)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _read_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Scalar, Chunk]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(0)[i], Chunk.unpacked([batch.column(k + 1)[i].as_buffer() for k in range(len(CHUNK_ARRAYS))])


def _passes(chunks: DataFrame, p: Parameters, width: int, step: Callable[[Chunk], np.ndarray], by_word: bool, extra: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sum over all documents of a matrix of features x width (and of ``extra`` further rows).

    ``step`` gives rows for a chunk's words (or features), then the extra rows; words' rows go to their features. Each
    task sends its matrix once, in blocks, and blocks are added as they stream in. The result's size is fixed by the
    parameters.
    """
    rows = p.features + extra

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, width))
        for _, chunk in _read_chunks(batches):
            got = step(chunk)
            n = len(chunk.counts) if by_word else p.features
            total[: p.features] += chunk.to_features(got[:n], p.features) if by_word else got[:n]
            if extra:
                total[p.features :] += got[n:]
        at = [i for i in range(0, rows, p.block) if total[i : i + p.block].any()]
        yield pa.RecordBatch.from_arrays([pa.array([i // p.block for i in at], pa.int32()), pa.array([total[i : i + p.block].astype(np.float32).tobytes() for i in at], pa.binary())], names=["block", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.frombuffer(part, np.float32).astype(np.float64)
                sums[block] = sums[block] + values if block in sums else values
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.astype(np.float32).tobytes() for v in sums.values()], pa.binary())], names=["block", "part"])

    schema = "block int, part binary"
    parts = chunks.select("ids", *CHUNK_ARRAYS).mapInArrow(run, schema)
    partitions = chunks.rdd.getNumPartitions()
    if partitions > 512:  # in two steps, so no task adds up more than the root of their number
        parts = parts.repartition(int(partitions**0.5) * 8, "block", F.pmod(F.spark_partition_id(), F.lit(int(partitions**0.5)))).mapInArrow(add, schema)
    total = np.zeros((rows, width))
    for r in parts.repartition(min(64, max(1, partitions)), "block").mapInArrow(add, schema).collect():
        values = np.frombuffer(r["part"], np.float32).reshape(-1, width)
        total[r["block"] * p.block : r["block"] * p.block + len(values)] += values
    return total[: p.features], total[p.features :]


def _sentences_of(texts: DataFrame, keep: str) -> DataFrame:
    """``keep`` and the sentences of each text."""
    kind = dict(texts.dtypes)[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sentences(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], names=[keep, "sentences"])

    return texts.select(keep, "text").mapInArrow(run, f"{keep} {kind}, sentences array<string>")


def chunk_table(documents: DataFrame, size: int) -> DataFrame:
    """ids and the arrays of a chunk per row: every text cut and numbered once, for all passes to read.

    NULL or empty texts have no sentences. A chunk is bounded by documents and characters.
    """
    kind = dict(documents.dtypes)["doc_id"]
    names = ["ids", *CHUNK_ARRAYS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[list[str]] = []
        letters = 0

        def flush(of: pa.DataType) -> pa.RecordBatch:
            row = [pa.array([ids], pa.list_(of)), *(pa.array([x], pa.binary()) for x in Chunk.of(texts, size).packed())]
            return pa.RecordBatch.from_arrays(row, names=names)

        of = None
        for batch in batches:
            of = batch.column(0).type
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (len(ids) >= CHUNK or letters + len(t or "") > CHUNK_LETTERS):
                    yield flush(of)
                    ids, texts, letters = [], [], 0
                ids.append(i)
                texts.append(sentences(t or ""))
                letters += len(t or "")
        if ids:
            yield flush(of)

    context = documents.sparkSession.sparkContext
    texts = documents.select("doc_id", "text")
    wanted = max(context.defaultParallelism, texts.rdd.getNumPartitions())
    return checkpointed(texts.repartition(wanted).mapInArrow(run, f"ids array<{kind}>, " + ", ".join(f"{n} binary" for n in CHUNK_ARRAYS)))


class SubjectModel:
    """What classifies a sentence: feature matrix, centroids per subject and script, thresholds."""

    def __init__(self, subjects: list[str], p: Parameters) -> None:
        self.subjects, self.p = subjects, p
        self.matrix = np.zeros((p.features, p.rank - p.skipped), np.float32)
        self.centroids = np.zeros((2, len(subjects), p.rank - p.skipped))
        self.length = 1.0

    def parts(self) -> tuple:
        """Plain values for a broadcast, which carries no classes of this package."""
        return self.subjects, asdict(self.p), self.matrix, self.centroids, self.length

    @staticmethod
    def of(parts: tuple) -> SubjectModel:
        model = SubjectModel.__new__(SubjectModel)
        model.subjects, model.p, model.matrix, model.centroids, model.length = parts[0], Parameters(**parts[1]), *parts[2:]
        return model

    def doc_vectors(self, c: Chunk, emb: np.ndarray) -> np.ndarray:
        return unit(gathered(emb, c.held, spread(c.in_doc), c.n, c.tf))

    def posterior(self, vectors: np.ndarray, scripts: np.ndarray) -> np.ndarray:
        score = self.p.softness * np.einsum("nd,ncd->nc", vectors, self.centroids[scripts])
        e = np.exp(score - score.max(axis=1, keepdims=True)) if len(score) else score
        return e / np.maximum(e.sum(axis=1, keepdims=True), 1e-12)

    def sentence_vectors(self, c: Chunk, emb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the chunk's sentences: vectors, lengths and nearness to each subject's centroid in the sentence's script."""
        vectors = gathered(emb, c.word, spread(c.lengths), len(c.lengths))
        length = np.linalg.norm(vectors, axis=1)
        near = np.einsum("nd,ncd->nc", unit(vectors), self.centroids[c.korean.astype(np.int64)]) if len(vectors) else np.zeros((0, len(self.subjects)))
        return vectors, length, near


def _document_frequency(chunks: DataFrame, p: Parameters) -> tuple[np.ndarray, float]:
    def step(c: Chunk) -> np.ndarray:
        starts = np.cumsum(c.counts) - c.counts
        n = c.counts[c.held]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pairs = np.unique(np.repeat(spread(c.in_doc), n) * p.features + c.features[np.repeat(starts[c.held], n) + inner]) if len(n) else np.zeros(0, np.int64)
        out = np.zeros((p.features + 1, 1))
        out[: p.features, 0] = np.bincount(pairs % p.features, minlength=p.features)
        out[p.features, 0] = c.n
        return out

    df, n = _passes(chunks, p, 1, step, by_word=False, extra=1)
    return df[:, 0], float(n[0, 0])


def _singular_vectors(chunks: DataFrame, idf: np.ndarray, p: Parameters) -> np.ndarray:
    """The leading right singular vectors of the weighted document-feature matrix with rows of length 1."""
    basis = np.linalg.qr(np.random.default_rng(7).standard_normal((p.features, p.rank)))[0]
    for _ in range(p.power_passes):
        weighted = chunks.sparkSession.sparkContext.broadcast((idf[:, None] * basis).astype(np.float32))

        def step(c: Chunk, weighted=weighted) -> np.ndarray:
            owner = spread(c.in_doc)
            vectors = unit(gathered(c.embedded(weighted.value), c.held, owner, c.n, c.tf)).astype(np.float32)
            return gathered(vectors, owner[c.by_word], c.held[c.by_word], len(c.counts), c.tf[c.by_word]) / np.maximum(c.counts, 1)[:, None]

        total, _ = _passes(chunks, p, p.rank, step, by_word=True)
        weighted.unpersist()
        basis = np.linalg.qr(idf[:, None] * total)[0]
    return basis[:, p.skipped :]


def _seed_centroids(model: SubjectModel, seeds: Chunk, which: list[list[int]]) -> np.ndarray:
    """Centroids from the bounded sample of labelled documents: mean of a subject less the mean of all, by script."""
    vectors, scripts = model.doc_vectors(seeds, seeds.embedded(model.matrix)), seeds.scripts()
    label = np.zeros((seeds.n, len(model.subjects)))
    for i, own in enumerate(which):
        label[i, own] = 1
    out = np.zeros((2, len(model.subjects), vectors.shape[1]))
    for c in range(len(model.subjects)):
        for s in (0, 1):
            members = (label[:, c] > 0) & (scripts == s)
            if not members.any():
                members = label[:, c] > 0
            if members.any():
                out[s, c] = unit(vectors[members].mean(axis=0) - vectors[scripts == s].mean(axis=0) if (scripts == s).any() else vectors[members].mean(axis=0))
    return out


def fit(documents: DataFrame, chunks: DataFrame, labels: DataFrame, subjects: DataFrame, p: Parameters) -> SubjectModel:
    """The model of a corpus. Only matrices of fixed size, the subject table (one row per subject) and the bounded seeds
    reach the driver.
    """
    titles = sorted((r["subject"], r["title"] or "") for r in subjects.select("subject", "title").dropna(subset=["subject"]).distinct().collect())
    names = sorted({s for s, _ in titles})
    model = SubjectModel(names, p)
    sample = labels.select("doc_id", F.trim("subject").alias("subject")).where(F.col("subject").isin(names)).groupBy("doc_id").agg(F.collect_set("subject").alias("s")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.max_labelled)
    texts = _sentences_of(documents.select("doc_id", "text").join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi"), "doc_id")
    labelled = sorted(texts.join(sample, "doc_id").select("doc_id", "sentences", "s").collect(), key=lambda r: r["doc_id"])
    which = [[names.index(x) for x in r["s"]] for r in labelled] + [[names.index(name)] for name, _ in titles]
    seeds = Chunk.of([r["sentences"] for r in labelled] + [sentences(f"{title} {title} {name}") for name, title in titles], p.features)
    df, n = _document_frequency(chunks, p)
    idf = np.where(df > 0, np.log((n + 1) / (df + 1)), 0.0)
    vectors = _singular_vectors(chunks, idf, p)
    topical, c = np.ones(p.features), len(names)
    context = chunks.sparkSession.sparkContext
    for _ in range(p.weight_rounds):
        model.matrix = ((topical * idf)[:, None] * vectors).astype(np.float32)
        model.centroids = _seed_centroids(model, seeds, which)
        shared = context.broadcast(model.parts())

        def step(k: Chunk, shared=shared) -> np.ndarray:
            m = SubjectModel.of(shared.value)
            post = m.posterior(m.doc_vectors(k, k.embedded(m.matrix)), k.scripts())
            return np.concatenate([gathered(post, spread(k.in_doc)[k.by_word], k.held[k.by_word], len(k.counts)), post.sum(axis=0, keepdims=True)])

        counts, corpus = _passes(chunks, p, c, step, by_word=True, extra=1)
        shared.unpersist()
        prior = np.maximum(corpus[0] / max(corpus[0].sum(), 1e-12), 1e-6)
        have = counts.sum(axis=1, keepdims=True)
        q = (counts + 20 * prior) / (have + 20)
        topical = np.maximum((q * np.log(q / prior)).sum(axis=1), 0.0)
    model.matrix = ((topical * idf)[:, None] * vectors).astype(np.float32)
    model.centroids = _seed_centroids(model, seeds, which)
    width = model.matrix.shape[1]
    for turn in range(p.sentence_rounds + 1):
        shared = context.broadcast(model.parts())

        def step(k: Chunk, shared=shared, first=turn == 0) -> np.ndarray:
            m = SubjectModel.of(shared.value)
            emb = k.embedded(m.matrix)
            vectors, length, near = m.sentence_vectors(k, emb)
            out = np.zeros((p.features + 2 * c, width + 2))
            if not len(vectors):
                return out
            if first:
                order = np.argsort(k.sentence, kind="stable")
                weight = gathered(m.posterior(m.doc_vectors(k, emb), k.scripts()), k.doc[order], k.sentence[order], len(vectors))
            else:
                weight = np.zeros_like(near)
                best = near.argmax(axis=1)
                on = (near.max(axis=1) > m.p.near) & (length > m.p.weak * m.length)
                weight[np.flatnonzero(on), best[on]] = np.bincount(k.sentence, minlength=len(vectors))[on]
            for s in (0, 1):
                w = weight * (k.korean == s)[:, None]
                at = p.features + s * c
                out[at : at + c, :width] = w.T @ vectors
                out[at : at + c, width] = w.sum(axis=0)
                out[at : at + c, width + 1] = w.T @ length
            return out

        _, sums = _passes(chunks, p, width + 2, step, by_word=False, extra=2 * c)
        shared.unpersist()
        sums = sums.reshape(2, c, width + 2)
        known = sums[:, :, width] > 1e-9
        new = unit(sums[:, :, :width])
        if turn == 0:
            new = unit(new - 0.5 * np.stack([new[s][known[s]].mean(axis=0) if known[s].any() else np.zeros(width) for s in (0, 1)])[:, None, :])
        model.centroids = np.where(known[:, :, None], new, model.centroids)
        if sums[:, :, width].sum() > 0:
            model.length = float(sums[:, :, width + 1].sum() / sums[:, :, width].sum())
    return model


def assign(chunks: DataFrame, model: SubjectModel) -> DataFrame:
    """doc_id, subject, share: the subjects of each document with the part of its sentences on each.

    Sentences with little weight go to the nearest subject the document treats anyway. A document in which no subject
    reaches the share gets its largest, as every text must have one; one without sentences gets none.
    """
    shared = chunks.sparkSession.sparkContext.broadcast(model.parts())
    kind = dict(chunks.dtypes)["ids"][len("array<") : -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = SubjectModel.of(shared.value)
        c = len(m.subjects)
        for ids, k in _read_chunks(batches):
            if not len(k.doc) or not c:
                continue
            emb = k.embedded(m.matrix)
            _, length, near = m.sentence_vectors(k, emb)
            length, near = length[k.sentence], near[k.sentence]
            n = np.maximum(np.bincount(k.doc, minlength=k.n), 1)[:, None]
            best, top = near.argmax(axis=1), near.max(axis=1)
            strong = (top > m.p.near) & (length > m.p.strong * m.length)
            counts = np.zeros((k.n, c))
            np.add.at(counts, (k.doc[strong], best[strong]), 1)
            weak = ~strong & (length > m.p.weak * m.length)
            has = counts > 0
            open_near = np.where(has[k.doc], near, -1.0)
            open_best, open_top = open_near.argmax(axis=1), open_near.max(axis=1)
            told = weak & (open_top > m.p.near / 2)
            alone = weak & ~has.any(axis=1)[k.doc] & (top > m.p.near)
            weak_counts = np.zeros((k.n, c))
            np.add.at(weak_counts, (k.doc[told], open_best[told]), 1)
            np.add.at(weak_counts, (k.doc[alone], best[alone]), 1)
            share = (counts + weak_counts) / n
            chosen = share >= m.p.share
            lacking = ~chosen.any(axis=1) & (np.bincount(k.doc, minlength=k.n) > 0)
            if lacking.any():
                post = m.posterior(m.doc_vectors(k, emb), k.scripts())
                first = np.where(share.any(axis=1), share.argmax(axis=1), post.argmax(axis=1))
                chosen[np.flatnonzero(lacking), first[lacking]] = True
            d, s = np.nonzero(chosen)
            yield pa.RecordBatch.from_arrays([ids.values.take(pa.array(d)), pa.array([m.subjects[i] for i in s], pa.string()), pa.array(share[d, s], pa.float64())], names=["doc_id", "subject", "share"])

    return chunks.select("ids", *CHUNK_ARRAYS).mapInArrow(run, f"doc_id {kind}, subject string, share double")


def document_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, p: Parameters | None = None) -> DataFrame:
    """doc_id, subject, share for all documents. Texts are cut and numbered once; all passes read the numbers."""
    p = p or Parameters()
    chunks = chunk_table(documents, p.features)
    return assign(chunks, fit(documents, chunks, labels, subjects, p))
