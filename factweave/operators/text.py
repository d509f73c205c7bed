"""Lexical and vector retrieval. Statistics come from the rows that are searched, so filters go first."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import text as T
from factweave.operators.ranking import checked_limit

#: Fixed values of the ranking function.
K1, B = 1.5, 0.75
#: Parts an index is written in.
SHELVES = 64


def bm25(docs: DataFrame, doc: str, text: str, query: Sequence[str], limit: int | None = None) -> DataFrame:
    """doc and ``score`` of the documents that hold a query token, best first.

    ``docs`` is what remains after filters and candidates; its number, mean length and document frequencies decide
    the scores. Rows are ordered and cut by the exact score, then doc; the score shown is rounded to 6. Repeated query tokens count as often as given. Only per-document counts of query tokens are computed:
    nothing is exploded, and nothing but the one row of statistics is broadcast.
    """
    weights: dict[str, int] = {}
    for q in query:
        weights[q.lower()] = weights.get(q.lower(), 0) + 1
    terms = list(weights)
    if not terms:
        return docs.select(doc, F.lit(0.0).alias("score")).limit(0)
    held = docs.select(doc, T.tokens(F.col(text)).alias("_t"))
    equals = lambda q: lambda x: x == F.lit(q)
    tf = [F.size(F.filter("_t", equals(q))).alias(f"_tf{i}") for i, q in enumerate(terms)]
    rows = held.select(doc, F.size("_t").alias("_len"), *tf)
    stats = rows.agg(F.count(F.lit(1)).cast("double").alias("_n"), F.avg("_len").alias("_avg"), *[F.count_if(F.col(f"_tf{i}") > 0).cast("double").alias(f"_df{i}") for i in range(len(terms))])
    # one row; as a scalar subquery the score would inline the tokens into every term and extract them again each time
    both = rows.join(F.broadcast(stats.select(F.struct("*").alias("_s"))))
    score = F.lit(0.0)
    for i, q in enumerate(terms):
        idf = F.log(1 + (F.col("_s._n") - F.col(f"_s._df{i}") + 0.5) / (F.col(f"_s._df{i}") + 0.5))
        freq = F.col(f"_tf{i}").cast("double")
        score += weights[q] * idf * freq * (K1 + 1) / (freq + K1 * (1 - B + B * F.col("_len") / F.col("_s._avg")))
    # a plain comparison would have Catalyst infer that the counts are not null, and extract the tokens again to check it
    return _best(both.select(doc, score.alias("score")).where(F.coalesce("score", F.lit(0.0)) > 0), doc, limit)


def _best(scored: DataFrame, key: str, limit: int | None) -> DataFrame:
    """The first rows by exact score, then key, with the score rounded for output."""
    rows = scored.orderBy(F.desc("score"), key).limit(checked_limit(limit)) if limit else scored
    return rows.withColumn("score", F.round("score", 6))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(vectors: DataFrame, key: str, vector: str, query: Sequence[float], limit: int | None = None) -> DataFrame:
    """key and ``score`` = dot product with a query of length 1, best first; a zero query finds nothing."""
    if not any(query):
        return vectors.select(key, F.lit(0.0).alias("score")).limit(0)
    return _best(vectors.where(F.col(vector).isNotNull()).select(key, dot(F.col(vector), F.array(*[F.lit(float(q)) for q in query])).alias("score")), key, limit)


def token_stats(docs: DataFrame, group: Sequence[str], text: str) -> DataFrame:
    """Documents, tokens and mean length by group."""
    rows = docs.select(*group, F.size(T.tokens(F.col(text))).alias("_n"))
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("documents"), F.sum("_n").alias("tokens"), F.round(F.avg("_n"), 6).alias("mean_tokens"))


def completeness(found: DataFrame, limit: int) -> DataFrame:
    """One row: hits and whether the window of ``limit`` holds all; look one row ahead, never count all."""
    return found.limit(limit + 1).agg(F.least(F.count(F.lit(1)), F.lit(limit)).alias("returned"), (F.count(F.lit(1)) <= limit).alias("complete"))


def pending_documents(current: DataFrame, indexed: DataFrame, doc: str, text: str) -> DataFrame:
    """Documents whose text is not indexed yet: anti-join on id and content hash."""
    hashed = current.withColumn("text_sha256", F.sha2(F.col(text), 256))
    return hashed.join(indexed.select(doc, "text_sha256"), [doc, "text_sha256"], "left_anti")


def token_index(docs: DataFrame, doc: str, text: str, normalize: bool = True) -> DataFrame:
    """doc, token, tf, length: the index that lexical search reads instead of texts.

    Texts are brought to NFKC first, so that full-width letters are found; written once, partitioned by ``shelf``, a
    hash of the token, the query's tokens reach only their own shelves.
    """
    words = docs.select(doc, T.tokens(T.search_form(F.col(text)) if normalize else F.col(text)).alias("_t"))
    rows = words.select(doc, F.size("_t").alias("length"), F.explode("_t").alias("token"))
    return rows.groupBy(doc, "token", "length").agg(F.count(F.lit(1)).cast("int").alias("tf")).withColumn("shelf", F.pmod(F.xxhash64("token"), F.lit(SHELVES)).cast("int"))


def write_index(index: DataFrame, lengths: DataFrame, path: str) -> None:
    """Write the index and the documents' lengths (doc, length, text_sha256) below path."""
    index.write.mode("overwrite").partitionBy("shelf").parquet(f"{path}/tokens")
    lengths.write.mode("overwrite").parquet(f"{path}/documents")


def document_lengths(docs: DataFrame, doc: str, text: str, normalize: bool = True) -> DataFrame:
    """doc, length, text_sha256 of all documents, those without tokens too."""
    words = T.tokens(T.search_form(F.col(text)) if normalize else F.col(text))
    return docs.select(doc, F.coalesce(F.size(words), F.lit(0)).alias("length"), F.sha2(F.col(text), 256).alias("text_sha256"))


def bm25_indexed(index: DataFrame, documents: DataFrame, doc: str, query: Sequence[str], limit: int | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """doc, ``score``, ``rank`` as ``bm25`` gives them, from an index; statistics are those of the candidates.

    Only postings of the query's tokens are read; they meet their document frequencies, one row per token of the query.
    """
    weights: dict[str, int] = {}
    for q in query:
        weights[q.lower()] = weights.get(q.lower(), 0) + 1
    known = documents if candidates is None else documents.join(candidates.select(doc), doc, "left_semi")
    hits = index.where(F.col("token").isin(list(weights)))
    hits = hits if candidates is None else hits.join(candidates.select(doc), doc, "left_semi")
    df = hits.groupBy("token").agg(F.count(F.lit(1)).cast("double").alias("_df"))
    # one row; as two scalar subqueries the documents would be read twice
    stats = known.agg(F.count(F.lit(1)).cast("double").alias("_n"), F.avg("length").alias("_avg"))
    per_token = df.join(F.broadcast(stats))
    weight = F.try_element_at(F.create_map(*[F.lit(x) for q, n in weights.items() for x in (q, float(n))]), F.col("token"))
    freq = F.col("tf").cast("double")
    part = weight * F.log(1 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5)) * freq * (K1 + 1) / (freq + K1 * (1 - B + B * F.col("length") / F.col("_avg")))
    scored = hits.join(F.broadcast(per_token), "token").groupBy(doc).agg(F.sum(part).alias("score")).where("score > 0")
    return with_rank(_best(scored, doc, limit), doc) if limit else _best(scored, doc, None)


def with_rank(found: DataFrame, doc: str) -> DataFrame:
    """A bounded result (a top list) with ``rank`` from 1, best first."""
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), doc)))


def document_build(rows: DataFrame, text: str, sentinels: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(documents, counts): texts that are no blank and no sentinel, and one row of what was left out and repeated.

    ``counts`` has rows, missing, sentinel, documents and duplicates (texts that repeat an earlier one).
    """
    plain = F.nullif(F.trim(F.col(text)), F.lit(""))
    state = F.when(plain.isNull(), "missing").when(F.lower(plain).isin([x.lower() for x in sentinels]), "sentinel").otherwise("document")
    judged = rows.withColumn("_state", state)
    documents = judged.where("_state = 'document'").drop("_state")
    counts = judged.groupBy("_state", F.when(F.col("_state") == "document", F.xxhash64(text)).alias("_h"), F.when(F.col("_state") == "document", F.sha2(F.col(text), 256)).alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    of = lambda name: F.coalesce(F.sum(F.when(F.col("_state") == name, F.col("_n"))), F.lit(0))
    return documents, counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), of("missing").alias("missing"), of("sentinel").alias("sentinel"), of("document").alias("documents"), F.coalesce(F.sum(F.when(F.col("_state") == "document", F.col("_n") - 1)), F.lit(0)).alias("duplicates"))


def search_filters(filters: dict, fixed: dict, dropped: Sequence[str]) -> dict:
    """Filters of a search over the fact store's documents: fixed ones win, those only the store can answer are dropped."""
    return {**{k: v for k, v in filters.items() if k not in dropped}, **fixed}


def vector_index(docs: DataFrame, doc: str, text: str, embed: Callable[[Column], Column] = T.hash_embedding, known: DataFrame | None = None) -> DataFrame:
    """doc, text_sha256, embedding; any function from a text column to an array column will do.

    Texts that ``known`` (text_sha256, embedding) holds keep their vector, and equal texts are embedded once.
    """
    hashed = docs.where(F.col(text).isNotNull()).select(doc, F.sha2(F.col(text), 256).alias("text_sha256"), F.col(text).alias("_text"))
    new = hashed.select("text_sha256", "_text").dropDuplicates(["text_sha256"])
    if known is not None:
        new = new.join(known.select("text_sha256"), "text_sha256", "left_anti")
    vectors = new.select("text_sha256", embed(F.col("_text")).alias("embedding"))
    if known is not None:
        vectors = vectors.unionByName(known.select("text_sha256", "embedding").dropDuplicates(["text_sha256"]))
    return hashed.drop("_text").join(vectors, "text_sha256")
