"""Keyword search, retrieval metrics and one-dimensional clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ranking import running_sum, shifted


def bm25(docs: DataFrame, key: str, text: str, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of the texts that hold any of the terms. One scan counts the corpus, one scores it; no shuffle of text."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)
    w = docs.where(F.col(text).isNotNull()).select(key, words.alias("w"))

    def occurrences(term: str):
        return F.size(F.filter("w", lambda x: x == term))

    tf = w.select(key, F.size("w").alias("dl"), *[occurrences(t).alias(f"tf{i}") for i, t in enumerate(terms)])
    stats = tf.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("l"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        f, df = F.col(f"tf{i}"), F.col(f"df{i}")
        score = score + F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("dl") / F.col("l")))
    found = F.greatest(*[F.col(f"tf{i}") for i in range(len(terms))]) if len(terms) > 1 else F.col("tf0")
    return tf.join(F.broadcast(stats)).where(found > 0).select(key, F.round(score, 6).alias("score"))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, tf, dl): an inverted index with one row per term and text; texts without words have none.

    Written partitioned or sorted by term, a search reads its terms' rows only (``search_postings``).
    """
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)
    w = docs.where(F.col(text).isNotNull()).select(key, words.alias("w")).select(key, F.size("w").alias("dl"), F.explode("w").alias("term"))
    # a text's words are counted in its own task before anything is shuffled
    return w.groupBy("term", key, "dl").agg(F.count(F.lit(1)).cast("int").alias("tf")).select("term", key, "tf", "dl")


def write_postings(docs: DataFrame, key: str, text: str, path: str, files: int = 16) -> None:
    """Store the index sorted by term, with the corpus' counts beside it."""
    p = postings(docs, key, text)
    p.repartitionByRange(files, "term", key).sortWithinPartitions("term", key).write.mode("overwrite").parquet(f"{path}/postings")
    docs.where(F.col(text).isNotNull()).select(F.size(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)).alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("l")).write.mode("overwrite").parquet(f"{path}/corpus")


def search_postings(spark, path: str, key: str, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) by BM25 from a stored index: the filter on terms reaches the scan, and only their rows are read."""
    p = spark.read.parquet(f"{path}/postings").where(F.col("term").isin(sorted(set(terms))))
    df = p.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    c = spark.read.parquet(f"{path}/corpus")
    j = p.join(F.broadcast(df), "term").join(F.broadcast(c))
    score = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("l")))
    return j.groupBy(key).agg(F.round(F.sum(score), 6).alias("score"))


def metrics_at(runs: DataFrame, judged: DataFrame, ks: list[int]) -> DataFrame:
    """(query, k, recall, precision, rr, ndcg, covered) over (query, rank, relevant); ``judged`` holds (query, judged), the
    number of relevant items there are, over which the ideal gain is taken. Queries without any have zeros."""
    r = runs.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.col("rank") <= F.col("k"))
    m = r.groupBy("query", "k").agg(F.sum("relevant").alias("hits"), F.min(F.when(F.col("relevant") == 1, F.col("rank"))).alias("first"), F.sum(F.col("relevant") / F.log2(F.col("rank") + 1)).alias("dcg"))
    j = m.join(judged, "query", "left").fillna(0, ["judged"])
    best = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("k", F.col("judged").cast("int")))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    any_judged = F.col("judged") > 0
    return j.select("query", "k", F.round(F.when(any_judged, F.col("hits") / F.col("judged")).otherwise(0.0), 9).alias("recall"), F.round(F.col("hits") / F.col("k"), 9).alias("precision"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 9).alias("rr"), F.round(F.when(any_judged, F.col("dcg") / best).otherwise(0.0), 9).alias("ndcg"), (F.col("hits") > 0).alias("covered"))


def retrieval_metrics(runs: DataFrame, k: int) -> DataFrame:
    """Mean precision at k, reciprocal rank and discounted gain over (query, rank, relevant)."""
    top = runs.where(F.col("rank") <= k)
    q = top.groupBy("query").agg((F.sum("relevant") * 1.0 / k).alias("p"), F.coalesce(1.0 / F.min(F.when(F.col("relevant") == 1, F.col("rank"))), F.lit(0.0)).alias("rr"), F.sum(F.col("relevant") / F.log2(F.col("rank") + 1)).alias("dcg"))
    return q.agg(F.round(F.avg("p"), 9).alias(f"precision_{k}"), F.round(F.avg("rr"), 9).alias("mrr"), F.round(F.avg("dcg"), 9).alias("dcg"))


def gap_clusters(df: DataFrame, key: str, value: str, eps: float, order: str | None = None) -> DataFrame:
    """Density clusters of one dimension: sorted values whose gaps are at most ``eps`` belong together.

    ``order`` names a unique column that breaks ties; without it equal values must be unique per key. Null values are
    left out. Works by range blocks, so that a hot key is not sorted in one task.
    """
    total = [F.col(value), *([F.col(order)] if order else [])]
    w = shifted(df.where(F.col(value).isNotNull()), [key], total, value, "__prev", by=-1)
    w = w.withColumn("__new", F.when(F.col(value) - F.col("__prev") <= eps, 0).otherwise(1))
    return running_sum(w, [key], total, "__new", "cluster").drop("__new", "__prev")
