"""Token counts (method: exact length histogram and its suffix sums)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm.bpe_codec import lengths
from codeloom.llm.common import read, written

#: Lengths of one block; suffix sums run within blocks and over the blocks' totals, never over all lengths in one task.
BLOCK = 1024


def histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """n_tokens and n_docs: documents by encoded length. A null text counts as empty (length 0); repeated rows count each time; no rows give an empty histogram."""
    return lengths(docs, path).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length L that occurs, taken as a context limit: n_tokens (L), n_docs (of exactly L), docs_at_least and
    tokens_at_least (of documents of L and more), truncated_tokens (sum over all documents of min(length, L)),
    total_docs, total_tokens, and quantile (share of documents of at most L).

    Between two lengths that occur, truncated tokens are linear in the limit (see at_limits), so this answers every limit.
    """
    h = written(hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)), "lengths")
    over = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    after = blocks.select("block", F.coalesce(F.sum("d").over(over), F.lit(0)).alias("later_docs"), F.coalesce(F.sum("t").over(over), F.lit(0)).alias("later_tokens"))
    totals = h.agg(F.sum("n_docs").alias("total_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("total_tokens"))
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    docs = F.sum("n_docs").over(within) + F.col("later_docs")
    tokens = F.sum(F.col("n_docs") * F.col("n_tokens")).over(within) + F.col("later_tokens")
    out = h.join(after, "block").select("n_tokens", "n_docs", docs.alias("docs_at_least"), tokens.alias("tokens_at_least")).crossJoin(F.broadcast(totals))
    return out.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"),
        "total_docs", "total_tokens",
        ((F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("total_docs")).alias("quantile"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """limit, docs_at_least, truncated_tokens for any list of context limits, from suffix_sums()."""
    t = sums.select("n_tokens", "n_docs", "total_docs", "total_tokens")
    parts = [t.agg(F.coalesce(F.sum(F.when(F.col("n_tokens") >= k, F.col("n_docs"))), F.lit(0)).alias("docs_at_least"), F.coalesce(F.sum(F.least("n_tokens", F.lit(k)) * F.col("n_docs")), F.lit(0)).alias("truncated_tokens")).select(F.lit(k).cast("long").alias("limit"), "docs_at_least", "truncated_tokens") for k in limits]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sums(histogram(read(spark, sf_dir, "documents")))
