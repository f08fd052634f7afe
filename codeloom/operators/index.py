"""A stored search index: postings sorted by term, document lengths, term statistics and sparse norms, written once and read by term.

Each query reads the row groups of its own terms alone: the postings files are dealt by ranges of terms and sorted, so a
filter on terms reaches the scan and skips the rest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators import search
from codeloom.tables import written


@dataclass
class Index:
    """postings (id, term, tf); lengths (id, len); terms (term, df, idf, stop); stats (n, avg_len), one row; norms (id, norm) of the sparse vectors."""

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    stats: DataFrame
    norms: DataFrame

    def narrowed(self, texts: list[str]) -> "Index":
        """The index as far as the queries' terms need it. The terms are what a caller types; they become literals in the scans."""
        wanted = [r["term"] for r in search.queries(self.postings.sparkSession, texts).select("term").distinct().collect()]
        return Index(self.postings.where(F.col("term").isin(wanted)), self.lengths, self.terms.where(F.col("term").isin(wanted)), self.stats, self.norms)

    def bm25(self, texts: list[str]) -> DataFrame:
        """query, id, score."""
        own = self.narrowed(texts)
        return search.bm25(own.postings, own.lengths, search.queries(own.postings.sparkSession, texts), own.terms, own.stats)

    def sparse(self, texts: list[str]) -> DataFrame:
        """query, id, score: cosine with each query, its term weights being 1."""
        own = self.narrowed(texts)
        weights = search.weigh(own.postings, own.terms, own.stats)
        return search.sparse_search(weights, search.queries(own.postings.sparkSession, texts), own.norms)


def build(docs: DataFrame, files: int = 64, id_col: str = "id", text_col: str = "content") -> Index:
    """Reads each text once. files: ranges of terms, each a file."""
    counted = written(search.postings(docs, id_col, text_col), "counted")
    post = written(counted.repartitionByRange(files, "term").sortWithinPartitions("term"), "postings")
    lengths = written(search.doc_lengths(docs, counted, id_col), "lengths")
    stats = written(search.doc_stats(lengths), "stats")
    terms = written(search.term_stats(post, stats).repartitionByRange(files, "term").sortWithinPartitions("term"), "terms")
    norms = written(search.weigh(post, terms, stats).groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")), "norms")
    return Index(post, lengths, terms, stats, norms)
