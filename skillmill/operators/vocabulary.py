"""Mining a dictionary from a corpus: one- and two-word terms by document frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as cfg
from ..functions.text import exploded, let, not_blank


def terms_of(text: Column, stop_words: tuple[str, ...]) -> Column:
    """array<string>: words of two characters or more that are no stop words, and pairs of words that then follow each other."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)), lambda w: ~w.isin(*stop_words) if stop_words else F.lit(True))

    def both(ws: Column) -> Column:
        pairs = F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get(ws, i + 1)))
        return F.concat(ws, pairs)

    return F.element_at(F.transform(F.array(words), both), 1)


def count_terms(corpus: DataFrame, key: str = "doc_id", text: str = "text", min_df: int = 5, stop_words: tuple[str, ...] = cfg.STOP_WORDS) -> DataFrame:
    """``term, tf, df`` of terms in at least ``min_df`` documents. Null and blank texts hold none.

    Each document's terms are counted as (occurrence, first in its document), so that one hash aggregation,
    partial before its shuffle, gives both counts without a distinct one. ``key`` is not needed for that.
    """
    texts = corpus.where(not_blank(text)).select(terms_of(F.col(text), stop_words).alias("t"))
    firsts = lambda s: F.transform(s, lambda x, i: F.struct(x.alias("term"), F.when((i > 0) & (F.get(s, i - 1) == x), 0).otherwise(1).alias("first")))
    flagged = exploded(texts, [], let(F.array_sort("t"), firsts), "x")
    return flagged.groupBy(F.col("x.term").alias("term")).agg(F.count("*").alias("tf"), F.sum("x.first").cast("bigint").alias("df")).where(F.col("df") >= min_df)


def keeps_term(term: Column, generic: tuple[str, ...] = cfg.GENERIC_TERMS) -> Column:
    """No generic term, and every word longer than two characters."""
    return (term != "") & ~term.isin(*generic) & F.forall(F.split(term, " +"), lambda t: F.length(t) > 2)


def mine(corpus: DataFrame, key: str = "doc_id", text: str = "text", min_df: int = 5, max_terms: int = 2000, stop_words: tuple[str, ...] = cfg.STOP_WORDS) -> DataFrame:
    """``term, tf, df``: the ``max_terms`` most frequent terms that are kept; ties by name. An empty corpus gives none."""
    kept = count_terms(corpus, key, text, min_df, stop_words).where(keeps_term(F.col("term")))
    return kept.orderBy(F.desc("tf"), "term").limit(max_terms)


def as_dictionary(terms: DataFrame) -> DataFrame:
    return terms.select(F.col("term").alias("canonical"), F.col("term").alias("phrase"), F.lit(0).cast("bigint").alias("pos"))


def english_stop_words(spark) -> tuple[str, ...]:
    """Spark's own list, for ``stop_words``."""
    from pyspark.ml.feature import StopWordsRemover

    return tuple(StopWordsRemover.loadDefaultStopWords("english"))
