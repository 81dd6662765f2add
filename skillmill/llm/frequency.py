"""Problem 3: how often, and in how many records, each distinct term occurs; too rare and too common ones marked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load, settled, spread

#: A term in fewer records than this is rare; one in a larger share of the records than the second is common.
FEWEST_ROWS, LARGEST_SHARE = 5, 0.4
#: Not only white space, as Python's strip() has it.
NOT_BLANK = r"(?U)[^\s\x1c-\x1f]"


def per_record_counts(terms: Column) -> Column:
    """array<struct<term, n>> of an array of terms: sorted, then run lengths. Null terms are left out."""

    def once(value: Column, use: Callable[[Column], Column]) -> Column:
        """``use(value)`` with ``value`` computed once, as a lambda's variable."""
        return F.element_at(F.transform(F.array(value), use), 1)

    def runs(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.element_at(s, i) != F.get(s, i - 2)))
        return once(first, lambda f: F.transform(f, lambda at, k: F.struct(F.element_at(s, at).alias("term"), (F.coalesce(F.get(f, k + 1), F.size(s) + 1) - at).cast("bigint").alias("n"))))

    own = F.array_sort(F.filter(terms, lambda t: t.isNotNull()))
    return once(own, lambda s: F.when(F.size(s) > 0, runs(s)))


def term_frequencies(records: DataFrame, terms: str = "terms", fewest_rows: int = FEWEST_ROWS, largest_share: float = LARGEST_SHARE, by: str | None = None) -> DataFrame:
    """``term, n_occurrences, n_rows, rare, common`` over all rows of ``records`` (and ``by``, for each value of it).

    ``terms`` is array<string>; each row is one record, one whose array is null or empty too: it counts among
    the records of which the share is taken. Method: counts within each record, hash aggregation before the
    shuffle on the term, then sums; a term that every record holds reaches the shuffle once from each task.
    Ties need no order, as the result is a set. An empty table gives no rows. Other columns are not read.
    """
    key = [by] if by else []
    counts = records.select(*key, F.explode_outer(per_record_counts(F.col(terms))).alias("c")).where("c is not null")  # a plain explode computes the array twice
    sums = counts.groupBy(*key, F.col("c.term").alias("term")).agg(F.sum("c.n").alias("n_occurrences"), F.count("*").alias("n_rows"))
    if by:
        total = records.groupBy(by).agg(F.count("*").alias("n_all"))  # one row for each value of ``by``
        joined = sums.join(settled(total)[0], by)
    else:
        joined = sums.withColumn("n_all", F.lit(records.count()))
    return joined.select(
        *key, "term", "n_occurrences", "n_rows", (F.col("n_rows") < fewest_rows).alias("rare"), (F.col("n_rows") > largest_share * F.col("n_all")).alias("common")
    )


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = load(spark, sf_dir, "resume").select("Resume_str").where(F.col("Resume_str").rlike(NOT_BLANK))
    texts = spread(texts).select(F.lit("resume").alias("src"), F.expr("regexp_extract_all(lower(Resume_str), '[a-z]{2,}', 0)").alias("terms"))
    maps = load(spark, sf_dir, "final_skills").select("aliases_by_canonical").where("size(aliases_by_canonical) > 0")
    strip = F.expr(r"filter(transform(flatten(filter(map_values(aliases_by_canonical), x -> x is not null)), a -> lower(regexp_replace(a, r'(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z', ''))), a -> a <> '')")
    return texts.unionByName(spread(maps).select(F.lit("final_skills").alias("src"), strip.alias("terms")))


def p3_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_frequencies(_records(spark, sf_dir), by="src")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.filter(F.array(F.when(F.col("rare"), "rare"), F.when(F.col("common"), "common")), lambda m: m.isNotNull())
    return p3_terms(spark, sf_dir).select("src", "term", F.explode(marks).alias("mark"))


_COUNTS = r"""
WITH recs AS (
  SELECT 'resume' AS src, row_id AS id, regexp_extract_all(lower(Resume_str), '[a-z]{2,}') AS terms
  FROM resume WHERE regexp_matches(Resume_str, '[^\s\p{Z}\x0b\x1c-\x1f\x85]')
  UNION ALL
  SELECT 'final_skills', build_id,
    list_filter(list_transform(flatten(list_filter(map_values(aliases_by_canonical), lambda x: x IS NOT NULL)),
      lambda a: lower(regexp_replace(a, '^[\s\p{Z}\x0b\x1c-\x1f\x85]+|[\s\p{Z}\x0b\x1c-\x1f\x85]+$', '', 'g'))), lambda a: a <> '')
  FROM final_skills WHERE cardinality(aliases_by_canonical) > 0
), totals AS (SELECT src, count(*) AS n_all FROM recs GROUP BY src),
occ AS (SELECT src, id, unnest(terms) AS term FROM recs),
sums AS (SELECT src, term, count(*) AS n_occurrences, count(DISTINCT id) AS n_rows FROM occ WHERE term IS NOT NULL GROUP BY src, term),
marked AS (SELECT src, term, n_occurrences, n_rows, n_rows < 5 AS rare, n_rows > 0.4 * n_all AS common FROM sums JOIN totals USING (src))
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p3_found": p3_found, "p3_terms": p3_terms}
SQL: dict[str, str] = {
    "p3_terms": _COUNTS + "SELECT src, term, n_occurrences, n_rows, rare, common FROM marked",
    "p3_found": _COUNTS + "SELECT src, term, 'rare' AS mark FROM marked WHERE rare UNION ALL SELECT src, term, 'common' FROM marked WHERE common",
}
