"""Flat lists of skills: normalised, ranked, given levels, compared; and model answers, parsed and validated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as cfg
from ..functions.levels import level_near, searchable
from ..functions.text import exploded, let, search_object, strip, without_fence, without_trailing_commas
from ..session import settled, spread_by
from .dictionary import last_writer


def normalise(flat: DataFrame, rows: DataFrame | None, key: str = "doc_id", skill: str = "skill") -> DataFrame:
    """``key, skill`` distinct: lower case, stripped, generic words and blanks left out, aliases replaced by the entry that lists
    them (the last writer wins, one step only); what no entry lists stays as it is. No dictionary: nothing is replaced."""
    named = flat.select(key, F.lower(strip(F.col(skill))).alias("phrase")).where(F.col("phrase").isNotNull() & (F.col("phrase") != "") & ~F.col("phrase").isin(*cfg.GENERIC_WORDS))
    if rows is None:
        return named.select(key, F.col("phrase").alias("skill")).distinct()
    return named.join(settled(last_writer(rows))[0], "phrase", "left").select(key, F.coalesce("canonical", "phrase").alias("skill")).distinct()


def first_spelling(items: DataFrame, key: str = "doc_id", pos: str = "pos", item: str = "item") -> DataFrame:
    """``key, item``: of spellings that differ in case only, the first one; stripped, blanks left out."""
    named = items.select(key, F.col(pos).alias("pos"), strip(F.col(item).cast("string")).alias("item")).where("item <> ''")
    return named.groupBy(key, F.lower("item").alias("low")).agg(F.min_by("item", "pos").alias("item")).drop("low")


def rank(hits: DataFrame, key: str = "doc_id", most: int = 25) -> DataFrame:
    """``key, skill, score, level, place`` of hits ``key, skill, by_rule, similarity, level``: a rule hit scores 2 and its similarity,
    another its similarity; placed by score, level, name. ``most`` of 0 or less keeps all."""
    score = F.when(F.col("by_rule"), 2.0 + F.greatest(F.coalesce("similarity", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("similarity"))
    w = Window.partitionBy(key).orderBy(F.desc("score"), F.desc("level"), "skill")
    placed = hits.select(key, "skill", score.alias("score"), "level").withColumn("place", F.row_number().over(w))
    return placed.where(F.col("place") <= most) if most > 0 else placed


def unite_hits(rule: DataFrame, vector: DataFrame | None, key: str = "doc_id", skill: str = "canonical") -> DataFrame:
    """``key, skill, by_rule, similarity`` of the union of rule hits and vector hits (with ``similarity``)."""
    a = rule.select(key, F.col(skill).alias("skill"), F.lit(True).alias("by_rule"), F.lit(None).cast("double").alias("similarity"))
    if vector is None:
        return a
    b = vector.select(key, F.col(skill).alias("skill"), F.lit(False).alias("by_rule"), "similarity")
    return a.unionByName(b).groupBy(key, "skill").agg(F.bool_or("by_rule").alias("by_rule"), F.max("similarity").alias("similarity"))


def add_levels(hits: DataFrame, docs: DataFrame, rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``hits`` with ``level``, read around the first mention; a skill that is no entry is its own alias.

    The hits of a document are brought together first, so that its text is shuffled once and read once."""
    lists = rows.groupBy(F.col("canonical").alias("skill")).agg(F.array_sort(F.collect_set("phrase")).alias("_aliases"))
    own = [c for c in hits.columns if c != key]
    named = hits.join(settled(lists)[0], "skill", "left")
    grouped = spread_by(named, key).groupBy(key).agg(F.collect_list(F.struct(*own, F.coalesce("_aliases", F.array("skill")).alias("_aliases"))).alias("_hits"))
    met = grouped.join(docs.select(key, F.col(text).alias("_text")), key)
    graded = with_levels(met, "_hits", "_text", lambda h, level: F.struct(*[h[c].alias(c) for c in own], level.alias("level")))
    return exploded(graded, [key], F.col("_hits"), "_hits").select(key, "_hits.*")


def with_levels(df: DataFrame, hits: str, text: str, use: Callable[[Column, Column], Column]) -> DataFrame:
    """``df`` with each of the array ``hits`` (structs with ``_aliases``) replaced by ``use(hit, level)``: a narrow map."""
    each = let(searchable(text), lambda hay: F.transform(hits, lambda h: use(h, level_near(F.col(text), h["_aliases"], hay=hay))))
    return df.withColumn(hits, each)


def attach_levels(final: DataFrame, levels: DataFrame, key: str = "doc_id") -> DataFrame:
    """``final`` with the level found for the skill of that name, else 1: a level is lost where the skill was renamed."""
    return final.join(levels.select(key, "skill", "level"), [key, "skill"], "left").withColumn("level", F.coalesce("level", F.lit(1)))


def gap_arrays(resume: Column, job: Column) -> Column:
    """struct of four sorted arrays: resume_skills, jd_skills, missing_skills, matching_skills. Names are stripped and lower-cased; null counts as empty."""
    own = lambda c: F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(strip(x))), lambda x: x.isNotNull() & (x != ""))))
    r, j = own(resume), own(job)
    return F.struct(r.alias("resume_skills"), j.alias("jd_skills"), F.array_except(j, r).alias("missing_skills"), F.array_intersect(j, r).alias("matching_skills"))


def gap_rows(resume: DataFrame, job: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(missing, matching) as rows ``key, skill``: what the job asks for without, and with, the resume's skills of that key."""
    own = lambda d: d.select(key, F.lower(strip(F.col("skill"))).alias("skill")).where("skill <> ''").distinct()
    r, j = own(resume), own(job)
    return j.join(r, [key, "skill"], "left_anti"), j.join(r, [key, "skill"], "left_semi")


# ---------------------------------------------------------------- model answers


def parse_flat(answers: DataFrame, key: str = "doc_id", raw: str = "raw") -> DataFrame:
    """``key, item`` of answers {"skills": [...]}, read strictly: anything else gives nothing. Items become strings, blanks are
    dropped, the first spelling wins."""
    own = F.col(raw)
    listed = lambda v: F.when(F.try_variant_get(v, "$.skills", "array<variant>").isNotNull(), F.from_json(F.get_json_object(own, "$.skills"), "array<string>"))
    return first_spelling(exploded(answers, [key], let(F.try_parse_json(own), listed), "item", "pos"), key)


ANSWER = "struct<skills: array<map<string,string>>>"


def repaired_objects(answers: DataFrame, key: str, raw: str) -> DataFrame:
    """``key, o``: the JSON object inside each answer: fence removed, first balanced object, trailing commas removed; null if there is none.

    An answer that is one object as a whole, as most are, is seen to be one without leaving the JVM."""
    inside = answers.select(key, without_fence(raw).alias("c"))
    seen = inside.select(key, "c", (F.col("c").startswith("{") & F.try_parse_json("c").isNotNull()).alias("whole"))
    return seen.select(key, without_trailing_commas(F.when(F.col("whole"), F.col("c")).otherwise(search_object(F.when(~F.col("whole"), F.col("c"))))).alias("o"))


def validate(answers: DataFrame, key: str = "doc_id", raw: str = "raw") -> DataFrame:
    """``key, skill_name, category, level, years_experience, evidence_text, confidence``: validated skills of each answer.

    All or nothing: one bad element makes the whole answer empty. Names, category and evidence become stripped text that
    must not be empty; the level is one of four; the confidence lies in 0..1; years may be missing. Numbers may be strings.
    """
    text = lambda m, k: F.when(F.map_contains_key(m, F.lit(k)), strip(F.coalesce(m[k], F.lit("None"))))
    number = lambda m, k: F.when(m[k] == "true", F.lit(1.0)).when(m[k] == "false", F.lit(0.0)).otherwise(m[k].try_cast("double"))

    def good(m: Column) -> Column:
        named = [F.coalesce(text(m, k) != "", F.lit(False)) for k in ("skill_name", "category", "evidence_text")]
        level = F.coalesce(F.lower(text(m, "level")).isin(*cfg.LEVELS), F.lit(False))
        sure = F.coalesce((number(m, "confidence") >= 0) & (number(m, "confidence") <= 1), F.lit(False))
        years = m["years_experience"].isNull() | number(m, "years_experience").isNotNull()
        return named[0] & named[1] & named[2] & level & sure & years & m.isNotNull()

    fine = lambda skills: F.when(F.forall(skills, good), skills)
    skills = let(F.when(F.try_parse_json("o").isNotNull(), F.from_json("o", ANSWER)["skills"]), fine)
    parsed = exploded(repaired_objects(answers, key, raw), [key], skills, "m")
    m = F.col("m")
    return parsed.select(
        key, text(m, "skill_name").alias("skill_name"), text(m, "category").alias("category"), F.lower(text(m, "level")).alias("level"),
        number(m, "years_experience").alias("years_experience"), text(m, "evidence_text").alias("evidence_text"), number(m, "confidence").alias("confidence"),
    )


def valid_record(name: Column, category: Column, level: Column, years: Column, evidence: Column, confidence: Column) -> Column:
    """The same rule for a record that is already in columns."""
    full = lambda c: F.coalesce(strip(c) != "", F.lit(False))
    return full(name) & full(category) & full(evidence) & F.coalesce(F.lower(strip(level)).isin(*cfg.LEVELS), F.lit(False)) & F.coalesce((confidence >= 0) & (confidence <= 1) & ~F.isnan(confidence), F.lit(False))
