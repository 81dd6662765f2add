"""From documents to skills, levels and gaps in one plan, for any number of documents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as cfg
from ..config import Settings
from ..functions.text import exploded, sentences, strip
from ..operators import dictionary as dic
from ..operators import matching, results, similarity
from ..operators import vocabulary as voc
from ..session import settled, spread_by
from ..sources.tables import unite


@dataclass(frozen=True)
class Inputs:
    """``docs`` (doc_id, text), the ``entries`` of a dictionary, and optionally hits of the other extractors:
    ``vector_hits`` (doc_id, canonical, similarity) and ``model_skills`` (doc_id, item)."""

    docs: DataFrame
    entries: DataFrame
    vector_hits: DataFrame | None = None
    model_skills: DataFrame | None = None


def vector_hits(docs: DataFrame, entries: DataFrame, encoder: Callable[[], Callable[[list[str]], np.ndarray]], settings: Settings = Settings()) -> DataFrame:
    """``doc_id, canonical, similarity``: the most similar sentence of each document for each entry that it reaches the threshold of.

    Each distinct sentence is encoded once. Entries are those of the rules, by name.
    """
    # shuffled by sentence once, for the distinct ones and for the join
    parts = spread_by(exploded(docs, ["doc_id"], F.array_distinct(sentences("text")), "sentence"), "sentence")
    skills = similarity.encode(dic.for_rules(entries).select("canonical"), "canonical", encoder)
    hits = similarity.similarities(similarity.encode(parts, "sentence", encoder), skills, "sentence", "vector", "canonical", "vector", settings.similarity_threshold)
    return similarity.best_similarity(parts.join(hits, "sentence"), ["doc_id", "canonical"])


def hybrid(inputs: Inputs, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, skill, score, level, place`` by rules and vectors, ranked and cut to the most per document."""
    rows = dic.for_rules(inputs.entries)
    vector = inputs.vector_hits.where(F.col("similarity") >= settings.similarity_threshold) if inputs.vector_hits is not None else None
    hits = results.unite_hits(matching.match_rules(inputs.docs, rows), vector)
    return results.rank(results.add_levels(hits, inputs.docs, rows), "doc_id", settings.max_skills)


def analyse(inputs: Inputs, settings: Settings = Settings()) -> DataFrame:
    """``doc_id`` and the arrays keyword_skills, embedding_skills, model_skills, final_skills, final_structured of every document.

    A document in which nothing is found has empty arrays; so has every document where the dictionary is empty. Rows that
    share a ``doc_id`` have their hits united and keep a row each. The hits of all extractors go through one shuffle, then
    meet the texts in another; ranking, levels and normal names are read within the row.
    """
    entries, own = inputs.entries, F.col("canonical").alias("skill")
    none = F.lit(None).cast("double")
    tagged = lambda df, tag, skill, similarity=none: df.select("doc_id", F.lit(tag).alias("tag"), skill, similarity.alias("similarity"))
    hits = tagged(matching.phrase_hits(inputs.docs, dic.for_keywords(entries)), "keyword", own)
    rules = dic.for_rules(entries)
    if settings.enable_embeddings:
        hits = hits.unionByName(tagged(matching.rule_hits(inputs.docs, rules), "rule", own))
        if inputs.vector_hits is not None:
            near = inputs.vector_hits.where(F.col("similarity") >= settings.similarity_threshold)
            hits = hits.unionByName(tagged(near, "vector", own, F.col("similarity")))
    if inputs.model_skills is not None:
        hits = hits.unionByName(tagged(inputs.model_skills, "model", F.col("item").alias("skill")))
    # what each skill is called in the end, and by which names it is looked for in a text
    hits = hits.withColumn("phrase", F.lower(strip(F.col("skill"))))
    normal = settled(dic.last_writer(dic.for_flat_map(entries)).withColumnRenamed("canonical", "_normal"))[0]
    lists = settled(rules.groupBy(own).agg(F.array_sort(F.collect_set("phrase")).alias("_aliases")))[0]
    named = hits.join(normal, "phrase", "left").join(lists, "skill", "left")
    by_rule, engine = F.col("tag") == "rule", F.col("tag").isin("rule", "vector")
    united = (
        spread_by(named, "doc_id")
        .groupBy("doc_id", F.when(engine, "engine").otherwise(F.col("tag")).alias("tag"), "skill")
        .agg(F.bool_or(by_rule).alias("by_rule"), F.max("similarity").alias("similarity"), F.first("_aliases").alias("_aliases"), F.first(F.coalesce("_normal", "phrase")).alias("normal"))
        .withColumn("_aliases", F.when(F.col("tag") == "engine", F.coalesce("_aliases", F.array("skill"))))
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("tag", "skill", "by_rule", "similarity", "_aliases", "normal")).alias("h"))
    )
    met = inputs.docs.select("doc_id", "text").join(united, "doc_id", "left")
    of = lambda tag: F.filter("h", lambda x: x["tag"] == tag)
    score = lambda x: F.when(x["by_rule"], 2.0 + F.greatest(F.coalesce(x["similarity"], F.lit(0.0)), F.lit(0.0))).otherwise(x["similarity"])
    place = lambda x, level: F.struct((-score(x)).alias("score"), (-level).alias("level"), x["skill"].alias("skill"), x["normal"].alias("normal"))
    ranked = F.array_sort("e") if settings.max_skills <= 0 else F.slice(F.array_sort("e"), 1, settings.max_skills)
    met = results.with_levels(met.withColumn("e", of("engine")), "e", "text", place).withColumn("e", ranked)
    empty = F.array().cast("array<string>")
    names = lambda a, field="skill": F.coalesce(F.transform(a, lambda x: x[field]), empty)
    kept = F.filter(F.concat(names(of("keyword"), "normal"), names("e", "normal"), names(of("model"), "normal")), lambda n: n.isNotNull() & (n != "") & ~n.isin(*cfg.GENERIC_WORDS))
    level_of = lambda n, e: F.coalesce(F.get(F.filter(e, lambda x: x["skill"] == n), F.lit(0))["level"] * -1, F.lit(1))
    out = met.select("doc_id", "e", F.array_sort(names(of("keyword"))).alias("keyword_skills"), F.array_sort(names("e")).alias("embedding_skills"), F.array_sort(names(of("model"))).alias("model_skills"), F.array_sort(F.array_distinct(kept)).alias("final_skills"))
    return out.select("doc_id", "keyword_skills", "embedding_skills", "model_skills", "final_skills", F.transform("final_skills", lambda n: F.struct(n.alias("name"), level_of(n, F.col("e")).alias("level"))).alias("final_structured"))


def compare(pairs: DataFrame, analysed: DataFrame) -> DataFrame:
    """``pair_id`` and the four lists of the gap of each pair (pair_id, resume_id, job_id); an unknown document has no skills."""
    side = lambda n: analysed.select(F.col("doc_id").alias(f"{n}_id"), F.col("final_skills").alias(n))
    both = pairs.join(side("resume"), "resume_id", "left").join(side("job"), "job_id", "left")
    return both.select("pair_id", results.gap_arrays(F.col("resume"), F.col("job")).alias("g")).select("pair_id", "g.*")


def canonical_mentions(raw: DataFrame, rows: DataFrame, key: str, vectors: DataFrame | None = None, skills: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """``key, skill, score, confidence, sources, place`` of raw mentions (``key, name, context``), under the thresholds and the cap of ``settings``."""
    found = similarity.canonicalise(raw, rows, key, vectors=vectors, skills=skills, threshold=settings.normalizer_threshold, least=settings.fuzzy_ratio)
    return similarity.merge_mentions(found, key, most=settings.normalizer_max_skills)


def build_dictionary(*corpora: DataFrame, settings: Settings = Settings(), nouns: dic.Tagger | None = None) -> DataFrame:
    """``canonical, aliases`` mined from corpora, with the seeds merged in, then cleaned and filtered."""
    terms = voc.mine(unite(*corpora), min_df=settings.min_df, max_terms=settings.max_terms, stop_words=settings.mining_words())
    return dic.filter_entries(dic.clean_entries(dic.merge_seeds(voc.as_dictionary(terms))), nouns=nouns)


def health() -> dict[str, str]:
    return {"status": "ok"}


def as_json(analysed: DataFrame) -> DataFrame:
    """``doc_id, json``: the result of each document as one JSON object."""
    return analysed.select("doc_id", F.to_json(F.struct(*[c for c in analysed.columns if c != "doc_id"])).alias("json"))
