"""Every query of the core, by name. Each runs over its whole tables; its SQL is in ``sql`` where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as tx
from ..functions.levels import first_mention, level_of, searchable
from ..operators import dictionary as dic
from ..operators import matching, results, similarity
from ..operators import vocabulary as voc
from ..session import load, settled, spread, spread_by
from ..sources.tables import resume_corpus, unite
from . import pipeline
from .sql import SQL  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(load(spark, d, "documents").select("doc_id", "text"))


def _reference(spark: SparkSession, d: str) -> DataFrame:
    """The fixed reference list as dictionary entries."""
    return load(spark, d, "canonical_skills").select("canonical", F.col("known_aliases").alias("aliases"), F.col("canonical_id").alias("pos"))


def _builds(spark: SparkSession, d: str) -> DataFrame:
    """The entries of all dictionary builds, as written."""
    return dic.entries_of_map(load(spark, d, "final_skills"), "aliases_by_canonical", "build_id")


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    return spread(load(spark, d, "skill"))


@query
def keyword_match(spark: SparkSession, d: str) -> DataFrame:
    return matching.match_phrases(_docs(spark, d), dic.for_keywords(_reference(spark, d)))


@query
def keyword_top(spark: SparkSession, d: str) -> DataFrame:
    return keyword_match(spark, d).groupBy("canonical").agg(F.count("*").alias("n_docs")).orderBy(F.desc("n_docs"), "canonical").limit(50)


@query
def rule_match(spark: SparkSession, d: str) -> DataFrame:
    return matching.match_rules(_docs(spark, d), dic.for_rules(_builds(spark, d)))


@query
def vocab_mine_topk(spark: SparkSession, d: str) -> DataFrame:
    return voc.mine(_docs(spark, d), min_df=5, max_terms=500)


@query
def vocab_min_df(spark: SparkSession, d: str) -> DataFrame:
    return voc.count_terms(_docs(spark, d), min_df=10)


@query
def corpus_clean(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", tx.clean_corpus_text("text").alias("text_clean"))


@query
def corpus_union_sources(spark: SparkSession, d: str) -> DataFrame:
    resume = resume_corpus(load(spark, d, "resume").select("row_id", "Resume_str", "Resume_html"), "row_id")
    pdf = load(spark, d, "extract_text_from_pdf").select(F.lit("pdf").alias("source"), F.col("parse_id").cast("string").alias("doc_id"), tx.clean_corpus_text("text").alias("text"))
    docs = load(spark, d, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").cast("string").alias("doc_id"), tx.clean_corpus_text("text").alias("text"))
    return unite(resume, pdf, docs).groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))


@query
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "resume").select("row_id", "Resume_html").where("Resume_html is not null")
    return spread(rows).select("row_id", tx.html_to_text_native("Resume_html").alias("text"))


@query
def html_to_text_parsed(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "resume").select("row_id", "Resume_html").where("Resume_html is not null")
    return spread(rows).select("row_id", tx.html_to_text("Resume_html").alias("text"))


@query
def resume_table_corpus(spark: SparkSession, d: str) -> DataFrame:
    return resume_corpus(spread(load(spark, d, "resume").select("row_id", "Resume_str", "Resume_html")), "row_id")


@query
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return tx.exploded(_docs(spark, d), ["doc_id"], tx.sentences("text"), "sentence", "pos")


@query
def page_clean(spark: SparkSession, d: str) -> DataFrame:
    return spread(load(spark, d, "resume").select("row_id", "Resume_str").where("Resume_str is not null")).select("row_id", tx.clean_page_text("Resume_str").alias("text"))


@query
def layout_clean(spark: SparkSession, d: str) -> DataFrame:
    return spread(load(spark, d, "extract_text_from_pdf").select("parse_id", "text")).select("parse_id", tx.clean_layout_text("text").alias("text"))


@query
def name_clean(spark: SparkSession, d: str) -> DataFrame:
    names = _builds(spark, d).select(F.col("canonical").alias("name")).distinct()
    return names.select("name", tx.clean_name("name").alias("cleaned"), tx.skill_norm("name").alias("normalised"), tx.is_simple(F.lower("name")).alias("simple"))


@query
def reverse_alias_index(spark: SparkSession, d: str) -> DataFrame:
    return dic.reverse_index(dic.for_canonicalising(_builds(spark, d))).select("phrase", F.array_join("canonicals", "|").alias("canonicals"))


@query
def alias_map(spark: SparkSession, d: str) -> DataFrame:
    return dic.last_writer(dic.for_flat_map(_builds(spark, d)))


@query
def alias_normalize(spark: SparkSession, d: str) -> DataFrame:
    flat = _mentions(spark, d).select("file_id", F.col("skill_name").alias("skill"))
    return results.normalise(flat, dic.for_flat_map(_builds(spark, d)), "file_id")


@query
def canonical_lookup(spark: SparkSession, d: str) -> DataFrame:
    names = _mentions(spark, d).select(tx.skill_norm("skill_name").alias("name")).where("name <> ''").distinct()
    return similarity.look_up(names, dic.for_canonicalising(_builds(spark, d)))


@query
def fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    names = _mentions(spark, d).select(tx.skill_norm("skill_name").alias("name")).where("name <> ''").distinct()
    return similarity.fuzzy_match(names, _reference(spark, d))


@query
def canonicalise_mentions(spark: SparkSession, d: str) -> DataFrame:
    """All three stages; the vectors are those of the stand-in encoder."""
    raw = _mentions(spark, d).select("file_id", F.col("skill_name").alias("name"), F.col("evidence_text").alias("context"))
    rows = dic.for_canonicalising(_reference(spark, d))
    vectors = similarity.encode(raw.select(tx.skill_norm("name").alias("name")).where("name <> ''"), "name", similarity.HashedEncoder)
    skills = similarity.encode(rows.select("canonical"), "canonical", similarity.HashedEncoder)
    merged = pipeline.canonical_mentions(raw, rows, "file_id", vectors, skills)
    return merged.withColumn("sources", F.array_join("sources", "|"))


@query
def dedupe_boost(spark: SparkSession, d: str) -> DataFrame:
    named = _mentions(spark, d).select("file_id", tx.skill_norm("skill_name").alias("skill"), tx.context_score("evidence_text").alias("score"), "confidence", F.col("skill_name").alias("source")).where("skill <> ''")
    return similarity.merge_mentions(named, "file_id", most=10).withColumn("sources", F.array_join("sources", "|"))


@query
def dictionary_clean(spark: SparkSession, d: str) -> DataFrame:
    return dic.clean_entries(_builds(spark, d)).withColumn("aliases", F.array_join("aliases", "|"))


@query
def dictionary_filter(spark: SparkSession, d: str) -> DataFrame:
    return dic.filter_entries(dic.clean_entries(_builds(spark, d))).withColumn("aliases", F.array_join("aliases", "|"))


@query
def stage_stats(spark: SparkSession, d: str) -> DataFrame:
    entries = _builds(spark, d)
    first = dic.cleaning_stats(entries).withColumn("stage", F.lit("clean"))
    return first.unionByName(dic.filtering_stats(dic.clean_entries(entries)).withColumn("stage", F.lit("filter")))


@query
def seed_merge(spark: SparkSession, d: str) -> DataFrame:
    return dic.merge_seeds(dic.for_keywords(_builds(spark, d))).withColumn("aliases", F.array_join("aliases", "|"))


@query
def profile_top(spark: SparkSession, d: str) -> DataFrame:
    return dic.profile(_reference(spark, d), 50)


@query
def profile_sample(spark: SparkSession, d: str) -> DataFrame:
    return dic.sample_entries(_reference(spark, d), 20, seed=7)


@query
def embedding_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Every vector against the queries, which are the vectors whose id is divisible by 100."""
    v = load(spark, d, "embeddings").select("vec_id", "embedding")
    skills = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return similarity.similarities(spread(v), skills, "vec_id", "embedding", "query_id", "q", 0.2).withColumn("similarity", F.round("similarity", 4))


@query
def embedding_top1(spark: SparkSession, d: str) -> DataFrame:
    v = load(spark, d, "embeddings").select("vec_id", "embedding")
    skills = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return similarity.nearest(spread(v), skills, "vec_id", "embedding", "query_id", "q", 0.2).select("vec_id", F.coalesce("query_id", F.lit(-1)).alias("query_id"), F.round("similarity", 4).alias("similarity"))


@query
def embedding_best(spark: SparkSession, d: str) -> DataFrame:
    return similarity.best_similarity(embedding_threshold(spark, d), ["query_id"])


@query
def cosine_to_entry(spark: SparkSession, d: str) -> DataFrame:
    """The similarity of every vector to the query of its hundred."""
    v = load(spark, d, "embeddings").select("vec_id", "embedding")
    skills = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    pairs = v.withColumn("query_id", (F.floor(F.col("vec_id") / 100) * 100).cast("bigint"))
    return similarity.cosine_to(pairs, skills, "embedding", "query_id", "q").select("vec_id", "query_id", F.round("confidence", 4).alias("confidence"))


@query
def combine_rank_topn(spark: SparkSession, d: str) -> DataFrame:
    m = _mentions(spark, d).select("file_id", tx.skill_norm("skill_name").alias("skill"), "level", "confidence", tx.context_score("evidence_text").alias("own")).where("skill <> ''")
    hits = m.groupBy("file_id", "skill").agg(F.bool_or(F.coalesce(F.lower("level") == "advanced", F.lit(False))).alias("by_rule"), F.max("confidence").alias("similarity"), F.max("own").alias("level"))
    return results.rank(hits.where("by_rule or similarity is not null"), "file_id", 25).withColumn("score", F.round("score", 4))


@query
def context_score(spark: SparkSession, d: str) -> DataFrame:
    return _mentions(spark, d).select("mention_id", tx.context_score("evidence_text").alias("score"))


@query
def level_from_signals(spark: SparkSession, d: str) -> DataFrame:
    return _mentions(spark, d).select("mention_id", level_of("evidence_text", F.array("skill_name")).alias("level"))


@query
def level_window(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    hits = keyword_match(spark, d).withColumnRenamed("canonical", "skill")
    lists = dic.for_keywords(_reference(spark, d)).groupBy(F.col("canonical").alias("skill")).agg(F.array_sort(F.collect_set("phrase")).alias("_aliases"))
    own = spread_by(hits.join(settled(lists)[0], "skill"), "doc_id").groupBy("doc_id").agg(F.collect_list(F.struct("skill", "_aliases")).alias("h"))
    found = tx.let(searchable("text"), lambda hay: F.transform("h", lambda h: F.struct(h["skill"].alias("skill"), h["_aliases"].alias("_aliases"), first_mention("text", h["_aliases"], hay).alias("first_at"))))
    graded = results.with_levels(own.join(docs, "doc_id").withColumn("h", found), "h", "text", lambda h, level: F.struct(h["skill"].alias("skill"), h["first_at"].alias("first_at"), level.alias("level")))
    return tx.exploded(graded, ["doc_id"], F.col("h"), "h").select("doc_id", "h.*")


@query
def ci_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return results.first_spelling(_mentions(spark, d), "file_id", "mention_id", "skill_name")


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = load(spark, d, "documents").select("doc_id", "uploader_id", "kind")
    hits = keyword_match(spark, d).join(docs, "doc_id").select("uploader_id", "kind", F.col("canonical").alias("skill"))
    return hits.where("kind = 'resume'").select("uploader_id", "skill"), hits.where("kind = 'job_description'").select("uploader_id", "skill")


@query
def gap_missing(spark: SparkSession, d: str) -> DataFrame:
    return results.gap_rows(*_sides(spark, d), "uploader_id")[0]


@query
def gap_matching(spark: SparkSession, d: str) -> DataFrame:
    return results.gap_rows(*_sides(spark, d), "uploader_id")[1]


@query
def gap_lists(spark: SparkSession, d: str) -> DataFrame:
    r, j = (x.groupBy("uploader_id").agg(F.collect_set("skill").alias(n)) for x, n in zip(_sides(spark, d), ("r", "j")))
    g = r.join(j, "uploader_id", "full").select("uploader_id", results.gap_arrays(F.col("r"), F.col("j")).alias("g")).select("uploader_id", "g.*")
    return g.select("uploader_id", *[F.array_join(c, "|").alias(c) for c in g.columns[1:]])


@query
def llm_parse_flat(spark: SparkSession, d: str) -> DataFrame:
    raw = F.to_json(F.struct(F.array(F.col("skill_name"), F.upper("skill_name")).alias("skills")), {"ignoreNullFields": "false"})
    return results.parse_flat(_mentions(spark, d).where("skill_name is not null").select("mention_id", raw.alias("raw")), "mention_id")


@query
def llm_validate(spark: SparkSession, d: str) -> DataFrame:
    one = F.struct("skill_name", "category", "level", "years_experience", "evidence_text", "confidence")
    raw = F.concat(F.lit("Here it is:\n```json\n"), F.to_json(F.struct(F.array(one).alias("skills")), {"ignoreNullFields": "false"}), F.lit("\n```"))
    return results.validate(_mentions(spark, d).select("mention_id", raw.alias("raw")), "mention_id")


@query
def record_validation(spark: SparkSession, d: str) -> DataFrame:
    ok = results.valid_record(*[F.col(c) for c in ("skill_name", "category", "level", "years_experience", "evidence_text", "confidence")])
    return _mentions(spark, d).select("mention_id", ok.alias("valid"))


@query
def level_attach(spark: SparkSession, d: str) -> DataFrame:
    m = _mentions(spark, d)
    final = results.normalise(m.select("file_id", F.col("skill_name").alias("skill")), dic.for_flat_map(_builds(spark, d)), "file_id")
    levels = m.select("file_id", tx.skill_norm("skill_name").alias("skill"), tx.context_score("evidence_text").alias("level")).groupBy("file_id", "skill").agg(F.max("level").alias("level"))
    return results.attach_levels(final, levels, "file_id")


@query
def request_payload(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(tx.request_payload(tx.flat_prompt("text"))).alias("payload_md5"))


@query
def prompts(spark: SparkSession, d: str) -> DataFrame:
    """Both requests of every document, by hash."""
    return _docs(spark, d).select("doc_id", F.md5(tx.structured_prompt("text")).alias("structured_md5"), F.md5(tx.flat_prompt("text")).alias("flat_md5"))


@query
def embedding_inputs(spark: SparkSession, d: str) -> DataFrame:
    return _mentions(spark, d).select("mention_id", tx.embedding_input("skill_name", "evidence_text").alias("input"))


@query
def alias_patterns(spark: SparkSession, d: str) -> DataFrame:
    phrases = dic.for_keywords(_builds(spark, d)).select("phrase").distinct()
    return phrases.select("phrase", tx.alias_pattern("phrase").alias("pattern"))


@query
def answer_texts(spark: SparkSession, d: str) -> DataFrame:
    """The text inside a canned response of each mention, and the line that a failed one would be logged as."""
    part = F.struct(F.array(F.struct(F.col("evidence_text").alias("text"))).alias("parts"))
    body = F.to_json(F.struct(F.array(F.struct(part.alias("content"))).alias("candidates")))
    return _mentions(spark, d).select("mention_id", tx.response_text(body).alias("text"), tx.short_error(F.col("mention_id") % 600, "evidence_text").alias("error"))


@query
def document_results(spark: SparkSession, d: str) -> DataFrame:
    """By all extractors: the vectors are those of the stand-in encoder, the canned model answer of a document names the mention of its number."""
    docs, entries = _docs(spark, d), _reference(spark, d)
    vectors = pipeline.vector_hits(docs, entries, similarity.HashedEncoder)
    out = pipeline.analyse(pipeline.Inputs(docs, entries, vectors, _canned(spark, d)))
    lists = [F.array_join(c, "|").alias(c) for c in ("keyword_skills", "embedding_skills", "model_skills", "final_skills")]
    return out.select("doc_id", *lists, F.array_join(F.transform("final_structured", lambda x: F.concat_ws(":", x["name"], x["level"])), "|").alias("final_structured"))


def _canned(spark: SparkSession, d: str) -> DataFrame:
    """Model answers in which a document names the skill mention of its number, twice in different case."""
    raw = F.to_json(F.struct(F.array(F.col("skill_name"), F.upper("skill_name")).alias("skills")), {"ignoreNullFields": "false"})
    answers = load(spark, d, "skill").where("skill_name is not null").select(F.col("mention_id").alias("doc_id"), raw.alias("raw"))
    return results.parse_flat(answers.join(_docs(spark, d).select("doc_id"), "doc_id", "left_semi"))


def _vector_hits(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of documents and of entries are those of the same number in the table of embeddings."""
    v = load(spark, d, "embeddings").select("vec_id", "embedding")
    skills = load(spark, d, "canonical_skills").join(v, F.col("canonical_id") == F.col("vec_id")).select("canonical", F.col("embedding").alias("q"))
    items = v.withColumnRenamed("vec_id", "doc_id").join(_docs(spark, d).select("doc_id"), "doc_id", "left_semi")
    hits = similarity.similarities(items, skills, "doc_id", "embedding", "canonical", "q", 0.2)
    return hits.join(dic.for_rules(_reference(spark, d)).select("canonical").distinct(), "canonical", "left_semi")


@query
def hybrid_rank(spark: SparkSession, d: str) -> DataFrame:
    """The hybrid engine: rule hits united with vector hits, graded, ranked, the first 25 of each document."""
    settings = replace(Settings(), similarity_threshold=0.2)
    got = pipeline.hybrid(pipeline.Inputs(_docs(spark, d), _reference(spark, d), _vector_hits(spark, d)), settings)
    return got.select("doc_id", "skill", F.round("score", 4).alias("score"), "level", "place")


@query
def hybrid_results(spark: SparkSession, d: str) -> DataFrame:
    """All extractors with vectors and model answers that SQL can follow."""
    settings = replace(Settings(), similarity_threshold=0.2)
    out = pipeline.analyse(pipeline.Inputs(_docs(spark, d), _reference(spark, d), _vector_hits(spark, d), _canned(spark, d)), settings)
    lists = [F.array_join(c, "|").alias(c) for c in ("keyword_skills", "embedding_skills", "model_skills", "final_skills")]
    return out.select("doc_id", *lists, F.array_join(F.transform("final_structured", lambda x: F.concat_ws(":", x["name"], x["level"])), "|").alias("final_structured"))


@query
def canonical_by_vector(spark: SparkSession, d: str) -> DataFrame:
    """Canonicalising by look-up, else nearest vector, the fuzzy stage left out; the vector of a name is that of its length's number."""
    raw = _mentions(spark, d).select("file_id", F.col("skill_name").alias("name"), F.col("evidence_text").alias("context"))
    rows = dic.for_canonicalising(_reference(spark, d))
    v = load(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    names = raw.select(tx.skill_norm("name").alias("name")).where("name <> ''").distinct()
    vectors = names.withColumn("vec_id", ((F.length("name") * 37) % 2000).cast("bigint")).join(v, "vec_id").select("name", "vector")
    skills = load(spark, d, "canonical_skills").join(v, F.col("canonical_id") == F.col("vec_id")).select(tx.skill_norm("canonical").alias("canonical"), "vector")
    settings = replace(Settings(), fuzzy_ratio=1.5, normalizer_threshold=0.25, normalizer_max_skills=10)
    got = pipeline.canonical_mentions(raw, rows, "file_id", vectors, skills, settings)
    return got.select("file_id", "skill", "score", F.round("confidence", 4).alias("confidence"), F.array_join("sources", "|").alias("sources"), "place")


@query
def mined_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.build_dictionary(_docs(spark, d)).withColumn("aliases", F.array_join("aliases", "|"))
