"""The skill dictionary as rows, its loading rules, its merging, and the two stages that clean it.

A dictionary is a DataFrame ``canonical, phrase, pos``: one row for each phrase, ``pos`` being the order in
which entries were written (a later entry wins where the rule says so).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as cfg
from ..functions.text import clean_name, match_norm, skill_norm, strip

ROWS = "canonical string, phrase string, pos bigint"


def entries_of_map(df: DataFrame, column: str, pos: str | None = None) -> DataFrame:
    """``canonical, aliases, pos`` of each entry of a map<string, array<string>>. Null maps and null keys give nothing; a null list stays null."""
    order = F.col(pos).cast("bigint") if pos else F.lit(0).cast("bigint")
    rows = df.select(order.cast("decimal(19,0)").alias("_p"), F.posexplode(F.map_entries(column)).alias("_i", "_e"))
    place = F.col("_p") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("_i")  # an array has fewer elements than that
    return rows.select(F.col("_e.key").alias("canonical"), F.col("_e.value").alias("aliases"), place.alias("pos"))


def _norm(c: Column) -> Column:
    return F.lower(strip(c))


def for_keywords(entries: DataFrame) -> DataFrame:
    """Keys and aliases stripped and lower-cased; each key is its own phrase; a null list leaves the key alone; equal keys unite."""
    rows = entries.select(_norm(F.col("canonical")).alias("canonical"), "pos", F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("phrase"))
    return rows.select("canonical", _norm(F.col("phrase")).alias("phrase"), "pos").where("canonical <> '' and phrase <> ''").groupBy("canonical", "phrase").agg(F.min("pos").alias("pos"))


def for_rules(entries: DataFrame) -> DataFrame:
    """Keys lower-cased with blanks collapsed; entries without a list are left out; keys are no phrases of their own; the last of equal keys wins."""
    rows = entries.where("aliases is not null").select(match_norm(F.col("canonical")).alias("canonical"), "aliases", "pos").where("canonical <> ''")
    last = rows.groupBy("canonical").agg(F.max_by("aliases", "pos").alias("aliases"), F.max("pos").alias("pos"))
    return last.select("canonical", F.explode(F.array_distinct(F.transform("aliases", _norm))).alias("phrase"), "pos").where("phrase <> ''")


def for_canonicalising(entries: DataFrame) -> DataFrame:
    """Keys and aliases with all white space collapsed; the key is a phrase too; lists of the last of equal keys hold, but every list is looked up."""
    rows = entries.where("aliases is not null").select(skill_norm(F.col("canonical")).alias("canonical"), "pos", F.explode(F.concat(F.array("canonical"), "aliases")).alias("phrase"))
    return rows.select("canonical", skill_norm(F.col("phrase")).alias("phrase"), "pos").where("canonical <> '' and phrase <> ''").distinct()


def for_flat_map(entries: DataFrame) -> DataFrame:
    """Like ``for_canonicalising`` in stripped lower case; used with ``last_writer``."""
    rows = entries.where("aliases is not null").select(_norm(F.col("canonical")).alias("canonical"), "pos", F.explode(F.concat(F.array("canonical"), "aliases")).alias("phrase"))
    return rows.select("canonical", _norm(F.col("phrase")).alias("phrase"), "pos").where("canonical <> '' and phrase <> ''").distinct()


def for_profile(entries: DataFrame) -> DataFrame:
    """Entries as written whose list holds no null: ``canonical, aliases, pos``."""
    return entries.where("aliases is not null and forall(aliases, a -> a is not null)")


def last_writer(rows: DataFrame) -> DataFrame:
    """``phrase, canonical``: of entries that list the same phrase, the last one written."""
    return rows.groupBy("phrase").agg(F.max_by("canonical", F.struct("pos", "canonical")).alias("canonical"))


def first_canonical(rows: DataFrame) -> DataFrame:
    """``phrase, canonical``: of entries that list the same phrase, the alphabetically first one."""
    return rows.groupBy("phrase").agg(F.min("canonical").alias("canonical"))


def reverse_index(rows: DataFrame) -> DataFrame:
    """``phrase, canonicals`` (sorted array)."""
    return rows.groupBy("phrase").agg(F.array_sort(F.collect_set("canonical")).alias("canonicals"))


def merge_seeds(rows: DataFrame, seeds: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``canonical, aliases``: entries united with seed entries; where a seed's key is there, its key joins the list, else its aliases alone are the list."""
    spark = rows.sparkSession
    seeds = cfg.SEED_SKILLS if seeds is None else seeds
    seed = spark.createDataFrame([(k, a) for k, al in seeds.items() for a in al] or [(None, None)], "canonical string, phrase string").where("canonical is not null")
    present = rows.select("canonical").distinct().join(F.broadcast(seed.select("canonical").distinct()), "canonical", "left_semi")
    keys = present.withColumn("phrase", F.col("canonical"))
    return rows.select("canonical", "phrase").unionByName(seed).unionByName(keys).groupBy("canonical").agg(F.array_sort(F.collect_set("phrase")).alias("aliases"))


# ---------------------------------------------------------------- stage 2: cleaning


def _in(c: Column, words: tuple[str, ...]) -> Column:
    return c.isin(*words)


def _any_token(tokens: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, words)))


def has_noise(c: Column) -> Column:
    """A noise word, two neighbours that form one, or a noise phrase inside."""
    tokens = F.split(c, " +")
    pairs = F.transform(F.sequence(F.lit(0), F.size(tokens) - 2), lambda i: F.concat_ws(" ", F.get(tokens, i), F.get(tokens, i + 1)))
    inside = F.lit(False)
    for p in cfg.NOISE_PHRASES:
        inside = inside | c.contains(p)
    return _any_token(tokens, cfg.NOISE_TERMS) | F.when(F.size(tokens) >= 2, _any_token(pairs, cfg.NOISE_TERMS)).otherwise(False) | inside


def is_valid_name(c: Column, canonical: bool, stop_words: tuple[str, ...] = cfg.CLEANING_STOP_WORDS) -> Column:
    """Whether a cleaned name may stay as a key (``canonical``) or an alias."""
    tokens = F.split(c, " +")
    one = F.size(tokens) == 1
    bad = (
        (c == "")
        | c.rlike(r"\A\d+\z")
        | (one & (F.length(c) < 3) & ~_in(c, cfg.SHORT_ALIASES))
        | (~one & has_noise(c))
        | _in(F.get(tokens, F.lit(0)), stop_words)
        | _in(c, stop_words)
        | _in(c, cfg.MONTHS)
        | _in(c, cfg.VERB_LIKE)
    )
    return (_in(c, cfg.IMPORTANT_SKILLS) | ~bad) if canonical else ~bad


def keeps_alias(a: Column, canonical: Column, stop_words: tuple[str, ...] = cfg.CLEANING_STOP_WORDS) -> Column:
    """Whether a cleaned alias stays under its cleaned key. Short allowed ones stay even where the rule for names refuses them."""
    tokens = F.split(a, " +")
    one = F.size(tokens) == 1
    short_ok = (F.length(a) >= 3) | _in(a, cfg.SHORT_ALIASES) | _in(canonical, cfg.IMPORTANT_SKILLS)
    refused = (a == "") | a.rlike(r"\A\d+\z") | _in(a, stop_words) | _in(F.get(tokens, F.lit(0)), stop_words) | has_noise(a) | (one & ~short_ok)
    return ~refused & (is_valid_name(a, False, stop_words) | (one & _in(a, cfg.SHORT_ALIASES)))


def clean_entries(entries: DataFrame, stop_words: tuple[str, ...] = cfg.CLEANING_STOP_WORDS) -> DataFrame:
    """``canonical, aliases`` after stage 2: names cleaned, entries of equal cleaned keys united, bad keys and aliases dropped,
    the key first and the rest sorted. A key none of whose phrases stays is dropped too."""
    named = entries.select(clean_name("canonical").alias("canonical"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases")).where(is_valid_name(F.col("canonical"), True, stop_words))
    phrases = named.select("canonical", F.explode(F.array_union(F.array("canonical"), "aliases")).alias("a")).select("canonical", clean_name("a").alias("phrase")).where(keeps_alias(F.col("phrase"), F.col("canonical"), stop_words))
    return _assembled(phrases)


def _assembled(phrases: DataFrame) -> DataFrame:
    grouped = phrases.groupBy("canonical").agg(F.array_sort(F.collect_set("phrase")).alias("a"))
    own = F.array("canonical")
    return grouped.select("canonical", F.when(F.array_contains("a", F.col("canonical")), F.concat(own, F.array_except("a", own))).otherwise(F.col("a")).alias("aliases"))


def cleaning_stats(entries: DataFrame) -> DataFrame:
    """One row ``original, removed, final`` of stage 2. Keys that pass but lose all their phrases count in none but ``original``."""
    checked = entries.agg(F.count("*").alias("original"), F.count_if(~is_valid_name(clean_name("canonical"), True)).alias("removed")).withColumn("k", F.lit(1))
    return checked.join(F.broadcast(clean_entries(entries).agg(F.count("*").alias("final")).withColumn("k", F.lit(1))), "k").drop("k")


# ---------------------------------------------------------------- stage 3: what looks like a skill


def is_verb(c: Column) -> Column:
    last = F.element_at(F.split(c, " +"), -1)
    return (c != "") & ~_in(c, ("spring", "testing", "inc")) & (last != "spring") & last.rlike("(ed|ing)$")


def is_filler(c: Column) -> Column:
    """Education, section and place words, bare actions, doubled words, and the pair of office products."""
    tokens = F.split(c, " +")
    near = F.sequence(F.lit(0), F.size(tokens) - 2)
    doubled = F.exists(
        near,
        lambda i: (F.get(tokens, i) == F.get(tokens, i + 1)) | (F.get(tokens, i + 1) == F.concat(F.get(tokens, i), F.lit("s"))) | (F.get(tokens, i) == F.concat(F.get(tokens, i + 1), F.lit("s"))),
    )
    return (
        (c == "")
        | _any_token(tokens, cfg.EDUCATION_TERMS + cfg.SECTION_WORDS + cfg.LOCATION_WORDS)
        | _in(c, cfg.GENERIC_ACTIONS)
        | F.when(F.size(tokens) >= 2, doubled).otherwise(False)
        | (c == "word excel")
    )


def looks_technical(c: Column, strict: bool = False) -> Column:
    """Whether a name looks like a technology. Keywords count anywhere inside a word, so that ``digital`` passes by ``git``;
    ``strict`` asks for whole words instead."""
    tokens = F.split(c, " +")
    hit = _in(c, cfg.TECH_WHITELIST) | c.rlike(r"\d") | c.rlike(rf"\b({'|'.join(cfg.ACRONYMS)})\b") | _in(c, cfg.KEPT_PHRASES)
    for p in cfg.PROFESSIONAL_PATTERNS:
        hit = hit | c.rlike(p)
    for k in cfg.TECH_KEYWORDS:
        hit = hit | (c.rlike(rf"\b\Q{k}\E\b") if strict else c.contains(k))
    return (c != "") & (hit | ((F.size(tokens) >= 2) & _any_token(tokens, cfg.MARKER_TOKENS)))


def is_skill(c: Column, strict: bool = False, nouns: Column | None = None) -> Column:
    """The chain of stage 3. ``nouns`` is the answer of an optional tagger; without one, two words or eight letters suffice."""
    tech = looks_technical(c, strict)
    otherwise = nouns if nouns is not None else (F.size(F.split(c, " +")) >= 2) | (F.length(c) >= 8)
    return (
        F.when(c == "", False)
        .when(_in(c, cfg.TECH_WHITELIST), True)
        .when(is_filler(c) | _in(c, cfg.ADJECTIVES) | _in(c, cfg.GENERIC_ACTIONS), False)
        .when(tech, True)
        .when(is_verb(c), False)
        .otherwise(otherwise)
    )


def noun_check(tags: Column, tokens: Column, name: Column) -> Column:
    """The tagger's branch, from part-of-speech ``tags`` of ``tokens``: no verb or adverb, and a noun or a method's adjective."""
    pairs = F.filter(F.arrays_zip(tokens.alias("w"), tags.alias("t")), lambda x: ~_in(x["w"], cfg.TECH_WHITELIST))
    bad = F.exists(pairs, lambda x: x["t"].startswith("VB") | x["t"].startswith("RB"))
    good = F.exists(pairs, lambda x: x["t"].startswith("NN") | (x["t"].startswith("JJ") & _in(x["w"], cfg.METHOD_ADJECTIVES)))
    return ~((F.size(tokens) == 1) & (F.length(name) < 8)) & ~bad & good & tags.isNotNull()


Tagger = Callable[[Column], Column]


def noun_tagger(tags: Tagger) -> Tagger:
    """name -> whether it is a noun, by a tagger that gives the part-of-speech tags of an array of tokens."""
    return lambda name: F.coalesce(noun_check(tags(F.split(name, " +")), F.split(name, " +"), name), F.lit(False))


def filter_entries(entries: DataFrame, strict: bool = False, nouns: Tagger | None = None) -> DataFrame:
    """``canonical, aliases`` after stage 3, of entries after stage 2: keys that are skills, with those aliases that are.
    ``nouns`` says of a name whether it is a noun, see ``noun_tagger``."""
    tagged = lambda c: nouns(c) if nouns else None
    named = entries.select(skill_norm("canonical").alias("canonical"), "aliases").where(is_skill(F.col("canonical"), strict, tagged(F.col("canonical"))))
    each = named.select("canonical", F.explode(F.array_union(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("a")).select("canonical", skill_norm("a").alias("phrase"))
    return _assembled(each.where((F.col("phrase") != "") & ((F.col("phrase") == F.col("canonical")) | is_skill(F.col("phrase"), strict, tagged(F.col("phrase"))))))


def filtering_stats(entries: DataFrame, nouns: Tagger | None = None) -> DataFrame:
    """One row ``original, removed, final`` of stage 3."""
    name = skill_norm("canonical")
    return entries.agg(F.count("*").alias("original"), F.count_if(~is_skill(name, nouns=nouns(name) if nouns else None)).alias("removed")).withColumn("final", F.col("original") - F.col("removed"))


def profile(entries: DataFrame, top: int = 50) -> DataFrame:
    """``canonical, n_aliases, preview`` of the first ``top`` entries by name."""
    own = for_profile(entries)
    return own.select("canonical", F.size("aliases").alias("n_aliases"), F.array_join(F.slice("aliases", 1, 5), ", ").alias("preview")).orderBy("canonical").limit(top)


def sample_entries(entries: DataFrame, n: int = 20, seed: int = 0) -> DataFrame:
    """``n`` entries without replacement, chosen by a hash of key and seed so that the choice is stable, sorted by name."""
    picked = for_profile(entries).orderBy(F.xxhash64("canonical", F.lit(seed)), "canonical").limit(n)
    return picked.select("canonical", F.size("aliases").alias("n_aliases"), F.array_join(F.slice("aliases", 1, 5), ", ").alias("preview")).orderBy("canonical")


def empty_rows(spark: SparkSession) -> DataFrame:
    """A dictionary that is missing: every operator then gives an empty result, not an error."""
    return spark.createDataFrame([], ROWS)
