"""SQL of the core's queries for an independent engine (DuckDB's dialect), written from the rules, not from the plans."""

from __future__ import annotations

from .. import config as cfg
from ..functions import text as tx

# ---------------------------------------------------------------- pieces

#: White space as Unicode has it, and word characters.
WS = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
WORD = r"\p{L}\p{N}_"


def _strip(e: str) -> str:
    return rf"regexp_replace(regexp_replace({e}, '^{WS}+', ''), '{WS}+$', '')"


def _norm(e: str) -> str:
    return rf"regexp_replace({_lower(_strip(e))}, '{WS}+', ' ', 'g')"


def _quote(text: str) -> str:
    return text.replace("'", "''")


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _in(e: str, words: tuple[str, ...]) -> str:
    return f"list_contains({_list(words)}, {e})"


def _lower(e: str) -> str:
    """Lower case in full: the dotted capital I becomes two characters."""
    return f"lower(replace({e}, 'İ', 'i̇'))"


#: Dictionary entries of all builds: name, list, and the order in which they were written.
BUILDS = """
builds AS (
  SELECT e.key AS canonical, e.value AS aliases, build_id * 1000000 + i - 1 AS pos
  FROM (SELECT build_id, map_entries(aliases_by_canonical) AS es FROM final_skills WHERE aliases_by_canonical IS NOT NULL) t,
       LATERAL (SELECT unnest(es) AS e, unnest(range(1, len(es) + 1)) AS i) u
)"""

KEYWORDS = f"""
kw AS (
  SELECT DISTINCT lower({_strip('canonical')}) AS canonical, lower({_strip('p')}) AS phrase
  FROM (SELECT canonical, unnest(list_concat([canonical], coalesce(known_aliases, []))) AS p FROM canonical_skills)
  WHERE {_strip('p')} <> ''
),
seg AS (SELECT doc_id, unnest(string_split_regex({_lower('text')}, '[^{WORD} ]+| {{2,}}')) AS s FROM documents WHERE text IS NOT NULL),
seg_words AS (SELECT doc_id, list_filter(string_split(s, ' '), lambda w: w <> '') AS ws FROM seg),
grams AS (
  SELECT doc_id, unnest(list_concat(ws,
    list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]),
    list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) AS phrase
  FROM seg_words
),
low AS (SELECT doc_id, {_lower('text')} AS t FROM documents WHERE text IS NOT NULL),
near_hits AS MATERIALIZED (SELECT doc_id, canonical, phrase, t FROM low JOIN kw ON contains(t, phrase) WHERE NOT regexp_full_match(phrase, '[{WORD}]+( [{WORD}]+)*')),
kw_hits AS MATERIALIZED (
  SELECT DISTINCT doc_id, canonical FROM grams JOIN kw USING (phrase) WHERE regexp_full_match(phrase, '[{WORD}]+( [{WORD}]+)*')
  UNION
  SELECT doc_id, canonical FROM near_hits WHERE regexp_matches(t, '(^|[^{WORD}])' || regexp_escape(phrase) || '($|[^{WORD}])')
)"""

SENTENCES = rf"""
parts AS (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '[.\r\n]'), lambda x: {_lower(_strip('x'))}), lambda x: x <> '') AS ss FROM documents),
sentences AS (SELECT doc_id, unnest(ss) AS sentence, unnest(range(0, len(ss))) AS pos FROM parts)"""


def _clean_corpus(e: str) -> str:
    t = rf"regexp_replace(replace({_lower(e)}, chr(13), chr(10)), '[^a-z0-9 \t\n\x0b\f+#.]', ' ', 'g')"
    return rf"coalesce(trim(regexp_replace(regexp_replace({t}, '\b[0-9]+\b', ' ', 'g'), '[ \t\n\x0b\f]+', ' ', 'g')), '')"


def _clean_name(e: str) -> str:
    gone = cfg.PUNCTUATION_DROPPED.replace("'", "''")
    return f"coalesce({_strip(f'''translate({_norm(e)}, '{gone}', '')''')}, '')"


def _context(e: str) -> str:
    return rf"CASE WHEN regexp_matches(lower(coalesce({e}, '')), '\b(expert|advanced)\b') THEN 3 WHEN regexp_matches(lower(coalesce({e}, '')), '\bintermediate\b') THEN 2 ELSE 1 END"


def _level(hay: str, names: str) -> str:
    """Level by the rules, of a collapsed lower-case text and a list of aliases."""
    tail = r"CASE WHEN regexp_full_match(a, '[a-z0-9 ]+') AND contains(a, ' ') THEN '\b' || regexp_replace(a, ' +', '\\s+', 'g') || '\b' ELSE regexp_escape(a) END"
    years = rf"list_max(list_transform({names}, lambda a: TRY_CAST(regexp_extract({hay}, '([0-9]+)\s*\+?\s*(?:years?|yrs?)\s+(?:of\s+)?' || {tail}, 1) AS INT)))"
    return rf"""CASE WHEN NOT coalesce(list_bool_or(list_transform({names}, lambda a: contains({hay}, a))), false) THEN 1
      WHEN regexp_matches({hay}, '\b(expert|advanced)\b') THEN 3 WHEN regexp_matches({hay}, '\bintermediate\b') THEN 2
      WHEN {years} >= 5 THEN 3 WHEN {years} >= 3 THEN 2 WHEN {years} IS NOT NULL THEN 1
      WHEN regexp_matches({hay}, 'strong|proficient|extensive') THEN 2 ELSE 1 END"""


def _collapsed(e: str) -> str:
    return f"coalesce({_norm(e)}, '')"


TERMS = f"""
words AS (
  SELECT doc_id, list_filter(regexp_extract_all({_lower('text')}, '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: NOT {_in('w', cfg.STOP_WORDS)}) AS ws FROM documents WHERE text IS NOT NULL
),
occ AS (SELECT doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM words),
terms AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM occ GROUP BY term)"""


def _noise(e: str) -> str:
    toks = f"list_filter(string_split({e}, ' '), lambda w: w <> '')"
    pairs = f"list_transform(range(1, len({toks})), lambda i: {toks}[i] || ' ' || {toks}[i + 1])"
    inside = " OR ".join(f"contains({e}, '{p}')" for p in cfg.NOISE_PHRASES)
    return f"(list_has_any({toks}, {_list(cfg.NOISE_TERMS)}) OR list_has_any({pairs}, {_list(cfg.NOISE_TERMS)}) OR {inside})"


def _count(e: str) -> str:
    return f"len(list_filter(string_split({e}, ' '), lambda w: w <> ''))"


def _first(e: str) -> str:
    return f"string_split({e}, ' ')[1]"


def _valid_name(e: str, canonical: bool) -> str:
    bad = (
        f"({e} = '' OR regexp_full_match({e}, '[0-9]+') OR ({_count(e)} = 1 AND length({e}) < 3 AND NOT {_in(e, cfg.SHORT_ALIASES)}) OR ({_count(e)} > 1 AND {_noise(e)}) "
        f"OR {_in(_first(e), cfg.CLEANING_STOP_WORDS)} OR {_in(e, cfg.CLEANING_STOP_WORDS)})"
    )
    return f"({_in(e, cfg.IMPORTANT_SKILLS)} OR NOT {bad})" if canonical else f"(NOT {bad})"


def _keeps_alias(a: str, c: str) -> str:
    one = f"{_count(a)} = 1"
    refused = (
        f"({a} = '' OR regexp_full_match({a}, '[0-9]+') OR {_in(a, cfg.CLEANING_STOP_WORDS)} OR {_in(_first(a), cfg.CLEANING_STOP_WORDS)} OR {_noise(a)} "
        f"OR ({one} AND NOT (length({a}) >= 3 OR {_in(a, cfg.SHORT_ALIASES)} OR {_in(c, cfg.IMPORTANT_SKILLS)})))"
    )
    return f"(NOT {refused} AND ({_valid_name(a, False)} OR ({one} AND {_in(a, cfg.SHORT_ALIASES)})))"


def _assembled(name: str, of: str) -> str:
    return f"""{name} AS (
  SELECT canonical, CASE WHEN list_contains(l, canonical) THEN list_concat([canonical], list_filter(l, lambda x: x <> canonical)) ELSE l END AS aliases
  FROM (SELECT canonical, list_sort(list(DISTINCT phrase)) AS l FROM {of} GROUP BY canonical)
)"""


_CLEANING = f"""
named AS (SELECT {_clean_name('canonical')} AS canonical, coalesce(aliases, []) AS aliases FROM builds),
good_keys AS (SELECT * FROM named WHERE {_valid_name('canonical', True)}),
key_phrases AS (SELECT canonical, unnest(list_concat([canonical], aliases)) AS a FROM good_keys),
clean_phrases AS (SELECT canonical, {_clean_name('a')} AS phrase FROM key_phrases),
kept_phrases AS (SELECT canonical, phrase FROM clean_phrases WHERE {_keeps_alias('phrase', 'canonical')}),
{_assembled('cleaned', 'kept_phrases')}"""

CLEANED = f"{BUILDS},{_CLEANING}"


def _technical(e: str) -> str:
    toks = f"string_split({e}, ' ')"
    parts = [_in(e, cfg.TECH_WHITELIST), f"regexp_matches({e}, '[0-9]')", rf"regexp_matches({e}, '\b({'|'.join(cfg.ACRONYMS)})\b')", _in(e, cfg.KEPT_PHRASES)]
    parts += [f"regexp_matches({e}, '{p}')" for p in cfg.PROFESSIONAL_PATTERNS]
    parts += [f"contains({e}, '{k}')" for k in cfg.TECH_KEYWORDS]
    parts.append(f"({_count(e)} >= 2 AND list_has_any({toks}, {_list(cfg.MARKER_TOKENS)}))")
    return "(" + " OR ".join(parts) + ")"


def _filler(e: str) -> str:
    toks = f"string_split({e}, ' ')"
    doubled = f"list_bool_or(list_transform(range(1, len({toks})), lambda i: {toks}[i] = {toks}[i + 1] OR {toks}[i + 1] = {toks}[i] || 's' OR {toks}[i] = {toks}[i + 1] || 's'))"
    return f"(list_has_any({toks}, {_list(cfg.EDUCATION_TERMS + cfg.SECTION_WORDS + cfg.LOCATION_WORDS)}) OR {_in(e, cfg.GENERIC_ACTIONS)} OR coalesce({doubled}, false) OR {e} = 'word excel')"


def _is_skill(e: str) -> str:
    last = f"string_split({e}, ' ')[-1]"
    verb = f"(NOT {_in(e, ('spring', 'testing', 'inc'))} AND {last} <> 'spring' AND regexp_matches({last}, '(ed|ing)$'))"
    return f"CASE WHEN {e} = '' THEN false WHEN {_in(e, cfg.TECH_WHITELIST)} THEN true WHEN {_filler(e)} OR {_in(e, cfg.ADJECTIVES)} THEN false WHEN {_technical(e)} THEN true WHEN {verb} THEN false ELSE {_count(e)} >= 2 OR length({e}) >= 8 END"


_FILTERING = f"""
skill_keys AS (SELECT * FROM (SELECT {_norm('canonical')} AS canonical, aliases FROM cleaned) WHERE {_is_skill('canonical')}),
skill_phrases AS (SELECT canonical, {_norm('a')} AS phrase FROM (SELECT canonical, unnest(list_concat([canonical], aliases)) AS a FROM skill_keys)),
kept_skills AS (SELECT * FROM skill_phrases WHERE phrase <> '' AND (phrase = canonical OR {_is_skill('phrase')})),
{_assembled('filtered', 'kept_skills')}"""

FILTERED = f"{CLEANED},{_FILTERING}"

#: The dictionary mined from the documents, with the seeds, in the place of the builds.
_SEEDS = "seeds AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{a}')" for k, al in cfg.SEED_SKILLS.items() for a in al) + ") s(canonical, phrase))"
MINED = f"""{TERMS},
mined AS (SELECT term FROM terms WHERE df >= 5 AND NOT {_in('term', cfg.GENERIC_TERMS)} AND len(list_filter(string_split(term, ' '), lambda t: length(t) <= 2)) = 0 ORDER BY tf DESC, term LIMIT 2000),
{_SEEDS},
united AS (SELECT term AS canonical, term AS phrase FROM mined UNION SELECT * FROM seeds UNION SELECT term, term FROM mined WHERE term IN (SELECT canonical FROM seeds)),
builds AS (SELECT canonical, list(DISTINCT phrase) AS aliases FROM united GROUP BY canonical),{_CLEANING},{_FILTERING}"""

FLAT = f"""{BUILDS},
flat AS (
  SELECT DISTINCT lower({_strip('canonical')}) AS canonical, lower({_strip('p')}) AS phrase, pos
  FROM (SELECT canonical, pos, unnest(list_concat([canonical], aliases)) AS p FROM builds WHERE aliases IS NOT NULL) WHERE {_strip('p')} <> '' AND {_strip('canonical')} <> ''
),
flat_map AS (SELECT phrase, arg_max(canonical, (pos, canonical)) AS canonical FROM flat GROUP BY phrase),
mentioned AS (
  SELECT DISTINCT file_id, phrase FROM (SELECT file_id, lower({_strip('skill_name')}) AS phrase FROM skill WHERE skill_name IS NOT NULL)
  WHERE phrase <> '' AND NOT {_in('phrase', cfg.GENERIC_WORDS)}
),
normal AS (SELECT DISTINCT file_id, coalesce(canonical, phrase) AS skill FROM mentioned LEFT JOIN flat_map USING (phrase))"""

CANON = f"""{BUILDS},
canon AS (
  SELECT DISTINCT {_norm('canonical')} AS canonical, {_norm('p')} AS phrase
  FROM (SELECT canonical, unnest(list_concat([canonical], aliases)) AS p FROM builds WHERE aliases IS NOT NULL) WHERE {_strip('p')} <> '' AND {_strip('canonical')} <> ''
)"""

VECTORS = """
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
sims AS (SELECT e.vec_id, q.query_id, list_dot_product(e.embedding::DOUBLE[], q.q) AS s FROM embeddings e, q)"""

SIDES = f"""{KEYWORDS},
sides AS (SELECT DISTINCT uploader_id, kind, canonical AS skill FROM kw_hits JOIN documents USING (doc_id)),
res AS (SELECT uploader_id, skill FROM sides WHERE kind = 'resume' AND uploader_id IS NOT NULL),
job AS (SELECT uploader_id, skill FROM sides WHERE kind = 'job_description' AND uploader_id IS NOT NULL)"""

_RULES = rf"""{BUILDS},
rule_entries AS (
  SELECT canonical, arg_max(aliases, pos) AS aliases
  FROM (SELECT {_strip(r"regexp_replace(lower(canonical), '[ \t]+', ' ', 'g')")} AS canonical, aliases, pos FROM builds WHERE aliases IS NOT NULL) WHERE canonical <> '' GROUP BY canonical
),
rules AS (SELECT DISTINCT canonical, phrase FROM (SELECT canonical, lower({_strip('a')}) AS phrase FROM (SELECT canonical, unnest(aliases) AS a FROM rule_entries)) WHERE phrase <> ''),
{SENTENCES.strip()},
rule_words AS (SELECT doc_id, list_filter(string_split_regex(w, '{WS}+'), lambda x: x <> '') AS ws FROM (SELECT doc_id, unnest(string_split_regex(sentence, '[^\p{{L}}\p{{N}}_\s\p{{Z}}]+')) AS w FROM sentences)),
rule_grams AS (
  SELECT DISTINCT doc_id, unnest(list_concat(ws,
    list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]),
    list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]),
    list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]))) AS phrase FROM rule_words
)"""

_DEDUPE = f"""
named AS (SELECT file_id, {_norm('skill_name')} AS skill, {_context('evidence_text')} AS score, confidence, skill_name AS source FROM skill WHERE {_strip('skill_name')} <> ''),
merged AS (
  SELECT file_id, skill, (CASE WHEN count(*) > 1 THEN least(3, max(score) + count(*) - 1) ELSE max(score) END)::INT AS score, max(confidence) AS confidence, array_to_string(list_sort(list(DISTINCT source)), '|') AS sources
  FROM named GROUP BY file_id, skill
),
placed AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY confidence DESC NULLS LAST, score DESC, skill) AS place FROM merged)"""

_RANK = f"""
h AS (
  SELECT file_id, {_norm('skill_name')} AS skill, bool_or(coalesce(lower(level) = 'advanced', false)) AS by_rule, max(confidence) AS similarity, max({_context('evidence_text')}) AS level
  FROM skill WHERE {_strip('skill_name')} <> '' GROUP BY ALL
),
scored AS (SELECT file_id, skill, CASE WHEN by_rule THEN 2.0 + greatest(coalesce(similarity, 0.0), 0.0) ELSE similarity END AS score, level FROM h WHERE by_rule OR similarity IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, level DESC, skill) AS place FROM scored)"""

_HTML = rf"regexp_replace(regexp_replace(Resume_html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<template\b.*?</template\s*>|<noscript\b.*?</noscript\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _name, _sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, '{_name}', '{_sign}')"

_PAGE = rf"regexp_replace(regexp_replace({_strip('Resume_str')}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"

_WINDOW = f"""{KEYWORDS},
lists AS (SELECT canonical, list_sort(list(DISTINCT phrase)) AS names FROM kw GROUP BY canonical),
near AS (
  SELECT doc_id, canonical AS skill, text, names, {_collapsed('text')} AS hay,
    coalesce(list_min(list_filter(list_transform(names, lambda a: instr({_collapsed('text')}, a)), lambda p: p > 0)) - 1, -1) AS first_at
  FROM kw_hits JOIN lists USING (canonical) JOIN documents USING (doc_id)
),
parts AS (SELECT doc_id, skill, first_at, names, CASE WHEN first_at < 0 THEN text ELSE substring(text, (greatest(first_at - 220, 0) + 1)::INT, (first_at + 220 - greatest(first_at - 220, 0))::INT) END AS part FROM near),
snippets AS (SELECT doc_id, skill, first_at, names, {_collapsed('part')} AS hay FROM parts)"""

#: The hybrid engine over the reference list: rules, vectors by number, levels near the first mention, the first 25 by score.
_ENGINE = rf"""{KEYWORDS},
{SENTENCES.strip()},
rl AS (
  SELECT DISTINCT {_strip(r"regexp_replace(lower(canonical), '[ \t]+', ' ', 'g')")} AS canonical, lower({_strip('p')}) AS phrase
  FROM (SELECT canonical, unnest(known_aliases) AS p FROM canonical_skills WHERE known_aliases IS NOT NULL) WHERE {_strip('p')} <> ''
),
rule_hit AS MATERIALIZED (
  SELECT DISTINCT doc_id, canonical FROM sentences s JOIN rl ON contains(s.sentence, rl.phrase) WHERE NOT regexp_full_match(rl.phrase, '[a-z0-9 ]+')
  UNION SELECT DISTINCT doc_id, canonical FROM sentences s JOIN rl ON contains(regexp_replace(s.sentence, '{WS}+', ' ', 'g'), regexp_replace(rl.phrase, ' +', ' ', 'g'))
  WHERE regexp_full_match(rl.phrase, '[a-z0-9 ]+') AND regexp_matches(regexp_replace(s.sentence, '{WS}+', ' ', 'g'), '(^|[^{WORD}])' || regexp_replace(rl.phrase, ' +', ' ', 'g') || '($|[^{WORD}])')
),
vec_hit AS MATERIALIZED (
  SELECT d.vec_id AS doc_id, c.canonical, list_dot_product(d.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS s
  FROM embeddings d JOIN documents o ON o.doc_id = d.vec_id, canonical_skills c JOIN embeddings e ON e.vec_id = c.canonical_id
  WHERE list_dot_product(d.embedding::DOUBLE[], e.embedding::DOUBLE[]) >= 0.2 AND c.canonical IN (SELECT canonical FROM rl)
),
both_hits AS (
  SELECT doc_id, canonical AS skill, bool_or(r) AS by_rule, max(s) AS s FROM (SELECT doc_id, canonical, true AS r, NULL::DOUBLE AS s FROM rule_hit UNION ALL SELECT doc_id, canonical, false, s FROM vec_hit) GROUP BY ALL
),
al AS (SELECT canonical AS skill, list_sort(list(DISTINCT phrase)) AS names FROM rl GROUP BY canonical),
found_at AS (
  SELECT h.*, text, coalesce(names, [skill]) AS names, coalesce(list_min(list_filter(list_transform(coalesce(names, [skill]), lambda a: instr({_collapsed('text')}, {_norm('a')})), lambda p: p > 0)) - 1, -1) AS first_at
  FROM both_hits h LEFT JOIN al USING (skill) JOIN documents USING (doc_id)
),
near_text AS (SELECT *, {_collapsed("CASE WHEN first_at < 0 THEN text ELSE substring(text, (greatest(first_at - 220, 0) + 1)::INT, (first_at + 220 - greatest(first_at - 220, 0))::INT) END")} AS hay FROM found_at),
graded AS (SELECT doc_id, skill, CASE WHEN by_rule THEN 2.0 + greatest(coalesce(s, 0.0), 0.0) ELSE s END AS score, {_level('hay', 'names')} AS level FROM near_text),
ranked AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, level DESC, skill) AS place FROM graded) WHERE place <= 25)"""

_CANNED = f"SELECT mention_id AS doc_id, {_strip('skill_name')} AS item FROM skill WHERE {_strip('skill_name')} <> '' AND mention_id IN (SELECT doc_id FROM documents)"

_RESULTS = f"""{_ENGINE},
model AS (SELECT DISTINCT * FROM ({_CANNED})),
fm AS (
  SELECT phrase, arg_max(canonical, (pos, canonical)) AS normal
  FROM (SELECT DISTINCT lower({_strip('canonical')}) AS canonical, lower({_strip('p')}) AS phrase, canonical_id AS pos FROM (SELECT canonical, canonical_id, unnest(list_concat([canonical], known_aliases)) AS p FROM canonical_skills WHERE known_aliases IS NOT NULL))
  WHERE phrase <> '' AND canonical <> '' GROUP BY phrase
),
all_hits AS (SELECT doc_id, canonical AS skill FROM kw_hits UNION ALL SELECT doc_id, skill FROM ranked UNION ALL SELECT doc_id, item FROM model),
final AS (SELECT DISTINCT doc_id, coalesce(normal, p) AS skill FROM (SELECT doc_id, lower({_strip('skill')}) AS p FROM all_hits) LEFT JOIN fm ON fm.phrase = p WHERE p <> '' AND NOT {_in('coalesce(normal, p)', cfg.GENERIC_WORDS)}),
structured AS (SELECT f.doc_id, f.skill, coalesce(r.level, 1) AS level FROM final f LEFT JOIN ranked r ON r.doc_id = f.doc_id AND r.skill = f.skill),
l1 AS (SELECT doc_id, string_agg(canonical, '|' ORDER BY canonical) AS keyword_skills FROM kw_hits GROUP BY doc_id),
l2 AS (SELECT doc_id, string_agg(skill, '|' ORDER BY skill) AS embedding_skills FROM ranked GROUP BY doc_id),
l3 AS (SELECT doc_id, string_agg(item, '|' ORDER BY item) AS model_skills FROM model GROUP BY doc_id),
l4 AS (SELECT doc_id, string_agg(skill, '|' ORDER BY skill) AS final_skills, string_agg(skill || ':' || level, '|' ORDER BY skill) AS final_structured FROM structured GROUP BY doc_id)"""

_BY_VECTOR = rf"""
cr AS (SELECT DISTINCT {_norm('canonical')} AS canonical, {_norm('p')} AS phrase FROM (SELECT canonical, unnest(list_concat([canonical], known_aliases)) AS p FROM canonical_skills WHERE known_aliases IS NOT NULL) WHERE {_strip('p')} <> ''),
mention AS (SELECT file_id, {_strip('skill_name')} AS source, {_norm('skill_name')} AS name, {_context('evidence_text')} AS score FROM skill WHERE {_strip('skill_name')} <> ''),
sv AS (SELECT {_norm('canonical')} AS canonical, embedding::DOUBLE[] AS q FROM canonical_skills JOIN embeddings ON canonical_id = vec_id),
nv AS (SELECT name, embedding::DOUBLE[] AS v FROM (SELECT DISTINCT name FROM mention) JOIN embeddings ON vec_id = (length(name) * 37) % 2000),
near_v AS (SELECT name, arg_min(canonical, (-s, canonical)) AS near, max(s) AS s FROM (SELECT name, canonical, list_dot_product(v, q) AS s FROM nv, sv) GROUP BY name),
ruled AS (SELECT DISTINCT name, coalesce((SELECT min(canonical) FROM cr WHERE canonical = name), (SELECT min(canonical) FROM cr WHERE phrase = name)) AS rule FROM mention),
placed_at AS (
  SELECT file_id, source, m.score, coalesce(rule, CASE WHEN n.s >= 0.25 THEN near END) AS skill, rule, n.s, nv.v FROM mention m JOIN ruled USING (name) LEFT JOIN near_v n USING (name) LEFT JOIN nv USING (name)
),
sure AS (SELECT file_id, source, score, p.skill, CASE WHEN rule IS NOT NULL THEN coalesce(list_dot_product(v, q), 0.0) ELSE s END AS confidence FROM placed_at p LEFT JOIN sv ON sv.canonical = p.skill WHERE p.skill IS NOT NULL),
merged_v AS (
  SELECT file_id, skill, (CASE WHEN count(*) > 1 THEN least(3, max(score) + count(*) - 1) ELSE max(score) END)::INT AS score, max(confidence) AS confidence, array_to_string(list_sort(list(DISTINCT source)), '|') AS sources FROM sure GROUP BY file_id, skill
),
placed_v AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY confidence DESC, score DESC, skill) AS place FROM merged_v)"""

SQL: dict[str, str] = {
    "hybrid_rank": f"WITH {_ENGINE} SELECT doc_id, skill, round(score, 4) AS score, level, place FROM ranked",
    "hybrid_results": f"""WITH {_RESULTS}
SELECT doc_id, coalesce(keyword_skills, '') AS keyword_skills, coalesce(embedding_skills, '') AS embedding_skills, coalesce(model_skills, '') AS model_skills, coalesce(final_skills, '') AS final_skills, coalesce(final_structured, '') AS final_structured
FROM documents LEFT JOIN l1 USING (doc_id) LEFT JOIN l2 USING (doc_id) LEFT JOIN l3 USING (doc_id) LEFT JOIN l4 USING (doc_id)""",
    "canonical_by_vector": f"WITH {_BY_VECTOR.strip()} SELECT file_id, skill, score, round(confidence, 4) AS confidence, sources, place FROM placed_v WHERE place <= 10",
    "keyword_match": f"WITH {KEYWORDS} SELECT doc_id, canonical FROM kw_hits",
    "keyword_top": f"WITH {KEYWORDS} SELECT canonical, count(*) AS n_docs FROM kw_hits GROUP BY canonical ORDER BY n_docs DESC, canonical LIMIT 50",
    "rule_match": f"""WITH {_RULES}
SELECT DISTINCT doc_id, canonical FROM rule_grams g JOIN rules r ON g.phrase = regexp_replace(r.phrase, ' +', ' ', 'g') WHERE regexp_full_match(r.phrase, '[a-z0-9 ]+')
UNION SELECT doc_id, canonical FROM sentences s JOIN rules r ON contains(s.sentence, r.phrase) WHERE NOT regexp_full_match(r.phrase, '[a-z0-9 ]+')""",
    "vocab_mine_topk": f"WITH {TERMS} SELECT term, tf, df FROM terms WHERE df >= 5 AND NOT {_in('term', cfg.GENERIC_TERMS)} AND len(list_filter(string_split(term, ' '), lambda t: length(t) <= 2)) = 0 ORDER BY tf DESC, term LIMIT 500",
    "vocab_min_df": f"WITH {TERMS} SELECT term, tf, df FROM terms WHERE df >= 10",
    "corpus_clean": f"SELECT doc_id, {_clean_corpus('text')} AS text_clean FROM documents",
    "corpus_union_sources": f"""SELECT source, count(*) AS n_docs, sum(length(text))::BIGINT AS n_chars FROM (
  SELECT 'resume' AS source, {_clean_corpus(f'CASE WHEN Resume_str IS NOT NULL THEN Resume_str ELSE {_HTML} END')} AS text FROM resume UNION ALL SELECT 'pdf', {_clean_corpus('text')} FROM extract_text_from_pdf UNION ALL SELECT 'documents', {_clean_corpus('text')} FROM documents
) WHERE text <> '' GROUP BY source""",
    "html_to_text": f"SELECT row_id, {_strip(rf'''regexp_replace({_HTML}, '{WS}+', ' ', 'g')''')} AS text FROM resume WHERE Resume_html IS NOT NULL",
    "page_clean": f"SELECT row_id, regexp_replace({_PAGE}, '(?m)^{WS}+|{WS}+$', '', 'g') AS text FROM resume WHERE Resume_str IS NOT NULL",
    "resume_table_corpus": f"SELECT * FROM (SELECT 'resume' AS source, row_id::VARCHAR AS doc_id, {_clean_corpus(f'CASE WHEN Resume_str IS NOT NULL THEN Resume_str ELSE {_HTML} END')} AS text FROM resume) WHERE text <> ''",
    "sentence_split": f"WITH {SENTENCES} SELECT doc_id, pos, sentence FROM sentences",
    "name_clean": rf"WITH {BUILDS} SELECT DISTINCT canonical AS name, {_clean_name('canonical')} AS cleaned, {_norm('canonical')} AS normalised, regexp_full_match(lower(canonical), '[a-z0-9 ]+') AS simple FROM builds",
    "reverse_alias_index": f"WITH {CANON} SELECT phrase, array_to_string(list_sort(list(DISTINCT canonical)), '|') AS canonicals FROM canon GROUP BY phrase",
    "alias_map": f"WITH {FLAT} SELECT phrase, canonical FROM flat_map",
    "alias_normalize": f"WITH {FLAT} SELECT file_id, skill FROM normal",
    "canonical_lookup": f"""WITH {CANON}, names AS (SELECT DISTINCT {_norm('skill_name')} AS name FROM skill WHERE {_strip('skill_name')} <> '')
SELECT name, coalesce((SELECT min(canonical) FROM canon WHERE canonical = name), (SELECT min(canonical) FROM canon WHERE phrase = name)) AS looked_up FROM names""",
    "dedupe_boost": f"WITH {_DEDUPE} SELECT file_id, skill, score, confidence, sources, place FROM placed WHERE place <= 10",
    "dictionary_clean": f"WITH {CLEANED} SELECT canonical, array_to_string(aliases, '|') AS aliases FROM cleaned",
    "dictionary_filter": f"WITH {FILTERED} SELECT canonical, array_to_string(aliases, '|') AS aliases FROM filtered",
    "stage_stats": f"""WITH {FILTERED}
SELECT 'clean' AS stage, (SELECT count(*) FROM named) AS original, (SELECT count(*) FROM named WHERE NOT {_valid_name('canonical', True)}) AS removed, (SELECT count(*) FROM cleaned) AS final
UNION ALL SELECT 'filter', (SELECT count(*) FROM cleaned), (SELECT count(*) FROM cleaned) - (SELECT count(*) FROM filtered), (SELECT count(*) FROM filtered)""",
    "seed_merge": f"""WITH {BUILDS},
rows AS (SELECT DISTINCT lower({_strip('canonical')}) AS canonical, lower({_strip('p')}) AS phrase FROM (SELECT canonical, unnest(list_concat([canonical], coalesce(aliases, []))) AS p FROM builds) WHERE {_strip('p')} <> '' AND {_strip('canonical')} <> ''),
seeds AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{a}')" for k, al in cfg.SEED_SKILLS.items() for a in al)}) s(canonical, phrase)),
united AS (SELECT * FROM rows UNION SELECT * FROM seeds UNION SELECT canonical, canonical FROM rows WHERE canonical IN (SELECT canonical FROM seeds))
SELECT canonical, array_to_string(list_sort(list(DISTINCT phrase)), '|') AS aliases FROM united GROUP BY canonical""",
    "mined_dictionary": f"WITH {MINED} SELECT canonical, array_to_string(aliases, '|') AS aliases FROM filtered",
    "profile_top": "SELECT canonical, len(known_aliases) AS n_aliases, array_to_string(known_aliases[1:5], ', ') AS preview FROM canonical_skills WHERE known_aliases IS NOT NULL ORDER BY canonical LIMIT 50",
    "prompts": f"SELECT doc_id, md5('{_quote(tx.STRUCTURED_HEAD)}' || {_strip("coalesce(text, '')")} || chr(10)) AS structured_md5, md5('{_quote(tx.FLAT_HEAD)}' || {_strip("coalesce(text, '')")} || chr(10)) AS flat_md5 FROM documents",
    "request_payload": f"""SELECT doc_id, md5('{{"contents":[{{"parts":[{{"text":' || to_json('{_quote(tx.FLAT_HEAD)}' || {_strip("coalesce(text, '')")} || chr(10))::VARCHAR || '}}]}}],"generationConfig":{{"temperature":0.0,"responseMimeType":"application/json"}}}}') AS payload_md5 FROM documents""",
    "embedding_inputs": f"SELECT mention_id, {_strip("coalesce(skill_name, '') || '. ' || coalesce(evidence_text, '')")} AS input FROM skill",
    "alias_patterns": rf"""WITH {BUILDS}, p AS (SELECT DISTINCT lower({_strip('p')}) AS phrase FROM (SELECT canonical, unnest(list_concat([canonical], coalesce(aliases, []))) AS p FROM builds) WHERE {_strip('p')} <> '' AND {_strip('canonical')} <> '')
SELECT phrase, CASE WHEN regexp_full_match(phrase, '[a-z0-9 ]+') THEN '\b' || regexp_replace(phrase, ' +', '\\s+', 'g') || '\b' END AS pattern FROM p""",
    "answer_texts": rf"""SELECT mention_id, coalesce({_strip('evidence_text')}, '') AS text,
  'HTTP ' || (mention_id % 600)::VARCHAR || CASE WHEN {_strip(r"regexp_replace(substring(coalesce(evidence_text, ''), 1, 300), '[\r\n]+', ' ', 'g')")} <> '' THEN ': ' || {_strip(r"regexp_replace(substring(coalesce(evidence_text, ''), 1, 300), '[\r\n]+', ' ', 'g')")} ELSE '' END AS error FROM skill""",
    "embedding_threshold": f"WITH {VECTORS} SELECT vec_id, query_id, round(s, 4) AS similarity FROM sims WHERE s >= 0.2",
    "embedding_top1": f"""WITH {VECTORS}, best AS (SELECT vec_id, arg_min(query_id, (-s, query_id)) AS query_id, max(s) AS s FROM sims GROUP BY vec_id)
SELECT vec_id, CASE WHEN s >= 0.2 THEN query_id ELSE -1 END AS query_id, round(s, 4) AS similarity FROM best""",
    "embedding_best": f"WITH {VECTORS} SELECT query_id, greatest(max(round(s, 4)), 0.0) AS similarity FROM sims WHERE s >= 0.2 GROUP BY query_id",
    "cosine_to_entry": f"WITH {VECTORS} SELECT e.vec_id, (e.vec_id // 100) * 100 AS query_id, round(coalesce(s, 0.0), 4) AS confidence FROM embeddings e LEFT JOIN sims ON sims.vec_id = e.vec_id AND sims.query_id = (e.vec_id // 100) * 100",
    "combine_rank_topn": f"WITH {_RANK} SELECT file_id, skill, round(score, 4) AS score, level, place FROM placed WHERE place <= 25",
    "context_score": f"SELECT mention_id, {_context('evidence_text')} AS score FROM skill",
    "level_from_signals": f"""WITH m AS (SELECT mention_id, {_collapsed('evidence_text')} AS hay, list_filter([{_norm('skill_name')}], lambda a: a IS NOT NULL AND a <> '') AS names FROM skill)
SELECT mention_id, {_level('hay', 'names')} AS level FROM m""",
    "level_window": f"WITH {_WINDOW} SELECT doc_id, skill, first_at, {_level('hay', 'names')} AS level FROM snippets",
    "ci_first_wins": f"SELECT file_id, arg_min({_strip('skill_name')}, mention_id) AS item FROM skill WHERE {_strip('skill_name')} <> '' GROUP BY file_id, lower({_strip('skill_name')})",
    "gap_missing": f"WITH {SIDES} SELECT uploader_id, skill FROM job EXCEPT SELECT uploader_id, skill FROM res",
    "gap_matching": f"WITH {SIDES} SELECT uploader_id, skill FROM job INTERSECT SELECT uploader_id, skill FROM res",
    "gap_lists": f"""WITH {SIDES},
r AS (SELECT uploader_id, list_sort(list(skill)) AS r FROM res GROUP BY uploader_id), j AS (SELECT uploader_id, list_sort(list(skill)) AS j FROM job GROUP BY uploader_id),
b AS (SELECT uploader_id, coalesce(r, []) AS r, coalesce(j, []) AS j FROM r FULL JOIN j USING (uploader_id))
SELECT uploader_id, array_to_string(r, '|') AS resume_skills, array_to_string(j, '|') AS jd_skills,
  array_to_string(list_filter(j, lambda x: NOT list_contains(r, x)), '|') AS missing_skills, array_to_string(list_filter(j, lambda x: list_contains(r, x)), '|') AS matching_skills FROM b""",
    "llm_parse_flat": f"SELECT mention_id, {_strip('skill_name')} AS item FROM skill WHERE {_strip('skill_name')} <> ''",
    "llm_validate": f"""SELECT mention_id, {_strip("coalesce(skill_name, 'None')")} AS skill_name, {_strip("coalesce(category, 'None')")} AS category, lower({_strip('level')}) AS level, years_experience, {_strip("coalesce(evidence_text, 'None')")} AS evidence_text, confidence
FROM skill WHERE {_strip("coalesce(skill_name, 'None')")} <> '' AND {_strip("coalesce(category, 'None')")} <> '' AND {_strip("coalesce(evidence_text, 'None')")} <> ''
AND lower({_strip('level')}) IN ('beginner', 'intermediate', 'advanced', 'unknown') AND confidence BETWEEN 0 AND 1""",
    "record_validation": f"""SELECT mention_id, coalesce({_strip('skill_name')} <> '', false) AND coalesce({_strip('category')} <> '', false) AND coalesce({_strip('evidence_text')} <> '', false)
AND coalesce(lower({_strip('level')}) IN ('beginner', 'intermediate', 'advanced', 'unknown'), false) AND coalesce(confidence BETWEEN 0 AND 1, false) AS valid FROM skill""",
    "level_attach": f"""WITH {FLAT}, lv AS (SELECT file_id, {_norm('skill_name')} AS skill, max({_context('evidence_text')}) AS level FROM skill GROUP BY ALL)
SELECT file_id, skill, coalesce(level, 1) AS level FROM normal LEFT JOIN lv USING (file_id, skill)""",
}
