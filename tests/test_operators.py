import re

from pyspark.sql import functions as F

from skillmill import session
from skillmill.operators import dictionary as dic
from skillmill.operators import matching, results, similarity
from skillmill.operators import vocabulary as voc

ENTRIES = "canonical string, aliases array<string>, pos bigint"
DOC = "doc_id bigint, text string"


def entries(spark, d):
    return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(d.items())], ENTRIES)


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


SEVEN = {"aws": ["aws"], "docker": ["docker"], "machine learning": ["machine learning", "ml"], "mysql": ["mysql"], "python": ["python"], "react": ["react"], "sql": ["sql", "mysql"]}


def test_keyword_match(spark):
    docs = spark.createDataFrame(
        [(1, "Skills: Python, SQL, React, AWS, Docker, machine learning. mysql"), (2, "PythonX my_sql machine  learning"), (3, None), (4, ""), (5, "MACHINE LEARNING"), (5, "MACHINE LEARNING"), (None, "aws")], DOC
    )
    got = matching.match_phrases(docs, dic.for_keywords(entries(spark, SEVEN))).collect()
    assert sorted(r.canonical for r in got if r.doc_id == 1) == ["aws", "docker", "machine learning", "mysql", "python", "react", "sql"]
    assert not [r for r in got if r.doc_id in (2, 3, 4)]
    assert [r.canonical for r in got if r.doc_id == 5] == ["machine learning"]
    assert [r.canonical for r in got if r.doc_id is None] == ["aws"]


def test_keyword_match_against_patterns(spark):
    """Every kind of phrase against a pattern search."""
    phrases = ["c++", "c#", ".net", "node.js", "sql", "data base", "été", "a b c", "++", "x-y", "b"]
    texts = ["c++ and C#!", "c+++", "(.net) node.js x.net", "data base sql", "data  base", "été x-y", "l'été a b c", "a b  c", "++ here", "c++x b", "x-y-z", "my_sql", "à b"]
    docs = spark.createDataFrame(list(enumerate(texts)), DOC)
    got = pairs(matching.match_phrases(docs, dic.for_keywords(entries(spark, {p: [p] for p in phrases}))))
    want = sorted((i, p) for i, t in enumerate(texts) for p in phrases if re.search(rf"(?<!\w){re.escape(p)}(?!\w)", t.lower()))
    assert got == want


def test_matchers_with_nothing(spark):
    docs = spark.createDataFrame([(1, "python")], DOC)
    assert matching.match_phrases(docs, dic.empty_rows(spark)).count() == 0
    assert matching.match_rules(docs, dic.empty_rows(spark)).count() == 0
    none = spark.createDataFrame([], DOC)
    assert matching.match_phrases(none, dic.for_keywords(entries(spark, SEVEN))).count() == 0
    clash = spark.createDataFrame([(1, "python", "x", "y", 3)], "doc_id bigint, text string, canonical string, phrase string, _n int")
    assert pairs(matching.match_phrases(clash, dic.for_keywords(entries(spark, SEVEN)))) == [(1, "python")]


def test_rule_match(spark):
    docs = spark.createDataFrame([(1, "Uses machine \t learning.\nnode.js and c++11"), (2, "pythonic"), (3, None)], DOC)
    d = {"ml": ["machine learning"], "node": ["node.js", "node"], "cpp": ["c++"], "python": ["python"], "bare": []}
    assert pairs(matching.match_rules(docs, dic.for_rules(entries(spark, d)))) == [(1, "cpp"), (1, "ml"), (1, "node")]


def test_phrases_without_anchor_have_no_cap(spark, monkeypatch):
    """More of them than the broadcast bound: all are matched, by broadcast and by shuffle."""
    phrases = ["my_key", "_", "été", "naïve bayes", "a_b", "é", "машинное обучение", "学习", "机器学习方法论", "x é", "𝒳y", "++", "→", "- -", "€$€$€$€", "/"]
    texts = ["use my_keys or l'étée", "naïve bayes", "Машинное  обучение", "машинное обучение機", "机器学习方法论", "axé", "ax éa", "𝒳yz ++ →", "a - - b", "€$€$€$€ ok", "€$€$€$€€", "a/b", "/", "plain text"]
    docs = spark.createDataFrame(list(enumerate(texts)), DOC)
    e = entries(spark, {p: [p] for p in phrases})
    rules = sorted((i, p) for i, t in enumerate(texts) for p in phrases if p in t.lower())
    words = sorted((i, p) for i, t in enumerate(texts) for p in phrases if re.search(rf"(?<!\w){re.escape(p)}(?!\w)", t.lower()))
    for most in (200_000, 2):
        monkeypatch.setattr(session, "SENT_ROWS", most)
        assert pairs(matching.match_rules(docs, dic.for_rules(e))) == rules
        assert pairs(matching.match_phrases(docs, dic.for_keywords(e))) == words


def test_phrases_that_reach_further_than_the_pieces_at_hand(spark, monkeypatch):
    """Long phrases are compared with the text itself, whatever the reach."""
    long = " ".join(f"w{i}" for i in range(40))
    phrases = [long, f"{long} c++", "- " + long, "été " * 20 + "x", "a b c d e f", "e.f ü"]
    texts = [f"say {long}.", f"{long} c++ x", f"x- {long}", f"y{long}", f"- {long}z", "l'" + "été " * 20 + "xx", "été " * 20 + "x", "A b c d e f!", "a b c d e ff", None]
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0])], DOC)
    e = entries(spark, {p: [p] for p in phrases})
    keyed = [*enumerate(texts), (None, texts[0])]
    rules = sorted(((i, p) for i, t in keyed for p in phrases if t and "." not in p and (re.search(rf"\b{p}\b", t.lower()) if re.fullmatch("[a-z0-9 ]+", p) else p in t.lower())), key=str)
    words = sorted(((i, p) for i, t in keyed for p in phrases if t and re.search(rf"(?<!\w){re.escape(p)}(?!\w)", t.lower())), key=str)
    for reach in (12, 1):
        monkeypatch.setattr(matching, "REACH", reach)
        assert sorted(map(tuple, matching.match_rules(docs, dic.for_rules(e)).collect()), key=str) == rules
        assert sorted(map(tuple, matching.match_phrases(docs, dic.for_keywords(e)).collect()), key=str) == words


def test_loading_rules(spark):
    e = entries(spark, {" SQL ": ["MySQL", None, ""], "sql": ["pg"], "Go": None, "": ["x"]})
    assert pairs(dic.for_keywords(e).select("canonical", "phrase")) == [("go", "go"), ("sql", "mysql"), ("sql", "pg"), ("sql", "sql")]
    assert pairs(dic.for_rules(e).select("canonical", "phrase")) == [("sql", "pg")]
    assert pairs(dic.for_canonicalising(e).select("canonical", "phrase").distinct()) == [("sql", "mysql"), ("sql", "pg"), ("sql", "sql")]
    assert dic.for_profile(e).count() == 2


def test_map_and_look_up_disagree(spark):
    rows = dic.for_flat_map(entries(spark, {"mysql": ["mysql"], "sql": ["mysql", "sql"]}))
    assert {r.phrase: r.canonical for r in dic.last_writer(rows).collect()}["mysql"] == "sql"
    names = spark.createDataFrame([("mysql",), ("nothing",)], "name string")
    assert pairs(similarity.look_up(names, rows).fillna("-")) == [("mysql", "mysql"), ("nothing", "-")]
    assert {r.phrase: r.canonicals for r in dic.reverse_index(rows).collect()}["mysql"] == ["mysql", "sql"]


def test_stage_two(spark):
    e = entries(spark, {"Python": ["py", "123", "the x"], "university": ["university"], "a - b": ["x"], "42": ["y"], "month": None, "C++": ["cpp"], "full time nurse": []})
    got = {r.canonical: r.aliases for r in dic.clean_entries(e).collect()}
    assert got["python"] == ["python", "py"]
    assert "university" not in got and "42" not in got and "full time nurse" not in got
    assert got["c++"] == ["c++", "cpp"]
    assert tuple(dic.cleaning_stats(e).select("original", "final").first()) == (7, len(got))


def test_stage_three(spark):
    names = {"docker": True, "digital": True, "sales sales": False, "client clients": False, "word excel": False, "united states": False, "spring": True, "worked": False, "testing": True, "accountancy": True, "nurse": False, "": False}
    df = spark.createDataFrame([(k, v) for k, v in names.items()], "n string, want boolean").select("n", "want", dic.is_skill(F.col("n")).alias("got"))
    assert [r.n for r in df.collect() if r.want != r.got] == []
    strict = spark.createDataFrame([("digital",)], "n string").select(dic.looks_technical(F.col("n"), strict=True)).first()[0]
    assert strict is False
    e = entries(spark, {"docker": ["docker", "worked", "docker engine"], "worked": ["worked"]})
    assert {r.canonical: r.aliases for r in dic.filter_entries(e).collect()} == {"docker": ["docker", "docker engine"]}
    assert tuple(dic.filtering_stats(e).first()) == (2, 1, 1)


def test_noun_check(spark):
    df = spark.createDataFrame([("account planning", ["NN", "NN"]), ("quickly planned", ["RB", "VBD"]), ("access", ["NN"]), ("agile", ["JJ"]), ("agile method", ["JJ", "XX"]), ("no tags here", None)], "n string, t array<string>")
    got = [r[0] for r in df.select(F.coalesce(dic.noun_check(F.col("t"), F.split("n", " "), F.col("n")), F.lit(False))).collect()]
    assert got == [True, False, False, False, True, False]


def test_filter_with_a_tagger(spark):
    """A tagger decides about names that look neither technical nor like a verb."""
    e = entries(spark, {"account plan": ["account plan"], "broadly minded": ["broadly minded"], "docker": ["docker"]})
    tags = lambda tokens: F.transform(tokens, lambda t: F.when(t.endswith("ly"), "RB").when(t == "minded", "VBN").otherwise("NN"))
    got = {r.canonical for r in dic.filter_entries(e, nouns=dic.noun_tagger(tags)).collect()}
    assert got == {"account plan", "docker"}
    assert tuple(dic.filtering_stats(e, dic.noun_tagger(tags)).first()) == (3, 1, 2)


def test_entries_keep_their_order_whatever_their_number(spark):
    df = spark.createDataFrame([(1, {f"k{i}": ["a"] for i in range(5)}), (2**40, {"last": ["a"]})], "b bigint, m map<string,array<string>>")
    got = dic.last_writer(dic.for_flat_map(dic.entries_of_map(df, "m", "b")))
    assert {r.phrase: r.canonical for r in got.collect()}["a"] == "last"


def test_seeds_profile_sample(spark):
    rows = dic.for_keywords(entries(spark, {"sql": ["sql", "tsql"], "zig": ["zig"]}))
    got = {r.canonical: r.aliases for r in dic.merge_seeds(rows).collect()}
    assert got["sql"] == ["mysql", "postgres", "sql", "tsql"] and got["python"] == ["py", "python"] and got["zig"] == ["zig"]
    e = entries(spark, {k: [k] for k in "edcba"})
    assert [r.canonical for r in dic.profile(e, 3).collect()] == ["a", "b", "c"]
    s = [r.canonical for r in dic.sample_entries(e, 3, 1).collect()]
    assert len(s) == 3 == len(set(s)) and s == sorted(s) and dic.sample_entries(e, 9).count() == 5


def test_vocabulary(spark):
    docs = spark.createDataFrame([(i, "the data pipeline of x1 and ab data") for i in range(5)] + [(9, None), (10, " ")], DOC)
    got = [tuple(r) for r in voc.mine(docs, min_df=5, max_terms=10, stop_words=("the", "of", "and")).collect()]
    assert got == [("data", 10, 5), ("data pipeline", 5, 5), ("pipeline", 5, 5)]
    counts = {r.term: (r.tf, r.df) for r in voc.count_terms(docs, min_df=1, stop_words=("the", "of", "and")).collect()}
    assert counts["ab data"] == (5, 5) and counts["pipeline x1"] == (5, 5)
    assert voc.mine(docs.where("false")).count() == 0
    assert voc.mine(docs, min_df=99).count() == 0
    assert "the" in voc.english_stop_words(spark)


VEC = "id string, v array<float>"


def test_similarities(spark):
    items = spark.createDataFrame([("i", [1.0, 0.0]), ("j", [0.6, 0.8]), ("n", None), ("w", [1.0])], VEC)
    skills = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0])], "name string, q array<float>")
    got = sorted((r[0], r[1], round(r[2], 3)) for r in similarity.similarities(items, skills, "id", "v", "name", "q", 0.6).collect())
    assert got == [("i", "a", 1.0), ("i", "b", 1.0), ("j", "a", 0.6), ("j", "b", 0.6), ("j", "c", 0.8)]
    blocked = sorted((r[0], r[1], round(r[2], 3)) for r in similarity.similarities(items, skills, "id", "v", "name", "q", 0.6, most=2).collect())
    assert blocked == got
    for most in (None, 2):
        near = {r[0]: (r[1], round(r[2], 3)) for r in similarity.nearest(items, skills, "id", "v", "name", "q", 0.9, most).collect()}
        assert near == {"i": ("a", 1.0), "j": (None, 0.8)}
    assert near == {"i": ("a", 1.0), "j": (None, 0.8)}
    assert similarity.similarities(items, skills.where("false"), "id", "v", "name", "q").count() == 0
    best = similarity.best_similarity(spark.createDataFrame([("a", -0.5), ("b", 0.2), ("b", 0.7)], "name string, similarity double"), ["name"])
    assert pairs(best) == [("a", 0.0), ("b", 0.7)]
    to = similarity.cosine_to(items.where("id = 'j'").withColumn("name", F.lit("zz")), skills, "v", "name", "q")
    assert to.first().confidence == 0.0


def test_skill_vectors_of_several_lengths(spark):
    """One over-long vector discards no other, in one block as in several."""
    items = spark.createDataFrame([("i", [1.0, 0.0]), ("j", [0.6, 0.8]), ("k", [1.0, 0.0, 0.0]), ("w", [1.0])], VEC)
    skills = spark.createDataFrame([("a", [1.0, 0.0]), ("c", [0.0, 1.0]), ("long", [1.0, 0.0, 0.0]), ("none", None)], "name string, q array<float>")
    for most in (similarity.MOST_NUMBERS, 3, 4):
        got = sorted((r[0], r[1], round(r[2], 3)) for r in similarity.similarities(items, skills, "id", "v", "name", "q", 0.6, most=most).collect())
        assert got == [("i", "a", 1.0), ("j", "a", 0.6), ("j", "c", 0.8), ("k", "long", 1.0)]


def test_fuzzy(spark):
    n = spark.createDataFrame([("machine lerning",), ("xyz",), (None,), ("",)], "name string")
    c = spark.createDataFrame([("machine learning",), ("machine leaning",), ("machine",)], "canonical string")
    got = similarity.fuzzy_match(n, c).collect()
    assert [(r.name, round(r.ratio, 4)) for r in got] == [("machine lerning", 0.9677)]
    assert got[0].canonical == "machine learning"


def test_canonicalise_and_merge(spark):
    raw = spark.createDataFrame(
        [(1, "ML", "intermediate user"), (1, "machine learning", "advanced"), (1, "machine lerning", ""), (1, "??", "x"), (1, None, "x"), (1, " ", None), (2, "SQL", None)], "k int, name string, context string"
    )
    rows = dic.for_canonicalising(entries(spark, {"machine learning": ["ml"], "sql": ["sql"]}))
    got = similarity.canonicalise(raw, rows, "k")
    merged = {(r.k, r.skill): (r.score, r.sources, r.place) for r in similarity.merge_mentions(got, "k").collect()}
    assert merged == {(1, "machine learning"): (3, ["ML", "machine learning", "machine lerning"], 1), (2, "sql"): (1, ["SQL"], 1)}
    vectors = similarity.encode(raw.select(F.lower(F.trim("name")).alias("name")), "name", similarity.HashedEncoder)
    skills = similarity.encode(spark.createDataFrame([("machine learning",), ("sql",)], "canonical string"), "canonical", similarity.HashedEncoder)
    with_v = similarity.canonicalise(raw, rows, "k", vectors=vectors, skills=skills, threshold=0.5).collect()
    assert {(r.k, r.skill) for r in with_v} >= {(1, "machine learning"), (2, "sql")}
    assert next(r.confidence for r in with_v if r.k == 2) > 0.99


def test_dedupe_order(spark):
    m = spark.createDataFrame([(1, "a", 1, 0.7, "x"), (1, "a", 2, 0.6, "y"), (1, "b", 3, 0.7, "z")], "k int, skill string, score int, confidence double, source string")
    got = [(r.skill, r.score, r.confidence, r.sources) for r in similarity.merge_mentions(m, "k").orderBy("place").collect()]
    assert got == [("a", 3, 0.7, ["x", "y"]), ("b", 3, 0.7, ["z"])]
    assert similarity.merge_mentions(m, "k", most=1).count() == 1


def test_normalise_and_first_spelling(spark):
    flat = spark.createDataFrame([(1, " MySQL "), (1, "team"), (1, None), (1, ""), (1, "Rust"), (1, "rust")], "doc_id int, skill string")
    rows = dic.for_flat_map(entries(spark, {"mysql": ["mysql"], "sql": ["mysql", "sql"]}))
    assert pairs(results.normalise(flat, rows)) == [(1, "rust"), (1, "sql")]
    assert pairs(results.normalise(flat, None)) == [(1, "mysql"), (1, "rust")]
    items = spark.createDataFrame([(1, 0, "SQL"), (1, 1, "sql "), (1, 2, " Go"), (1, 3, "")], "doc_id int, pos int, item string")
    assert pairs(results.first_spelling(items)) == [(1, "Go"), (1, "SQL")]


def test_rank_and_levels(spark):
    hits = spark.createDataFrame([(1, "b", True, None, 1), (1, "a", True, -0.5, 1), (1, "c", False, 0.9, 3), (1, "d", True, None, 2)], "doc_id int, skill string, by_rule boolean, similarity double, level int")
    assert [r.skill for r in results.rank(hits).orderBy("place").collect()] == ["d", "a", "b", "c"]
    assert results.rank(hits, most=2).count() == 2 and results.rank(hits, most=0).count() == 4
    final = spark.createDataFrame([(1, "a"), (1, "renamed")], "doc_id int, skill string")
    assert pairs(results.attach_levels(final, hits)) == [(1, "a", 1), (1, "renamed", 1)]
    united = results.unite_hits(spark.createDataFrame([(1, "x")], "doc_id int, canonical string"), spark.createDataFrame([(1, "x", 0.7), (1, "y", 0.8)], "doc_id int, canonical string, similarity double"))
    assert pairs(united) == [(1, "x", True, 0.7), (1, "y", False, 0.8)]


def test_gap(spark):
    df = spark.createDataFrame([(["SQL", " Go "], ["go", "Rust", ""]), (None, ["a"]), (["a"], ["a"])], "r array<string>, j array<string>")
    got = [tuple(r[0]) for r in df.select(results.gap_arrays(F.col("r"), F.col("j"))).collect()]
    assert got == [(["go", "sql"], ["go", "rust"], ["rust"], ["go"]), ([], ["a"], ["a"], []), (["a"], ["a"], [], ["a"])]
    r = spark.createDataFrame([(1, "SQL"), (1, "go")], "k int, skill string")
    j = spark.createDataFrame([(1, "Go"), (1, "rust"), (2, "go")], "k int, skill string")
    missing, matching_ = results.gap_rows(r, j, "k")
    assert pairs(missing) == [(1, "rust"), (2, "go")] and pairs(matching_) == [(1, "go")]
    assert pairs(missing.unionByName(matching_)) == pairs(j.select("k", F.lower("skill")))


def test_parse_flat(spark):
    rows = [(1, '{"skills":["SQL","sql "," Go",""]}'), (2, '{"skills":"x"}'), (3, "not json"), (4, '["a"]'), (5, None), (6, "{}"), (7, '{"skills":[1, null]}'), (8, '{"skills":["a",]}')]
    got = pairs(results.parse_flat(spark.createDataFrame(rows, "doc_id int, raw string")))
    assert [g for g in got if g[0] in (1, 2, 3, 4, 5, 6, 8)] == [(1, "Go"), (1, "SQL")]


GOOD = '{"skill_name":"SQL","category":"db","level":"Advanced","years_experience":3,"evidence_text":"e","confidence":0.5}'


def test_validate(spark):
    def answer(s):
        return '{"skills":[' + s + "]}"

    rows = {
        "ok": answer(GOOD), "fenced": "text ```json\n" + answer(GOOD) + "\n``` end", "comma": '{"skills":[' + GOOD + ",],}", "around": "Sure: " + answer(GOOD) + " bye", "cut": answer(GOOD)[:-3], "two": answer(GOOD) + " or {}", "junk": answer(GOOD)[:-1] + " junk}", "no object": '{"skills":[1]}', "null object": '{"skills":[null]}', "mixed": answer(GOOD + ",7"),
        "string": answer(GOOD.replace("0.5", '"0.5"')), "null name": answer(GOOD.replace('"SQL"', "null")), "high": answer(GOOD.replace("0.5", "1.5")), "no level": answer(GOOD.replace('"level":"Advanced",', "")),
        "no skills": "{}", "null skills": '{"skills":null}', "one bad": answer(GOOD + "," + GOOD.replace('"db"', '" "')), "bad level": answer(GOOD.replace("Advanced", "guru")), "empty": "", "null": None,
        "years": answer(GOOD.replace(":3,", ":null,")), "extra": answer(GOOD.replace('"category"', '"more":{"x":1},"category"')),
    }
    got = {r.doc_id: r for r in results.validate(spark.createDataFrame(list(rows.items()), "doc_id string, raw string")).collect()}
    assert set(got) == {"ok", "fenced", "comma", "around", "string", "null name", "years", "extra", "two"}
    assert got["null name"].skill_name == "None" and got["string"].confidence == 0.5 and got["ok"].level == "advanced" and got["years"].years_experience is None
