import random
from collections import Counter

import pytest

from skillmill.llm import frequency, sameform


def test_frequencies_against_counting(spark):
    rng = random.Random(1)
    words = ["hot"] + [f"w{i}" for i in range(30)]
    rows = [(k % 2, [rng.choice(words[: rng.randint(1, 31)]) for _ in range(rng.randint(0, 12))], "x") for k in range(200)] + [(0, None, "x"), (1, [None, "hot"], "x")]
    df = spark.createDataFrame(rows, "src int, terms array<string>, term string")
    got = {(r.src, r.term): (r.n_occurrences, r.n_rows, r.rare, r.common) for r in frequency.term_frequencies(df, by="src").collect()}
    occ, docs, total = Counter(), Counter(), Counter()
    for s, ts, _ in rows:
        total[s] += 1
        clean = [t for t in ts or [] if t is not None]
        occ.update((s, t) for t in clean)
        docs.update((s, t) for t in set(clean))
    assert got == {k: (occ[k], docs[k], docs[k] < 5, docs[k] > 0.4 * total[k[0]]) for k in occ}
    whole = frequency.term_frequencies(df)
    assert {r.term for r in whole.collect()} == {t for _, t in occ}
    assert frequency.term_frequencies(df.where("false")).count() == 0


def test_found(spark, tmp_path):
    texts = ["Alpha beta", "alpha ALPHA b", None, " \t ", "alpha x1y", ""]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id bigint, Resume_str string").write.parquet(str(tmp_path / "resume.parquet"))
    maps = [{"K": [" One", "one", None, ""], "L": None}, {}, None, {"K": ["two"]}]
    spark.createDataFrame([(i, m) for i, m in enumerate(maps)], "build_id bigint, aliases_by_canonical map<string,array<string>>").write.parquet(str(tmp_path / "final_skills.parquet"))
    got = {tuple(r) for r in frequency.p3_found(spark, str(tmp_path)).collect()}
    assert got == {("resume", "alpha", "rare"), ("resume", "alpha", "common"), ("resume", "beta", "rare"), ("final_skills", "one", "rare"), ("final_skills", "two", "rare"), ("final_skills", "one", "common"), ("final_skills", "two", "common")}
    terms = {(r.src, r.term): r.n_occurrences for r in frequency.p3_terms(spark, str(tmp_path)).collect()}
    assert terms[("resume", "alpha")] == 4 and terms[("final_skills", "one")] == 2


ALIKE = [
    ("finance desk", "ﬁnance desk"), ("finance", "fіnanсe"), ("project", "Proje⁠ct"), ("kept it", "𝗸𝗲𝗽𝘁 it"), ("grid 2018", "ｇｒｉｄ ２０１８"), ("café", "café"), ("grijen flow", "grijen　flow"),
    ("a b", "a\xa0b"), ("über", "über"), ("soft hyphen", "so\xadft hyphen"), ("STRASSE", "straße"), ("wind", "w​i‍n﻿d"),
]


@pytest.mark.parametrize("plain, other", ALIKE)
def test_alike_texts_become_equal(plain, other):
    assert sameform.same_form(plain) == sameform.same_form(other)
    assert sameform.odd(other) or other == "straße"
    assert not sameform.odd(plain)


@pytest.mark.parametrize("text", ["Русский, ελληνικά — basics", "日本語能力 한국어 기초", "m² 2º 3ª ™ ® © … “q” – •", "naïve façade Żółta Độ Ísl", "tab\there\r\nline", "", "x" * 100_000, "हिन्दी"])
def test_what_only_resembles_is_no_case(text):
    assert not sameform.odd(text)


def test_other_scripts_and_accents_stay():
    assert sameform.same_form("Русский ελληνικά É") == "русский ελληνικά é"
    assert sameform.same_form("cοffee Ρaris") == "coffee paris"
    assert sameform.same_form("\u0600\u0661 x") == "\u0600\u0661 x" and not sameform.odd("\u0600\u0661 x")  # a format character that shows


@pytest.mark.parametrize("text", ["x\u0302 loose", "xж", "wordжx and more", "①", "a\u0301", "ｗ"])
def test_what_the_form_cannot_mend_is_a_case_too(text):
    assert sameform.odd(text)


def test_normal_form_is_stable():
    rng = random.Random(2)
    alphabet = "aZé́ｆﬁс​\xa0 ß²™\t\nЯ"
    for _ in range(500):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 20)))
        once = sameform.same_form(t)
        assert sameform.same_form(once) == once


def test_column(spark):
    rows = [(1, "Plain Text", 1), (2, "fіnanсe", 1), (3, None, 1), (4, "", 1), (2, "fіnanсe", 1), (None, "A\r\nb", 1)]
    df = spark.createDataFrame(rows, "id bigint, text string, form int")
    got = sorted((str(r.id), str(r.form), r.is_odd) for r in sameform.normalise(df, "id", "text").collect())
    assert got == sorted([("1", "plain text", False), ("2", "finance", True), ("2", "finance", True), ("3", "None", False), ("4", "", False), ("None", "a\nb", False)])
    assert sameform.normalise(df.where("false"), "id", "text").count() == 0
