import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from skillmill.functions import levels as lv
from skillmill.functions import text as tx


def one(spark, value, column, schema="string"):
    return spark.createDataFrame([(value,)], f"x {schema}").select(column(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    "raw, want", [("abc\n\ndef", "abcdef"), ("abc \n def", "abc\ndef"), ("abc\n \ndef", "abc\ndef"), ("abc\r\n\r\ndef", "abc\ndef"), ("", ""), (None, None), (" \t ", "")]
)
def test_page_text(spark, raw, want):
    assert one(spark, raw, tx.clean_page_text) == want


def test_corpus_text(spark):
    assert one(spark, "C++ & C#, 10 yrs .NET été", tx.clean_corpus_text) == "c++ c# yrs .net t"
    assert one(spark, None, tx.clean_corpus_text) == ""


def test_layout_text(spark):
    assert one(spark, "ﬁle a\t b\r\n\r\n\r\n\r\nc ", tx.clean_layout_text) == "file a b\n\nc"
    assert one(spark, None, tx.clean_layout_text) == ""


def test_strip_is_unicode(spark):
    assert one(spark, "  \t x \n ", tx.strip) == "x"


def test_sentences(spark):
    assert one(spark, "Node.js dev.\r\nSQL  ", tx.sentences) == ["node", "js dev", "sql"]
    assert one(spark, None, tx.sentences) == []


@pytest.mark.parametrize("raw, want", [("Advanced Python", 3), ("intermediate ML", 2), ("used Go", 1), ("advancedly", 1), (None, 1)])
def test_context_score(spark, raw, want):
    assert one(spark, raw, tx.context_score) == want


@pytest.mark.parametrize("raw, want", [("a - b", "a  b"), ("scikit-learn", "scikitlearn"), ("C/C++", "cc++"), (" .NET ", ".net"), (None, "")])
def test_clean_name(spark, raw, want):
    assert one(spark, raw, tx.clean_name) == want


def test_html(spark):
    page = "<html><style>p{}</style><p>A &amp; B</p><!-- no --><script>x<1</script><p>caf&eacute;</p></html>"
    assert tx.html_text(page).split() == ["A", "&", "B", "café"]
    assert tx.html_text(None) == ""
    assert one(spark, "<p>A &amp; B</p><script>no</script>", tx.html_to_text_native) == "A & B"


def test_embedding_input(spark):
    df = spark.createDataFrame([("SQL", ""), ("SQL", "used daily"), (None, None)], "n string, c string")
    assert [r[0] for r in df.select(tx.embedding_input("n", "c")).collect()] == ["SQL.", "SQL. used daily", "."]


def test_fence_object_commas(spark):
    assert one(spark, "x ```json\n{\"a\": 1}\n``` y", tx.without_fence) == '{"a": 1}'
    assert one(spark, "no fence ", tx.without_fence) == "no fence"
    assert tx.balanced('x {"a": "}", "b": {"c": 1}} y') == '{"a": "}", "b": {"c": 1}}'
    assert tx.balanced('{"a": {') is None and tx.balanced(None) is None and tx.balanced("none") is None
    assert one(spark, '{"a": [1, ], }', tx.without_trailing_commas) == '{"a": [1]}'


def test_response_and_payload(spark):
    body = '{"candidates": [{"content": {"parts": [{"text": " hi "}]}}]}'
    assert one(spark, body, tx.response_text) == "hi"
    assert one(spark, "{}", tx.response_text) == "" and one(spark, None, tx.response_text) == ""
    assert '"text":"p"' in one(spark, "p", tx.request_payload) and "application/json" in one(spark, "p", tx.request_payload)
    assert one(spark, "boom\nhere " + "x" * 400, lambda c: tx.short_error(F.lit(503), c)).startswith("HTTP 503: boom here")


def test_names_of_files(spark):
    assert one(spark, "A.PDF", tx.is_pdf_name) and not one(spark, "a.txt", tx.is_pdf_name) and not one(spark, None, tx.is_pdf_name)


@pytest.mark.parametrize(
    "text, aliases, want",
    [
        ("2 years of python, strong", ["python"], 1), ("3+ yrs python", ["python"], 2), ("5 years python", ["python"], 3), ("expert python", ["python"], 3), ("strong python", ["python"], 2),
        ("java", ["python"], 1), ("12 years of c++", ["c++"], 3), ("6 years of machine\nlearning", ["machine learning"], 3), ("", ["x"], 1), (None, ["x"], 1), ("x", None, 1), ("2 years x, 7 years y", ["x", "y"], 3),
    ],
)
def test_level(spark, text, aliases, want):
    df = spark.createDataFrame([(text, aliases)], "t string, a array<string>")
    assert df.select(lv.level_of("t", "a")).first()[0] == want


def test_level_window_and_first_mention(spark):
    text = "expert welder. " + "x " * 200 + "python"
    df = spark.createDataFrame([(text, ["python"]), ("no mention, expert", ["python"]), (None, ["a"])], "t string, a array<string>")
    assert [tuple(r) for r in df.select(lv.first_mention("t", "a"), lv.level_near("t", "a")).collect()] == [(text.index("python"), 1), (-1, 1), (-1, 1)]


def spec_clean(t):
    t = (t or "").lower().replace("\r", "\n")
    t = re.sub(r"[^a-z0-9\s+#.]", " ", t)
    return re.sub(r"\s+", " ", re.sub(r"\b\d+\b", " ", t)).strip()


def test_differential(spark):
    """Columns against plain Python over random strings with odd characters."""
    rng = random.Random(3)
    alphabet = "aB9 .+#\t\n\réßñ –-_,x"
    rows = [("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))),) for _ in range(300)]
    got = spark.createDataFrame(rows, "x string").select("x", tx.clean_corpus_text("x").alias("c"), tx.skill_norm("x").alias("n"), tx.match_norm("x").alias("m"), tx.clean_layout_text("x").alias("l")).collect()
    for r in got:
        assert r.c == spec_clean(r.x)
        assert r.n == re.sub(r"\s+", " ", r.x.strip().lower())
        assert r.m == re.sub(r"[ \t]+", " ", r.x.lower()).strip()
        t = re.sub(r"[ \t]+", " ", unicodedata.normalize("NFKC", r.x).replace("\r\n", "\n").replace("\r", "\n"))
        assert r.l == re.sub(r"\n{3,}", "\n\n", t).strip()
