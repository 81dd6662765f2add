"""Text functions as Columns: every one is planned and compiled by Spark unless its text says otherwise.

All of them give null for null, unless stated. Java's patterns need care to agree with the usual Unicode ones:
``(?U)`` for classes, ``(?d)`` so that only LF ends a line, ``\\z`` for the end of the text.
"""

from __future__ import annotations

import html as _html
import json
import re
import unicodedata
from collections.abc import Callable
from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import PUNCTUATION_DROPPED

WHITE = r"[\s\x1c-\x1f]"
SIMPLE = r"\A[a-z0-9 ]+\z"
#: Placed around a phrase: it must not touch a word character.
NOT_BEFORE, NOT_BEHIND = r"(?U)(?<!\w)", r"(?!\w)"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once: as a lambda's variable, since Spark would repeat it inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def exploded(df: DataFrame, keep: list[str], value: Column, name: str, pos: str | None = None) -> DataFrame:
    """``keep`` and one row for each element of ``value`` that is not null. A plain explode would have the planner infer a filter
    on the array's size, which computes a costly array twice."""
    if pos:
        return df.select(*keep, F.posexplode_outer(value).alias(pos, name)).where(F.col(name).isNotNull())
    return df.select(*keep, F.explode_outer(value).alias(name)).where(F.col(name).isNotNull())


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends; ``trim`` takes only U+0020."""
    return F.regexp_replace(_c(c), rf"(?U)\A{WHITE}+|{WHITE}+\z", "")


def not_blank(c: Column | str) -> Column:
    """True where there is more than white space; null counts as blank."""
    return F.coalesce(_c(c).rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def collapse(c: Column | str) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(_c(c), rf"(?U){WHITE}+", " ")


def skill_norm(c: Column | str) -> Column:
    """Stripped, lower case, white space collapsed."""
    return F.trim(collapse(F.lower(_c(c))))


def match_norm(c: Column | str) -> Column:
    """Lower case, blanks and tabs collapsed, stripped; line breaks stay."""
    return strip(F.regexp_replace(F.lower(_c(c)), r"[ \t]+", " "))


def clean_page_text(c: Column | str) -> Column:
    """Clean-up of text read from a document. Blank lines vanish wholly, so that their neighbours join; kept as the result is relied on."""
    t = F.regexp_replace(F.regexp_replace(strip(c), r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"(?mdU)^\s+|\s+$", "")


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def nfkc(c: Column | str) -> Column:
    """Compatibility composition. Spark has no built-in; only texts that are not ASCII go to Python."""
    c = _c(c)
    plain = c.rlike(r"\A\p{ASCII}*\z")
    return F.when(plain, c).otherwise(_nfkc(F.when(~plain, c)))


def clean_layout_text(c: Column | str) -> Column:
    """Clean-up of text read with its layout: NFKC, LF line ends, blanks collapsed, at most one blank line, stripped. Null gives ''."""
    t = F.regexp_replace(F.regexp_replace(nfkc(c), r"\r\n?", "\n"), r"[ \t]+", " ")
    return F.coalesce(strip(F.regexp_replace(t, r"\n{3,}", "\n\n")), F.lit(""))


def clean_corpus_text(c: Column | str) -> Column:
    """Lower case; all but a-z, 0-9, +, #, . and white space, and whole numbers, become spaces; collapsed. Null gives ''."""
    t = F.regexp_replace(F.replace(F.lower(_c(c)), F.lit("\r"), F.lit("\n")), r"[^a-z0-9\s+#.]", " ")
    t = F.regexp_replace(t, r"\b\d+\b", " ")
    return F.coalesce(F.trim(F.regexp_replace(t, r"\s+", " ")), F.lit(""))


class _Text(HTMLParser):
    HIDDEN = frozenset({"script", "style", "template", "noscript"})

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in self.HIDDEN

    def handle_endtag(self, tag: str) -> None:
        if tag in self.HIDDEN and self.hidden:
            self.hidden -= 1

    def handle_data(self, data: str) -> None:
        if not self.hidden and data:
            self.parts.append(data)


def html_text(markup: str | None) -> str:
    """The text nodes of markup joined by spaces, without scripts, styles and comments; '' for null."""
    if not markup:
        return ""
    p = _Text()
    try:
        p.feed(markup)
        p.close()
    except AssertionError:  # markup that the parser gives up on
        return _html.unescape(markup)
    return " ".join(p.parts)


@F.pandas_udf(T.StringType())
def html_to_text(s: pd.Series) -> pd.Series:
    return s.map(html_text)


def html_to_text_native(c: Column | str) -> Column:
    """The same for plain markup without leaving the JVM: comments, scripts, styles and tags become spaces; five entities are read."""
    t = F.regexp_replace(_c(c), r"(?is)<!--.*?-->|<(script|style|template|noscript)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(sign))
    return strip(collapse(t))


def sentences(c: Column | str) -> Column:
    """array<string>: split at line ends and full stops, lower case, stripped, without empty ones. Null and '' give an empty array."""
    parts = F.transform(F.split(F.coalesce(_c(c), F.lit("")), r"[.\r\n]"), lambda x: strip(F.lower(x)))
    return F.filter(parts, lambda x: x != "")


def is_simple(c: Column | str) -> Column:
    return _c(c).rlike(SIMPLE)


def quoted(c: Column | str) -> Column:
    """A literal as a pattern."""
    return F.concat(F.lit("\\Q"), F.replace(_c(c), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def alias_pattern(c: Column | str) -> Column:
    """Pattern of a simple alias: its words with any white space between, at word ends. Null for others and for blank ones."""
    c = strip(c)
    return F.when(is_simple(c) & (c != ""), F.concat(F.lit("\\b"), F.regexp_replace(c, r"\s+", r"\\s+"), F.lit("\\b")))


def clean_name(c: Column | str) -> Column:
    """Name of a dictionary entry: lower case, stripped, collapsed, then ASCII punctuation but + # . dropped. Null gives ''."""
    return F.coalesce(strip(F.translate(skill_norm(c), PUNCTUATION_DROPPED, "")), F.lit(""))


def embedding_input(name: Column | str, context: Column | str) -> Column:
    return strip(F.concat(F.coalesce(_c(name), F.lit("")), F.lit(". "), F.coalesce(_c(context), F.lit(""))))


STRUCTURED_HEAD = (
    "List the professional skills that the text below names. Take only what is written there and infer nothing. "
    'Answer with one JSON object and nothing else: {"skills": [{"skill_name": "", "category": "", "level": "", "years_experience": null, "evidence_text": "", "confidence": 0.0}]}\n\nTEXT:\n'
)
FLAT_HEAD = 'Name the skills that the text below states explicitly. Answer with JSON of this form only: {"skills": []}. If there are none, leave the list empty.\n\nText:\n'


def structured_prompt(text: Column | str) -> Column:
    """Request for structured skills of a text."""
    return F.concat(F.lit(STRUCTURED_HEAD), strip(F.coalesce(_c(text), F.lit(""))), F.lit("\n"))


def flat_prompt(text: Column | str) -> Column:
    """Request for the plain list of skills of a text."""
    return F.concat(F.lit(FLAT_HEAD), strip(F.coalesce(_c(text), F.lit(""))), F.lit("\n"))


def without_fence(c: Column | str) -> Column:
    """The inside of the first code fence, else the text itself; stripped."""
    c = _c(c)
    fence = r"(?is)```(?:json)?\s*(.*?)\s*```"
    return strip(F.when(c.rlike(fence), F.regexp_extract(c, fence, 1)).otherwise(c))


#: A brace, or a string with its escapes; one without its end reaches to the end of the text.
_BRACES = re.compile(r'[{}]|"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\Z)', re.S)


def balanced(text: str | None) -> str | None:
    """The first {...} whose braces balance, braces inside strings not counted; null if there is none."""
    begin = text.find("{") if text else -1
    if begin < 0:
        return None
    marks = [m for m in _BRACES.finditer(text, begin) if m.group() in "{}"]
    sums = accumulate(1 if m.group() == "{" else -1 for m in marks)
    return next((text[begin : m.end()] for m, open_ in zip(marks, sums) if not open_), None)


@F.pandas_udf(T.StringType())
def search_object(s: pd.Series) -> pd.Series:
    """``balanced`` of each text: nested braces are beyond regular patterns."""
    return s.map(balanced, na_action="ignore")


def without_trailing_commas(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), r",\s*([}\]])", "$1")


def response_text(c: Column | str) -> Column:
    """The answer inside a model's response; '' where any level is missing."""
    return strip(F.coalesce(F.get_json_object(_c(c), "$.candidates[0].content.parts[0].text"), F.lit("")))


def request_payload(prompt: Column | str) -> Column:
    part = F.array(F.struct(_c(prompt).alias("text")))
    return F.to_json(
        F.struct(F.array(F.struct(part.alias("parts"))).alias("contents"), F.struct(F.lit(0.0).alias("temperature"), F.lit("application/json").alias("responseMimeType")).alias("generationConfig"))
    )


def request_body(prompt: str) -> bytes:
    """The same payload for the client."""
    return json.dumps({"contents": [{"parts": [{"text": prompt}]}], "generationConfig": {"temperature": 0.0, "responseMimeType": "application/json"}}).encode()


def short_error(status: Column | str, body: Column | str) -> Column:
    """Status and the first 300 characters of a response, on one line; never an address or a key."""
    text = strip(F.regexp_replace(F.substring(F.coalesce(_c(body), F.lit("")), 1, 300), r"[\r\n]+", " "))
    return F.concat(F.lit("HTTP "), F.coalesce(_c(status).cast("string"), F.lit("?")), F.when(text != "", F.concat(F.lit(": "), text)).otherwise(F.lit("")))


def is_pdf_name(c: Column | str) -> Column:
    return F.coalesce(F.lower(_c(c)).endswith(".pdf"), F.lit(False))


def context_score(c: Column | str) -> Column:
    """3 where the context says expert or advanced, 2 where intermediate, else 1; null gives 1."""
    c = F.coalesce(F.lower(_c(c)), F.lit(""))
    return F.when(c.rlike(r"\b(expert|advanced)\b"), 3).when(c.rlike(r"\bintermediate\b"), 2).otherwise(1)
