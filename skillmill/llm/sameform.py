"""Problem 4: one consistent form for texts that look alike but are made of different characters."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load, spread

# Letters of other scripts that look like a Latin letter, upper case and lower case.
LOOK_ALIKES = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "у": "y", "х": "x", "ԝ": "w", "ү": "y", "к": "k", "ѵ": "v",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
    "α": "a", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    "Ս": "U", "Օ": "O", "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "Տ": "S", "Լ": "L",
}
_TO_LATIN = str.maketrans(LOOK_ALIKES)

#: Format characters that show, such as the Arabic number sign, are not ignorable.
IGNORABLE = r"\p{Default_Ignorable_Code_Point}"
_DROP = regex.compile(rf"{IGNORABLE}+|[\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f]+")
_LINE = regex.compile("\r\n?|[\x0b\x0c\x85  ]")
_SPACE = regex.compile(r"[\p{Zs}]")
#: A word with letters of Latin and of another script.
_MIXED = regex.compile(r"(?=\w*\p{Latin})(?=\w*[\p{L}--\p{Latin}--\p{Common}])\w+", regex.V1)


def _styled() -> str:
    """Character class of full-width, ligature and styled forms of Latin letters, digits and signs."""
    out = []
    for cp in range(0x80, sys.maxunicode + 1):
        c = chr(cp)
        tag = unicodedata.decomposition(c).partition(" ")[0]
        if tag in ("<wide>", "<narrow>", "<font>", "<circle>", "<square>") or 0xFB00 <= cp <= 0xFB06 or (0x2474 <= cp <= 0x24B5):
            plain = unicodedata.normalize("NFKC", c)
            if all(not x.isalpha() or unicodedata.name(x, "").startswith("LATIN") for x in plain):
                out.append(c)
    return "".join(out)


_STYLED: set[str] = set()
_KINDS: dict[str, int] = {}
_DECEIVES, _OTHER, _DROPPED, _SPACES, _BREAKS = 1, 2, 4, 8, 16
#: Marks of no one script, which stand on letters of any: what is left of them in a composed form belongs to no composed letter.
_LOOSE = regex.compile(r"[\p{M}&&[\p{Inherited}\p{Common}]]", regex.V1)
#: Sequences of other scripts that composition may rewrite without a change of looks.
_NATIVE = regex.compile(r"\P{M}?[\p{M}--[\p{Inherited}\p{Common}]]+|[\u1100-\u11ff]+", regex.V1)


def _kind(c: str) -> int:
    """What a character outside ASCII asks for, as bits; kept for each character of Unicode that occurs."""
    if not _STYLED:
        _STYLED.update(_styled())
    k = _OTHER if regex.match(r"[\p{L}--\p{Latin}--\p{Common}]", c, regex.V1) else 0
    if _DROP.match(c):
        k |= _DROPPED | _DECEIVES
    if _SPACE.match(c):
        k |= _SPACES | _DECEIVES
    if _LINE.match(c):
        k |= _BREAKS
    if c in _STYLED or _LOOSE.match(c):
        k |= _DECEIVES
    _KINDS[c] = k
    return k


def _needs(text: str) -> int:
    out = 0
    for c in set(text):
        if c > "~" or c < " ":
            out |= k if (k := _KINDS.get(c)) is not None else _kind(c)
    return out


class _Shown(dict):
    """What a character becomes that compatibility changes but that shows what it is: superscripts, fractions, signs, variants of a letter."""

    def __missing__(self, c: int) -> str:
        _kind(s := chr(c))
        self[c] = s if s in _STYLED or _LOOSE.match(s) or _DROP.match(s) or _SPACE.match(s) else unicodedata.normalize("NFKC", s)
        return self[c]


_SHOWN = _Shown()


def _forms(text: str) -> tuple[str, str, bool]:
    """The consistent form before case is folded, the consistent form, and whether the text deceives: whether the form differs from the
    text by more than what shows in it, or still holds a mark that composes with nothing or a word of two scripts."""
    k = _needs(text)
    lined = _LINE.sub("\n", text) if k & _BREAKS else text
    if lined.isascii() and not k & _DROPPED:
        return lined, lined.casefold(), False
    t = _DROP.sub("", lined) if k & _DROPPED else lined
    if k & _SPACES:
        t = _SPACE.sub(" ", t)
    t = unicodedata.normalize("NFKC", t)
    if k & _DECEIVES:  # what styled characters stand for
        t = _SPACE.sub(" ", _DROP.sub("", t))
    mixed = False
    if k & _OTHER and (m := _MIXED.search(t)):
        t = _MIXED.sub(lambda m: m.group().translate(_TO_LATIN), t)
        mixed = bool(_MIXED.search(t, m.start()))
    shown = _NATIVE.sub(lambda m: unicodedata.normalize("NFC", m.group()), lined.translate(_SHOWN))
    deceives = t != shown or mixed or (bool(k & _DECEIVES) and bool(_LOOSE.search(t)))
    return t, unicodedata.normalize("NFKC", t.casefold()), deceives


def odd(text: str) -> bool:
    """Whether a text holds a character that is not what it looks like, seen from what its consistent form changes; see p4_found in TESTDATA.md."""
    return _forms(text)[2]


def same_form(text: str) -> str:
    """The consistent form: NFKC, without default-ignorable characters, spaces as U+0020 and line ends as LF,
    look-alike letters in words that also have Latin letters as Latin ones, full case folding, NFKC again."""
    return _forms(text)[1]


def normalise(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, form, is_odd`` of every row: the consistent form of ``text``, and whether its characters deceive.

    Null gives a null form and false; empty and blank texts stay as they are but for their spaces. Only texts
    with a character outside printable ASCII go to Python, each distinct value of a batch once; the rest are
    lower-cased in the JVM. Nothing is shuffled. Other columns are not read, so their names cannot clash.
    """

    @F.pandas_udf("form string, is_odd boolean")
    def work(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            codes, values = pd.factorize(s)  # nulls are -1
            done = [_forms(v)[1:] for v in values] + [(None, False)]
            yield pd.DataFrame([done[c] for c in codes], columns=["form", "is_odd"])

    rows = spread(df.select(F.col(key).alias("key"), F.col(text).alias("text")))
    special = F.col("text").rlike(r"[^\x20-\x7e\n\t]")
    got = rows.withColumn("got", work(F.when(special, F.col("text"))))
    return got.select(F.col("key").alias(key), F.when(special, F.col("got.form")).otherwise(F.lower("text")).alias("form"), F.coalesce(F.when(special, F.col("got.is_odd")), F.lit(False)).alias("is_odd"))


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdf = normalise(load(spark, sf_dir, "extract_text_from_pdf"), "parse_id", "text").select(F.lit("extract_text_from_pdf").alias("src"), F.col("parse_id").alias("row_id"), "form", "is_odd")
    skill = normalise(load(spark, sf_dir, "skill"), "mention_id", "evidence_text").select(F.lit("skill").alias("src"), F.col("mention_id").alias("row_id"), "form", "is_odd")
    return pdf.unionByName(skill)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_forms(spark, sf_dir).where("is_odd").select("src", "row_id")


def p4_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each consistent form: how many rows and how many different spellings have it (by hash of the form)."""
    return p4_forms(spark, sf_dir).where("form is not null").groupBy("src", F.xxhash64("form").alias("form_id")).agg(F.count("*").alias("n_rows"), F.count_if("is_odd").alias("n_odd"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p4_found": p4_found, "p4_forms": p4_forms, "p4_same": p4_same}
#: Written from the statement of the cases: ranges of characters, and words of Latin and Cyrillic, Greek or Armenian letters.
_STYLED_SQL = r"[\x{ff01}-\x{ff5e}\x{ffe0}-\x{ffe6}\x{fb00}-\x{fb06}\x{1d400}-\x{1d7ff}\x{2460}-\x{24ea}]"
_HIDDEN_SQL = r"[\x{0300}-\x{036f}\x{20d0}-\x{20f0}\x{00ad}\x{034f}\x{115f}\x{1160}\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{2066}-\x{206f}\x{feff}\x{fe00}-\x{fe0f}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
_MIXED_SQL = r"\p{Latin}[\p{L}\p{M}\p{N}_]*[\p{Cyrillic}\p{Greek}\p{Armenian}]|[\p{Cyrillic}\p{Greek}\p{Armenian}][\p{L}\p{M}\p{N}_]*\p{Latin}"
_ODD_SQL = f"regexp_matches(t, '{_STYLED_SQL}|{_HIDDEN_SQL}|{_MIXED_SQL}')"
SQL: dict[str, str] = {  # the forms themselves need compatibility normalisation, which the SQL at hand lacks
    "p4_found": f"""
SELECT 'extract_text_from_pdf' AS src, parse_id AS row_id FROM (SELECT parse_id, text AS t FROM extract_text_from_pdf) WHERE {_ODD_SQL}
UNION ALL SELECT 'skill', mention_id FROM (SELECT mention_id, evidence_text AS t FROM skill) WHERE {_ODD_SQL}"""
}
