"""Documents matched against a dictionary: by exact phrase and by rule. Neither loops over patterns.

A dictionary of bounded size goes to every worker as one automaton that finds all of its phrases in a single pass over a
text: a narrow map. A larger one is met by equality joins: a text is cut into pieces; each phrase is known by one of its
pieces, the anchor, which stands as a piece of its own in every text that holds the phrase; what stands around it is then
compared. A row of a text is one piece with as many pieces on both sides as the dictionary asks for, so that the work is
in proportion to the text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import exploded, is_simple, let
from ..session import collected, settled

#: Characters of all phrases of an automaton: it takes some 50 bytes for each in every Python worker.
AUTOMATON_CHARS = 4_000_000
#: Phrases of one word that are no longer than this are looked for among a text's words: an automaton would stop in every word.
SHORT = 3
#: What words are made of.
WORD = r"[\p{L}\p{N}_]"
#: Runs of a-z and 0-9, and every other character by itself.
RUNS = r"[a-z0-9]+|[^a-z0-9]"
#: Pieces on either side of an anchor that are compared in the join; what of a phrase lies further off is compared with the text itself.
REACH = 12


@dataclass(frozen=True)
class Phrases:
    """Distinct phrases with anchor, and what stands before and behind it: ``phrase, anchor, pre, post``."""

    rows: DataFrame
    before: int
    behind: int
    far: bool
    marks: tuple[str, ...]


def _anchored(phrases: DataFrame, pattern: str, at: Column, anchor: Column, mark: Column) -> Phrases:
    """``phrases`` (phrase) by their anchors: ``at`` is its place among the pieces ``p``, ``anchor`` what is joined on, ``mark`` its kind."""
    rows = phrases.select("phrase").distinct().withColumn("p", F.regexp_extract_all("phrase", F.lit(pattern), F.lit(0)))
    rows = rows.withColumn("at", at).where("at is not null")
    cut = F.when(F.col("at") > REACH, F.col("at") - REACH).otherwise(F.lit(0))
    n = F.col("at") - cut, F.least(F.lit(REACH), F.size("p") - 1 - F.col("at"))
    rows = rows.select(
        "phrase", anchor.alias("anchor"), F.array_join(F.slice("p", cut + 1, n[0]), "").alias("pre"), F.array_join(F.slice("p", F.col("at") + 2, n[1]), "").alias("post"), mark.alias("mark"),
        n[0].alias("n_pre"), n[1].alias("n_post"), ((F.col("at") > REACH) | (F.size("p") - 1 - F.col("at") > REACH)).alias("far"),
    )
    rows, _ = settled(rows)
    most = rows.agg(F.max("n_pre"), F.max("n_post"), F.bool_or("far"), F.collect_set("mark")).first()
    return Phrases(rows.select("phrase", "anchor", "pre", "post", "far"), most[0] or 0, most[1] or 0, bool(most[2]), tuple(sorted(most[3])))


def _meet(docs: DataFrame, key: str, pattern: str, phrases: Phrases, keys: Column, bounded: bool = False) -> DataFrame:
    """``key, phrase`` of texts (``key, low``) that hold the phrase, once for each occurrence of its anchor. ``keys`` are the anchors
    that the piece ``w`` gives; if ``bounded``, no word character may touch the phrase."""
    more = int(bounded)
    a, b = phrases.before + more, phrases.behind + more

    def around(p: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            pre = F.array_join(F.slice(p, F.greatest(i - a, F.lit(0)) + 1, F.least(i, F.lit(a))), "") if a else F.lit("")
            post = F.array_join(F.slice(p, i + 2, F.lit(b)), "") if b else F.lit("")
            return F.struct(w.alias("w"), pre.alias("before"), post.alias("behind"))

        return F.transform(p, one)

    pieces = let(F.regexp_extract_all("low", F.lit(pattern), F.lit(0)), around)
    spots = exploded(docs, [key], pieces, "x").select(key, F.col("x.w").alias("w"), F.col("x.before").alias("before"), F.col("x.behind").alias("behind"))
    met = spots.select(key, "before", "behind", keys.alias("anchor")).where("anchor is not null") if not phrases.marks or "" in phrases.marks else spots.select(key, "before", "behind", F.explode(keys).alias("anchor"))
    met = met.join(phrases.rows, "anchor").where(F.col("before").endswith(F.col("pre")) & F.col("behind").startswith(F.col("post")))
    if bounded:
        left = F.substring(F.col("before"), F.length("before") - F.length("pre"), F.lit(1))
        right = F.substring(F.col("behind"), F.length("post") + 1, F.lit(1))
        met = met.where(~(((F.length("before") > F.length("pre")) & left.rlike(WORD)) | right.rlike(WORD)) | F.col("far"))
    if not phrases.far:
        return met.select(key, "phrase")
    # phrases that reach further than the pieces at hand: the few texts that may hold them are asked
    whole = F.col("low").contains(F.col("phrase"))
    if bounded:
        whole = whole & F.call_function("rlike", F.col("low"), F.concat(F.lit(rf"(?<!{WORD})\Q"), F.replace("phrase", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(rf"\E(?!{WORD})")))
    asked = met.where("far").select(F.col(key).alias("_k"), "phrase").distinct()
    return met.where("not far").select(key, "phrase").unionByName(asked.join(docs, F.col("_k").eqNullSafe(F.col(key))).where(whole).select(key, "phrase"))


def _longest(pieces: Column) -> Column:
    """Place of the longest of pieces given as structs (length, place); the first on ties."""
    return F.array_max(F.transform(pieces, lambda x: F.struct(x["n"].alias("n"), (-x["i"]).alias("i"))))["i"] * -1


def _by_words(docs: DataFrame, key: str, phrases: DataFrame) -> DataFrame:
    """``key, phrase``: phrases that no word character touches. The anchor is the longest word, or the first sign of a phrase without words."""
    is_word, pieces = rf"\A{WORD}", rf"{WORD}+|(?!{WORD})(?s:.)"
    numbered = F.transform("p", lambda w, i: F.struct(F.length(w).alias("n"), i.alias("i"), w.alias("w")))
    words = F.filter(numbered, lambda x: x["w"].rlike(is_word))
    at = F.when(F.size(words) > 0, _longest(words)).when(F.size("p") > 0, F.lit(0))
    own = _anchored(phrases, pieces, at, F.get("p", F.col("at")), F.when(F.get("p", F.col("at")).rlike(is_word), "").otherwise("sign"))
    keys = F.when(F.col("w") != " ", F.col("w")) if "sign" in own.marks else F.when(F.col("w").rlike(is_word), F.col("w"))
    return _meet(docs, key, pieces, Phrases(own.rows, own.before, own.behind, own.far, ("",)), keys, True)


def _anywhere(docs: DataFrame, key: str, phrases: DataFrame) -> DataFrame:
    """``key, phrase``: phrases found anywhere, which hold a character that is no a-z, 0-9 or space. The anchor is the longest run of
    a-z and 0-9 with another character on both sides, else the first other character, together with the characters beside it."""
    n = F.size("p")
    numbered = F.transform("p", lambda w, i: F.struct(F.length(w).alias("n"), i.alias("i"), w.alias("w")))
    inner = F.filter(numbered, lambda x: x["w"].rlike(r"\A[a-z0-9]") & (x["n"] >= 3) & (x["i"] > 0) & (x["i"] < n - 1))
    rare = F.filter(numbered, lambda x: x["w"].rlike(r"\A[^a-z0-9 ]"))
    at = F.when(F.size(inner) > 0, _longest(inner)).otherwise(F.get(rare, F.lit(0))["i"])
    w, last, first = F.get("p", F.col("at")), F.when(F.col("at") > 0, F.right(F.get("p", F.col("at") - 1), F.lit(1))), F.left(F.get("p", F.col("at") + 1), F.lit(1))
    tagged = lambda tag, c: F.concat(F.lit(tag), c)
    mark = F.when(w.rlike(r"\A[a-z0-9]"), "w").when(last.isNotNull() & first.isNotNull(), "b").when(last.isNotNull(), "l").when(first.isNotNull(), "r").otherwise("s")
    anchor = F.when(mark == "w", tagged("w", w)).when(mark == "b", tagged("b", F.concat(last, w, first))).when(mark == "l", tagged("l", F.concat(last, w))).when(mark == "r", tagged("r", F.concat(w, first))).otherwise(tagged("s", w))
    own = _anchored(phrases, RUNS, at, anchor, mark)
    before, behind = F.right("before", F.lit(1)), F.left("behind", F.lit(1))
    given = {"b": F.concat(before, F.col("w"), behind), "l": F.concat(before, F.col("w")), "r": F.concat(F.col("w"), behind), "s": F.col("w")}
    signs = F.array(*[tagged(m, c) for m, c in given.items() if m in own.marks]) if set(given) & set(own.marks) else F.array().cast("array<string>")
    words = F.array(tagged("w", F.col("w"))) if "w" in own.marks else F.array().cast("array<string>")
    keys = F.when(F.col("w").rlike(r"\A[a-z0-9]"), words).when(F.col("w") != " ", signs)
    return _meet(docs, key, RUNS, Phrases(own.rows, max(own.before, 1), max(own.behind, 1), own.far, own.marks or ("s",)), keys)


def _named(hits: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    """``key, canonical`` of ``key, phrase``."""
    return hits.distinct().join(settled(rows.select("phrase", "canonical").distinct())[0], "phrase").select(key, "canonical")


# ---------------------------------------------------------------- the automaton


def _touches(c: str) -> bool:
    return c.isalnum() or c == "_"


_TOKEN = re.compile(r"\w+")


class Automaton:
    """All phrases of a dictionary at once. ``whole`` asks that no word character touches a phrase."""

    def __init__(self, rows: list[tuple[str, str]], whole: bool) -> None:
        self.whole = whole
        self.short: dict[str, set[str]] = defaultdict(set)
        names: dict[str, set[str]] = defaultdict(set)
        for phrase, canonical in rows:
            few = whole and len(phrase) <= SHORT and all(map(_touches, phrase))
            (self.short if few else names)[phrase].add(canonical)
        self.tree = ahocorasick.Automaton()
        for phrase, canonicals in names.items():
            self.tree.add_word(phrase, (len(phrase), canonicals))
        self.tree.make_automaton()

    def find(self, low: str) -> set[str]:
        """The entries found in a lower-cased text."""
        out: set[str] = set()
        if self.short:
            for w in self.short.keys() & set(_TOKEN.findall(low)):
                out |= self.short[w]
        if not len(self.tree):
            return out
        seen, last = set(), len(low) - 1
        for end, (n, canonicals) in self.tree.iter(low):
            if id(canonicals) in seen:
                continue
            if self.whole and ((end > n - 1 and _touches(low[end - n])) or (end < last and _touches(low[end + 1]))):
                continue
            seen.add(id(canonicals))
            out |= canonicals
        return out


_ENDS = re.compile(r"[.\r]")
_BLANKS = re.compile(r"[^\S\n]+")


class PhraseFinder:
    def __init__(self, rows: list[tuple[str, str]]) -> None:
        self.all = Automaton(rows, True)

    def __call__(self, low: str) -> list[str]:
        return sorted(self.all.find(low))


class RuleFinder:
    """Simple aliases in the text with single blanks, all others in the text as it is; no alias reaches over a sentence's end."""

    def __init__(self, rows: list[tuple[str, str]]) -> None:
        simple = [(" ".join(p.split()), c) for p, c in rows if re.fullmatch("[a-z0-9 ]+", p)]
        self.simple = Automaton(simple, True)
        self.others = Automaton([(p, c) for p, c in rows if not re.fullmatch("[a-z0-9 ]+", p) and not re.search(r"[.\r\n]", p)], False)

    def __call__(self, low: str) -> list[str]:
        t = _ENDS.sub("\n", low)
        return sorted(self.simple.find(_BLANKS.sub(" ", t)) | self.others.find(t))


_MADE: dict[tuple[str, int], Callable[[str], list[str]]] = {}


def _found(spark: SparkSession, dictionary: DataFrame, finder: type) -> Callable[[Column], Column] | None:
    """lower-cased text -> sorted array of the entries found; null where the dictionary is too large for an automaton."""
    rows = collected(dictionary.where("phrase <> '' and canonical is not null").select("phrase", "canonical").distinct())
    if rows is None or sum(len(p) for p, _ in rows) > AUTOMATON_CHARS:
        return None
    rows.sort()
    sent, made = spark.sparkContext.broadcast(rows), (finder.__name__, hash(tuple(rows)))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def find(texts: pd.Series) -> pd.Series:
        if made not in _MADE:
            if len(_MADE) >= 4:
                _MADE.clear()
            _MADE[made] = finder(sent.value)
        return texts.map(_MADE[made], na_action="ignore")

    return find


# ---------------------------------------------------------------- matchers


def phrase_hits(docs: DataFrame, dictionary: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``match_phrases`` without bringing together rows of the same key: no row's entries are repeated."""
    low = docs.select(key, F.lower(F.col(text)).alias("low")).where("low is not null")
    if find := _found(docs.sparkSession, dictionary, PhraseFinder):
        return exploded(low, [key], find("low"), "canonical")
    return _named(_by_words(low, key, dictionary), key, dictionary)


def match_phrases(docs: DataFrame, dictionary: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, canonical``: each document with the entries of which a phrase stands in it, touching no word character.

    Case is ignored. Phrases are looked for independently, so a longer one hides none. The words of a phrase must
    be one space apart. Null and blank texts and an empty dictionary give nothing; copies of a document with
    different keys are matched each; a null key is a key. Phrases of any length and number are matched.
    """
    return phrase_hits(docs, dictionary, key, text).distinct()


def rule_hits(docs: DataFrame, dictionary: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``match_rules`` without bringing together rows of the same key."""
    low = docs.select(key, F.lower(F.col(text)).alias("low")).where("low is not null")
    if find := _found(docs.sparkSession, dictionary, RuleFinder):
        return exploded(low, [key], find("low"), "canonical")
    # sentences end at these characters, so that no phrase may reach over them
    low = low.withColumn("low", F.regexp_replace("low", r"[.\r]", "\n"))
    simple = is_simple(F.col("phrase"))
    spaced = low.withColumn("low", F.regexp_replace("low", r"(?U)[\s\x1c-\x1f&&[^\n]]+", " "))
    plain = dictionary.where(simple).select(F.regexp_replace("phrase", " +", " ").alias("phrase"), "canonical")
    others = dictionary.where(~simple & ~F.col("phrase").rlike(r"[.\r\n]") & (F.col("phrase") != ""))
    return _named(_by_words(spaced, key, plain), key, plain).unionByName(_named(_anywhere(low, key, others), key, others))


def match_rules(docs: DataFrame, dictionary: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, canonical`` by the rule matcher: in any sentence, a simple alias at word ends with any white space between its
    words, or any other alias anywhere. Sentences end at full stops and line ends, so ``node.js`` is never found.

    Nulls, empty inputs and copies as in ``match_phrases``.
    """
    return rule_hits(docs, dictionary, key, text).distinct()
