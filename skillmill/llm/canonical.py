"""Problem 5: freely typed values mapped to the entries of a reference list, and those that name none reported."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import collected, cut, load, settled, spread, spread_by
from .sameform import same_form

#: The reference list goes to every worker, so its size is checked.
MOST_REFERENCES = 200_000
#: Soft TF-IDF that an answer needs.
LEAST_SCORE = 0.8
#: A word outside the reference that stands beside complete names says nothing about which is meant if it does so for this share of
#: the names listed, and for so many at least: "basic", "certified in". One that stands beside few ("suite") makes another name.
IDLE_SHARE, IDLE_NAMES = 0.05, 3
#: An entry of a larger share of the rows is met by broadcast: there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.002

_TOKEN = re.compile(r"[^\W_]+(?:[.+#]+[^\W_]+)*[+#]*(\.)?")
_VERSION = re.compile(r"v?\d+(?:\.(?:\d+|x))*")


def osa(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions of neighbours; ``most`` + 1 if it is larger than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


def allowed(n: int) -> int:
    """Edits allowed in a word of ``n`` characters."""
    return 0 if n < 4 else 1 if n < 6 else 2


def _deletes(word: str, most: int) -> set[str]:
    """The word without each choice of up to ``most`` characters."""
    out = {word}
    for k in range(1, most + 1):
        for at in combinations(range(len(word)), k):
            out.add("".join(c for i, c in enumerate(word) if i not in at))
    return out


#: Names written together are held against entries of so many characters and more.
LONG_NAME = 8


def allowed_together(n: int) -> int:
    """Edits allowed in a name of ``n`` characters written together."""
    return 2 if n < 13 else 3


class Together:
    """Names by edit distance through their parts. An edit touches two neighbouring parts at most, so of 2k + 1 parts k edits leave one
    as it is, moved by k characters at most."""

    def __init__(self, names: Iterable[str]) -> None:
        self.of: dict[tuple[int, int, str], list[str]] = defaultdict(list)
        self.letters: dict[str, Counter] = {}
        for w in names:
            self.letters[w] = Counter(w)
            for i, (lo, hi) in enumerate(self._parts(len(w))):
                self.of[len(w), i, w[lo:hi]].append(w)
        self.lengths = {len(w) for w in self.letters}

    @staticmethod
    def _parts(n: int) -> list[tuple[int, int]]:
        parts = 2 * allowed_together(n) + 1
        return [(n * i // parts, n * (i + 1) // parts) for i in range(parts)]

    def find(self, text: str) -> list[tuple[str, int]]:
        own, n, out = Counter(text), len(text), []
        for length in range(n - 3, n + 4):
            most = allowed_together(length)
            if length not in self.lengths or abs(length - n) > most:
                continue
            met = {w for i, (lo, hi) in enumerate(self._parts(length)) for at in range(max(0, lo - most), min(n, lo + most) + 1) for w in self.of.get((length, i, text[at : at + hi - lo]), ())}
            for w in met:
                if (own - self.letters[w]).total() <= most and (self.letters[w] - own).total() <= most and (d := osa(text, w, most)) <= most:
                    out.append((w, d))
        return sorted(out)


def reach(n: int) -> int:
    """Characters left out of a token of ``n`` characters, so that it meets every listed word within the edits allowed in that word."""
    return max(allowed(n + k) for k in range(4))


def near_words(probes: DataFrame, words: DataFrame, longest: int) -> DataFrame:
    """``probe, word, d``: the words (``word``) within the edits allowed in them of each distinct token (``probe``).

    An equality join: two strings within k edits share a form with up to k characters left out of each. Tokens that are longer
    than any word within reach meet none."""

    def left_out(most: Callable[[int], int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 2048):
                    part = b.slice(at, 2048)
                    forms = [list(_deletes(x, most(len(x)))) if len(x) <= longest + most(len(x)) else [] for x in part.column(0).to_pylist()]
                    rows = pa.array([i for i, f in enumerate(forms) for _ in f], pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column(0).take(rows), pa.array([x for f in forms for x in f], pa.string())], names=["x", "form"])

        return run

    @F.pandas_udf("int")
    def distance(probe: pd.Series, word: pd.Series) -> pd.Series:
        got = [osa(p, w, allowed(len(w))) for p, w in zip(probe, word)]
        return pd.Series([d if d <= allowed(len(w)) else None for d, w in zip(got, word)], dtype="Int32")

    ours = probes.select("probe").distinct().mapInArrow(left_out(reach), "x string, form string").withColumnRenamed("x", "probe")
    theirs, _ = settled(words.select("word").mapInArrow(left_out(allowed), "x string, form string").withColumnRenamed("x", "word"))
    met = ours.join(theirs, "form").select("probe", "word").distinct()
    return met.withColumn("d", distance("probe", "word")).where("d is not null")


Repairs = dict[str, list[tuple[str, int]]]


class Reference:
    """The reference list, for ``name``: entry -> id of what it names, or -1. ``idle`` are words that say nothing about that."""

    def __init__(self, rows: list[tuple[int, str, list[str] | None]], idle: frozenset[str] = frozenset()) -> None:
        self.idle = idle
        self.forms: list[tuple[int, tuple[str, ...]]] = []
        self.exact: dict[tuple[str, ...], int] = {}
        for i, name, others in sorted(rows):
            for f in [name, *(others or ())]:
                if f and (t := tuple(x for x, _ in self._split(f))):
                    self.forms.append((i, t))
                    self.exact.setdefault(tuple(sorted(t)), i)
        n = len(self.forms)
        has = Counter(t for _, f in self.forms for t in set(f))
        self.idf = {t: math.log(1 + n / c) for t, c in has.items()}
        self.rarest = math.log(1 + n)
        self.holding: dict[str, list[int]] = defaultdict(list)
        for k, (_, f) in enumerate(self.forms):
            for t in set(f):
                self.holding[t].append(k)
        self.starts: dict[str, list[str]] = defaultdict(list)
        for t in self.idf:
            for k in range(3, len(t)):
                self.starts[t[:k]].append(t)
        self.joined: dict[str, int] = {}
        for i, f in self.forms:
            self.joined.setdefault("".join(f), i)
        self.together = Together(j for j in self.joined if len(j) >= LONG_NAME)
    @staticmethod
    def _split(entry: str) -> list[tuple[str, bool]]:
        return [(m.group().rstrip("."), bool(m.group(1))) for m in _TOKEN.finditer(same_form(entry))]

    def repairable(self) -> list[str]:
        """What tokens are held against. Codes, such as words with digits, are not repaired: each neighbour of one may be another."""
        return [t for t in self.idf if not any(c.isdigit() for c in t)]

    def companions(self, tokens: list[str]) -> tuple[int, list[str]]:
        """If the listed ones of an entry's tokens are a complete name: its id and the other tokens."""
        known = tuple(sorted(t for t in tokens if t in self.idf))
        i = self.exact.get(known) if known else None
        return (i, [t for t in tokens if t not in self.idf and not _VERSION.fullmatch(t)]) if i is not None else (-1, [])

    def rest(self, tokens: list[str], cuts: list[bool]) -> list[tuple[str, bool]]:
        """The tokens that say what is meant."""
        return [(t, c) for t, c in zip(tokens, cuts) if t in self.idf or not (t in self.idle or _VERSION.fullmatch(t))]

    def probes(self, tokens: list[str], cuts: list[bool]) -> list[str]:
        """The tokens of an entry that ask to be repaired; none if it is a name as it is."""
        left = self.rest(tokens, cuts)
        if not left or tuple(sorted(tokens)) in self.exact or tuple(sorted(t for t, _ in left)) in self.exact:
            return []
        return list(dict.fromkeys(t for t, _ in left if t not in self.idf))

    def name(self, tokens: list[str], cuts: list[bool], repairs: Repairs) -> int:
        """The id that the tokens name, -1 if none: repaired tokens are held to complete names by soft TF-IDF. ``repairs`` has
        the listed words near each token, with their distance."""
        if (i := self.exact.get(tuple(sorted(tokens)))) is not None:
            return i
        left = self.rest(tokens, cuts)
        if not left:
            return -1
        if (i := self.exact.get(tuple(sorted(t for t, _ in left)))) is not None:
            return i
        best = (0.0, 0, -1)
        found = [self._repaired(t, cut, repairs.get(t, ())) for t, cut in left]
        weight = [max((self.idf[w] for w, _ in f), default=self.rarest) for f in found]
        norm = math.sqrt(sum(w * w for w in weight))
        for k in {k for f in found for w, _ in f for k in self.holding[w]}:
            i, form = self.forms[k]
            open_, score = list(form), 0.0
            for f in sorted(found, key=lambda f: -max((s for _, s in f), default=0)):
                at = max(((s, w) for w, s in f if w in open_), default=None)
                if at:
                    open_.remove(at[1])
                    score += at[0] * self.idf[at[1]] ** 2
            score /= norm * math.sqrt(sum(self.idf[w] ** 2 for w in form))
            best = max(best, (score, -i, i))
        whole = "".join(t for t, _ in left)
        if best[0] < LEAST_SCORE and len(whole) >= LONG_NAME:  # what no tokens name may be a name written together: one long token
            for w, d in self.together.find(whole):
                i = self.joined[w]
                best = max(best, (1 - d / max(len(w), len(whole)), -i, i))
        return best[2] if best[0] >= LEAST_SCORE else -1

    def _repaired(self, token: str, cut: bool, near: Iterable[tuple[str, int]]) -> list[tuple[str, float]]:
        """Reference words that a token may stand for, with similarity: itself, or words near by edits, or those it begins."""
        if token in self.idf:
            return [(token, 1.0)]
        got = {w: 1 - d / max(len(w), len(token)) for w, d in near}
        if cut:
            got |= {w: 0.95 for w in self.starts.get(token, ())}
        return sorted(got.items())


_MADE: dict[int, Reference] = {}


def map_entries(df: DataFrame, reference: DataFrame, keys: list[str], entry: str = "entry") -> DataFrame:
    """``keys, entry, canonical_id`` of every row: the id of the reference entry that ``entry`` names, -1 if none.

    Method: the distinct tokens of the distinct entries are joined to the reference's words by edit distance (``near_words``);
    then complete names are ranked by soft TF-IDF over the repaired tokens; ties go to the least id. Words that stand beside
    many names without belonging to one weigh nothing, see IDLE_SHARE; what they are is counted over all entries. Entries
    written together are held to the names written together. Null and blank entries get a null id. An empty reference gives
    -1 everywhere. Each distinct entry is mapped once, whatever the number of rows that hold it; rows get their answer by a
    broadcast of the answers, or by a shuffle in which an entry of a large share of the rows is met by broadcast.
    ``reference`` has canonical_id, canonical and known_aliases; more than MOST_REFERENCES rows are refused.
    """
    spark = df.sparkSession
    rows = reference.select("canonical_id", "canonical", "known_aliases").where("canonical is not null and canonical_id is not null").limit(MOST_REFERENCES + 1).collect()
    if len(rows) > MOST_REFERENCES:
        raise ValueError("the reference list is too long to be sent to every worker")
    listed = [(r[0], r[1], list(r[2] or ())) for r in rows]
    own = Reference(listed)
    chosen = spread(df.select(*keys, F.col(entry).alias("entry")))
    counted = chosen.groupBy("entry").agg(F.count("*").alias("n")).where(F.col("entry").rlike(r"(?U)[^\s\x1c-\x1f]"))

    def reference_of(words: frozenset[str]) -> Callable[[], Reference]:
        sent, made = spark.sparkContext.broadcast((listed, words)), hash((tuple((i, n, tuple(a)) for i, n, a in listed), words))

        def get() -> Reference:
            if made not in _MADE:
                if len(_MADE) > 1:
                    _MADE.clear()
                _MADE[made] = Reference(*sent.value)
            return _MADE[made]

        return get

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [Reference._split(e) for e in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([[t for t, _ in x] for x in parts], pa.list_(pa.string())), pa.array([[c for _, c in x] for x in parts], pa.list_(pa.bool_()))], names=["entry", "n", "tokens", "cuts"])

    entries = cut(spread_by(counted, "entry").mapInArrow(split, "entry string, n bigint, tokens array<string>, cuts array<boolean>"))
    bare = reference_of(frozenset())

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = bare()
        for b in batches:
            got = [(t, i) for x in b.column(0).to_pylist() for i, others in [r.companions(x)] for t in others]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in got], pa.string()), pa.array([i for _, i in got], pa.int64())], names=["word", "i"])

    names = entries.select("tokens").mapInArrow(beside, "word string, i bigint").distinct().groupBy("word").agg(F.count("*").alias("names"))
    idle = frozenset(w for w, _ in collected(names.where(F.col("names") >= max(IDLE_NAMES, IDLE_SHARE * len({i for i, _ in own.forms})))) or ())
    full = reference_of(idle)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = full()
        for b in batches:
            asked = [(e, p) for e, t, c in zip(*(x.to_pylist() for x in b.columns)) for p in r.probes(t, c)]
            yield pa.RecordBatch.from_arrays([pa.array([a[j] for a in asked], pa.string()) for j in range(2)], names=["entry", "probe"])

    asked = entries.select("entry", "tokens", "cuts").mapInArrow(ask, "entry string, probe string")
    words = spark.createDataFrame([(w,) for w in own.repairable()], "word string")
    near = near_words(asked, words, max(map(len, own.repairable()), default=0))
    repaired = asked.join(near, "probe").groupBy("entry").agg(F.collect_list(F.struct("probe", "word", "d")).alias("near"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = full()
        for b in batches:
            ids = []
            for tokens, cuts, near_ in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                repairs: Repairs = {}
                for x in near_ or ():
                    repairs.setdefault(x["probe"], []).append((x["word"], x["d"]))
                ids.append(r.name(tokens, cuts, repairs))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.int64()), b.column(4)], names=["entry", "canonical_id", "n"])

    answers = entries.join(repaired, "entry", "left").select("entry", "tokens", "cuts", "near", "n").mapInArrow(answer, "entry string, canonical_id bigint, n bigint")
    found, small = settled(answers)
    if small:
        return chosen.join(found.drop("n"), "entry", "left").select(*keys, "entry", "canonical_id")
    most = HOT_SHARE * chosen.count()
    hot = chosen.join(F.broadcast(found.where(F.col("n") > most).select("entry", F.col("canonical_id").alias("_hot"))), "entry", "left")
    rest = hot.where("_hot is null").drop("_hot").join(found.where(F.col("n") <= most).drop("n"), "entry", "left")
    return hot.where("_hot is not null").withColumnRenamed("_hot", "canonical_id").select(*keys, "entry", "canonical_id").unionByName(rest.select(*keys, "entry", "canonical_id"))


def p5_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, row_id, entry of skill names and of each distinct key and alias of a build."""
    names = load(spark, sf_dir, "skill").select(F.lit("skill").alias("src"), F.col("mention_id").alias("row_id"), F.col("skill_name").alias("entry"))
    maps = load(spark, sf_dir, "final_skills").select("build_id", "aliases_by_canonical").where("aliases_by_canonical is not null")
    lists = F.expr("array_distinct(concat(map_keys(aliases_by_canonical), flatten(filter(map_values(aliases_by_canonical), x -> x is not null))))")
    return names.unionByName(maps.select(F.lit("final_skills").alias("src"), F.col("build_id").alias("row_id"), F.explode(lists).alias("entry")))


def p5_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry that is not blank, with the id of what it names or -1."""
    return map_entries(p5_entries(spark, sf_dir), load(spark, sf_dir, "canonical_skills"), ["src", "row_id"]).where("canonical_id is not null")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.broadcast(load(spark, sf_dir, "canonical_skills").select(F.col("canonical").alias("entry")))
    return p5_mapped(spark, sf_dir).join(names, "entry", "left_anti").select("src", "row_id", "entry", "canonical_id")


def p5_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of entries that name nothing in the list, with the rows that hold each."""
    return p5_mapped(spark, sf_dir).where("canonical_id = -1").groupBy("src", "entry").agg(F.count("*").alias("n_rows"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p5_found": p5_found, "p5_mapped": p5_mapped, "p5_unmatched": p5_unmatched}
SQL: dict[str, str] = {}  # repair by edit distance with soft TF-IDF is not expressible; tests compare with brute force and planted typos
