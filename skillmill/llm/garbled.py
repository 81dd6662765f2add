"""Problem 8: texts that were decoded with the wrong character encoding, found and, where possible, restored.

Method. One pass over the corpus counts adjacent character pairs with a character outside ASCII. Each pair is
scored by what it adds to the corpus's mutual information; in each text the maximum-scoring segments of
improbable pairs are isolated, and inverse mappings (write with the wrong encoding, read with the right one)
are tested only inside those. A mapping is taken if the text it gives is likelier than the one it removes, where bytes
that make UTF-8 count for what it is unlikely that ordinary text makes them.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load, spread

#: Pair counts are kept in two rows of this many cells, by two hashes of the pair of which the lesser count holds,
#: so that the table that goes through the driver to every worker has a fixed bound (16 MB) whatever the corpus.
ROW = 1 << 20
#: Behind them lie counts of pairs of character classes and of classes alone.
CLASSES = 16
CELLS = 2 * ROW + CLASSES * CLASSES + CLASSES
#: A pair whose share of mutual information is above this is taken to be ordinary text.
ORDINARY = 2e-3
#: Score of a pair with U+FFFD, which no ordinary text holds, and of a pair within ASCII, which is not counted.
LOST, PLAIN = 5.0, -1.0
#: Log-likelihood that a mapping between one-byte encodings must gain, as any of its bytes are valid; and the evidence of each byte of a
#: UTF-8 sequence: signs and capitals of the upper half seldom stand so by chance.
GAIN_BYTES, BYTE_EVIDENCE = 3.0, 2.0
KEEP = 300_000
#: How many occurrences of a character the likelihood of its class counts for.
WEIGHT = 25.0

# Encodings by which texts are commonly misread, and pairs (misread as, written in) of one-byte ones.
MISREAD = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "latin_1")
ONE_BYTE = (("mac_roman", "cp1252"), ("cp1251", "cp1252"), ("cp1252", "mac_roman"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1250", "cp1252"), ("cp1252", "cp850"))

_HIGH = re.compile(r"[^\x00-\x7f]+")
_ENTITY = r"&(?:#\d{2,7}|#[xX][0-9a-fA-F]{2,6}|[A-Za-z]{2,8}\d{0,2});"
#: A run of entities and of characters beside them, taken from the run's beginning on.
_ENTITIES = re.compile(rf"(?<![^\x00-\x7f])[^\x00-\x7f]*+(?:{_ENTITY}[^\x00-\x7f]*+)+")
_UNIT = re.compile(rf"{_ENTITY}|[^\x00-\x7f]")


def _cells(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two cells of each pair of code points; the pair (a, ALONE) counts a alone."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(44)).astype(np.int64), ((x >> np.uint64(20)) & np.uint64(ROW - 1)).astype(np.int64) + ROW


_CLASS: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of each code point: letters by case and whether they are ASCII, digits, spaces, kinds of signs."""
    if not _CLASS:
        kinds = {"Ll": 1, "Lu": 2, "Lt": 2, "Lo": 3, "Lm": 3, "Nd": 4, "Zs": 5, "Pd": 6, "Pi": 6, "Pf": 6, "Ps": 6, "Pe": 6, "Po": 7, "Sc": 8, "So": 8, "Sm": 8, "Sk": 8, "No": 8, "Cc": 9, "Cf": 9}
        table = np.array([kinds.get(unicodedata.category(chr(c)), 10) for c in range(ALONE)], np.int64)
        table[:128] = [5 if chr(c).isspace() else 11 if chr(c).islower() else 12 if chr(c).isupper() else 13 if chr(c).isdigit() else 14 for c in range(128)]
        _CLASS.append(table)
    return _CLASS[0]


def _add(total: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray | int) -> None:
    for cells in _cells(a, b):
        np.add.at(total, cells, n)


ALONE = 0x110000


def count_pairs(df: DataFrame, text: str) -> np.ndarray:
    """Counts of pairs by cell, over all of every text: partial in each task, summed by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        chars = np.zeros(ALONE, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                joined = "\n".join(t for t in b.column(0).slice(at, 1024).to_pylist() if t)
                c = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
                if not c.size:
                    continue
                n = np.bincount(c)
                chars[: n.size] += n
                high = np.flatnonzero(c > 127)
                first = np.union1d(high, high - 1)
                first = first[(first >= 0) & (first + 1 < c.size)]
                _add(total, c[first], c[first + 1], 1)
                total[2 * ROW : 2 * ROW + CLASSES * CLASSES] += np.bincount(classes()[c[first]] * CLASSES + classes()[c[first + 1]], minlength=CLASSES * CLASSES)
        seen = np.flatnonzero(chars)
        total[-CLASSES:] += np.bincount(classes()[seen], chars[seen], CLASSES).astype(np.int64)
        _add(total, seen, np.full(seen.size, ALONE), chars[seen])
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    sums = spread(df.select(text)).mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(CELLS, np.int64)
    out[sums["cell"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    return out


def segments(scores: list[float]) -> list[tuple[int, int]]:
    """All maximum-scoring segments (Ruzzo and Tompa) of a list of scores, as (start, end)."""
    found: list[list[float]] = []  # start, end, sum before, sum with
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = [i, i + 1, before, total]
        while found:
            j = next((k for k in range(len(found) - 1, -1, -1) if found[k][2] < new[2]), None)
            if j is None or found[j][3] >= new[3]:
                break
            new[0], new[2] = found[j][0], found[j][2]
            del found[j:]
        found.append(new)
    return [(int(f[0]), int(f[1])) for f in found]


def _bytes(codec: str) -> dict[str, int]:
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b  # undefined bytes are commonly passed through
    if codec in ("cp1252", "latin_1"):
        for b in range(128, 160):
            out.setdefault(chr(b), b)
    return out


_TO_BYTE = {c: _bytes(c) for c in MISREAD}


def _recode(codec: str, written: str) -> dict[str, str]:
    out = {}
    for ch, b in _TO_BYTE[codec].items():
        try:
            new = bytes([b]).decode(written)
        except UnicodeDecodeError:
            continue
        if new != ch:
            out[ch] = new
    return out


_RECODE = {pair: _recode(*pair) for pair in ONE_BYTE}


def _sequences(codec: str) -> re.Pattern:
    """The valid UTF-8 sequences of more than one byte, as they look under ``codec``."""

    def any_of(lo: int, hi: int) -> str:
        return "[" + re.escape("".join(c for c, b in _TO_BYTE[codec].items() if lo <= b <= hi)) + "]"

    tail = any_of(0x80, 0xBF)
    kinds = [any_of(0xC2, 0xDF) + tail, any_of(0xC3, 0xC3) + " "]  # the no-break space of a misread a-grave may have become a space
    kinds += [any_of(0xE0, 0xE0) + any_of(0xA0, 0xBF) + tail, any_of(0xE1, 0xEC) + tail * 2, any_of(0xED, 0xED) + any_of(0x80, 0x9F) + tail, any_of(0xEE, 0xEF) + tail * 2]
    kinds += [any_of(0xF0, 0xF0) + any_of(0x90, 0xBF) + tail * 2, any_of(0xF1, 0xF3) + tail * 3, any_of(0xF4, 0xF4) + any_of(0x80, 0x8F) + tail * 2]
    return re.compile("|".join(k for k in kinds if "[]" not in k))


_SEQUENCES = {c: _sequences(c) for c in MISREAD}


def utf8_inverse(s: str, codec: str) -> tuple[str, int]:
    """``s`` with every valid UTF-8 sequence of its bytes under ``codec`` read as UTF-8, and the bytes so read."""
    table, used = _TO_BYTE[codec], 0

    def read(m: re.Match) -> str:
        nonlocal used
        used += len(m.group())
        return bytes(table.get(c, 0xA0) for c in m.group()).decode("utf-8")

    return _SEQUENCES[codec].sub(read, s), used


class Model:
    """Likelihood of character pairs in a corpus, and the search for misread runs with it."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts
        self.pairs: dict[tuple[str, str], tuple[float, float]] = {}
        self.likely: dict[str, float] = {}
        self.runs: dict[str, tuple[bool, list[float]]] = {}
        self.known: dict[tuple[str, str, str], str | None] = {}
        self.all = max(1.0, float(self.look(np.arange(128), np.full(128, ALONE)).sum()))

    def look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        one, two = _cells(a, b)
        return np.minimum(self.counts[one], self.counts[two])

    def pair(self, a: str, b: str) -> tuple[float, float]:
        """log P(b | a), and the score of the pair: positive if it is improbable as ordinary text."""
        got = self.pairs.get((a, b))
        if got is None:
            x, y = (np.array([ord(c) for c in s]) for s in (a + a + b, b + "\0\0"))
            y[1:] = ALONE
            n, na, nb = (float(v) for v in self.look(x, y))
            high = a > "\x7f" or b > "\x7f"
            if "\ufffd" in (a, b):
                got = (math.log(max(nb, 1) / self.all), LOST)
            elif not high:  # such pairs are not counted; they are ordinary
                got = (math.log(max(nb, 1) / self.all), PLAIN)
            else:
                # the pair's share of mutual information, for a corpus of only the non-ASCII characters' surroundings
                share = n / max(na if a > "\x7f" else nb, nb if b > "\x7f" else na, 1.0)
                info = n / self.all * math.log(max(n * self.all / max(na * nb, 1.0), 1.0001)) * share
                # where a pair is rare, what its classes make likely
                ca, cb = (int(classes()[ord(c)]) for c in (a, b))
                by_class = (self.counts[2 * ROW + ca * CLASSES + cb] + 0.01) / (self.counts[ca - CLASSES] + 1) * (nb + 0.05) / (self.counts[cb - CLASSES] + 1)
                got = (math.log((n + WEIGHT * by_class) / (na + WEIGHT)), math.log(ORDINARY) - math.log(info + 1e-12))
            if len(self.pairs) >= KEEP:
                self.pairs.clear()
            self.pairs[a, b] = got
        return got

    def likelihood(self, s: str) -> float:
        """Of the pairs with a character outside ASCII; those within ASCII are the same before and after a mapping."""
        total = 0.0
        for m in _HIGH.finditer(s):
            around = s[max(m.start() - 1, 0) : m.end() + 1]
            got = self.likely.get(around)
            if got is None:
                if len(self.likely) >= KEEP:
                    self.likely.clear()
                got = self.likely[around] = sum(self.pair(a, b)[0] for a, b in zip(around, around[1:]))
            total += got
        return total

    def run(self, around: str) -> tuple[bool, list[float]]:
        """The scores of the pairs of a run with the character before and behind it, and whether one of them is improbable."""
        got = self.runs.get(around)
        if got is None:
            if len(self.runs) >= KEEP:
                self.runs.clear()
            scores = [self.pair(a, b)[1] for a, b in zip(around, around[1:])]
            got = self.runs[around] = (max(scores) > 0, scores)
        return got

    def spans(self, around: str) -> list[tuple[int, int, str | None]]:
        """The parts of a line that were misread, as (start, end, as it was, or null where that is lost). ``around`` is the line with
        a character before and behind it. Stretches of ASCII count as one low score, so that segments are those of all its pairs."""
        scores, first, last, until = [], [], [], 0
        for m in _HIGH.finditer(around):
            lo, hi = m.start() - 1, m.end()
            if scores and lo > until:
                scores.append(PLAIN * (lo - until))
                first.append(until)
                last.append(lo)
            scores += self.run(around[lo : hi + 1])[1]
            first += range(lo, hi)
            last += range(lo + 1, hi + 1)
            until = hi
        out: list[tuple[int, int, str | None]] = []
        at = 0
        for start, end in segments(scores):
            lo, hi = max(first[start] - 1, at), min(last[end - 1], len(around) - 2)
            if lo < hi:
                out += self._mend(around, lo, hi)
                at = hi
        return out

    def _mend(self, around: str, lo: int, hi: int) -> list[tuple[int, int, str | None]]:
        """A segment as one, else each of its runs outside ASCII with the characters beside it."""
        s = around[lo + 1 : hi + 1]
        if (fixed := self.restore(around[lo], s, around[hi + 1])) is not None:
            return [(lo, hi, fixed)]
        runs = [(max(lo, lo + m.start() - 1), min(hi, lo + m.end() + 1)) for m in _HIGH.finditer(s)]
        if len(runs) > 1:
            out: list[tuple[int, int, str | None]] = []
            at = lo
            for a, b in runs:
                if max(a, at) < b:
                    out += self._mend_one(around, max(a, at), b)
                    at = out[-1][1] if out and out[-1][1] > at else at
            return out
        return [(lo, hi, None)] if "\ufffd" in s else []

    def _mend_one(self, around: str, lo: int, hi: int) -> list[tuple[int, int, str | None]]:
        s = around[lo + 1 : hi + 1]
        fixed = self.restore(around[lo], s, around[hi + 1])
        return [(lo, hi, fixed)] if fixed is not None or "\ufffd" in s else []

    def restore(self, before: str, s: str, after: str) -> str | None:
        """A segment as it was, or null if no inverse mapping makes it likelier."""
        if (before, s, after) not in self.known:
            if len(self.known) >= KEEP:
                self.known.clear()
            self.known[before, s, after] = self._inverse(before, s, after)
        return self.known[before, s, after]

    def _entities(self, t: str, start: int, end: int) -> str | None:
        """A run of entities and characters with the misread parts that hold an entity as they were, or null if there are none.

        Entities in one chain with such a part are written as characters; all else stays as it is."""
        units = [m.group() for m in _UNIT.finditer(t, start, end)]
        plain = [html.unescape(u) for u in units]
        run = "".join(plain)
        around = (t[start - 1] if start else "\n") + run + (t[end] if end < len(t) else "\n")
        if run.isascii():
            return None
        owner = [i for i, p in enumerate(plain) for _ in p]
        named = [u.isascii() for u in units]
        decoded, fixes = set(), {}
        for lo, hi, fixed in self.spans(around):
            if fixed is None:
                continue
            i, j = owner[lo], owner[hi - 1] + 1
            if not any(named[i:j]):
                continue
            fixes[lo] = (hi, fixed)
            while i and named[i - 1]:
                i -= 1
            while j < len(units) and named[j]:
                j += 1
            decoded.update(range(i, j))
        if not fixes:
            return None
        out, at, until = [], 0, 0
        for i, (u, p) in enumerate(zip(units, plain)):
            for c in p if i in decoded else ():
                if at in fixes:
                    until, fixed = fixes[at]
                    out.append(fixed)
                elif at >= until:
                    out.append(c)
                at += 1
            if i not in decoded:
                out.append(u)
                at += len(p)
        return "".join(out)

    def _inverse(self, before: str, s: str, after: str) -> str | None:
        here = self.likelihood(before + s + after)
        best: tuple[float, str] | None = None
        for codec in MISREAD:
            new, used = utf8_inverse(s, codec)
            more = used
            while more:  # misread once, or again
                gain = self.likelihood(before + new + after) - here + BYTE_EVIDENCE * used
                if gain > 0 and (best is None or gain > best[0]):
                    best = (gain, new)
                new, more = utf8_inverse(new, codec)
                used += more
        if best is None:
            for pair in ONE_BYTE:
                table = _RECODE[pair]
                if not all(c in table for c in s if c > "\x7f"):
                    continue
                new = "".join(table.get(c, c) for c in s)
                gain = self.likelihood(before + new + after) - here
                if gain > GAIN_BYTES and (best is None or gain > best[0]):
                    best = (gain, new)
        return best[1] if best else None

    def text(self, t: str) -> tuple[bool, str]:
        """Whether a text is affected, and the text restored as far as it can be."""
        hit, out, at = False, [], 0
        if "&" in t and (m := _ENTITIES.search(t)):
            parts, k = [], 0
            for m in _ENTITIES.finditer(t):
                fixed = self._entities(t, *m.span())
                if fixed is not None:
                    parts += [t[k : m.start()], fixed]
                    k, hit = m.end(), True
            t = "".join(parts) + t[k:]
        if t.isascii():
            return hit, t
        n, done = len(t), 0
        for m in _HIGH.finditer(t):
            lo, hi = m.span()
            # only a line with an improbable pair has a segment
            if lo < done or not self.run((t[lo - 1] if lo else "\n") + t[lo : hi + 1] + ("" if hi < n else "\n"))[0]:
                continue
            begin, done = t.rfind("\n", 0, lo) + 1, t.find("\n", hi)
            done = done if done >= 0 else n
            for a, b, fixed in self.spans("\n" + t[begin:done] + "\n"):
                hit = True
                if fixed is not None:
                    out += [t[at : begin + a], fixed]
                    at = begin + b
        return hit, "".join(out) + t[at:] if out else t


def find_garbled(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, is_garbled, restored`` of every row: whether ``text`` holds a misread sequence, and the text with every
    sequence restored that can be. Replaced characters (U+FFFD) make a text affected and stay as they are.

    Null texts give false and null, empty ones false and ''. Each row is judged by itself but for the pair counts,
    which cover all rows. Two scans, no shuffle of texts; other columns of ``df`` are not read.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    counts = count_pairs(rows, "text")
    sent = df.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(sent.value)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                got = [(False, t) if t is None or (t.isascii() and "&" not in t) else model.text(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[0] for g in got], pa.bool_()), pa.array([g[1] for g in got], pa.string())], names=["key", "is_garbled", "restored"])

    kind = df.schema[key].dataType.simpleString()
    return spread(rows).mapInArrow(run, f"key {kind}, is_garbled boolean, restored string").withColumnRenamed("key", key)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_garbled(load(spark, sf_dir, "documents")).where("is_garbled").select("doc_id")


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_garbled(load(spark, sf_dir, "documents")).where("is_garbled").select("doc_id", "restored")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p8_found": p8_found, "p8_restored": p8_restored}
SQL: dict[str, str] = {}  # the search is not expressible in SQL; tests garble known texts and restore them
