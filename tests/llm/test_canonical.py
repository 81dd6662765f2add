import random

import pytest

from skillmill.llm import canonical as ca

REF = [(1, "daprorsitrn", []), (2, "livestock scheduling", ["lsk3"]), (3, "stetmeallt.lab", ["setmx"]), (4, "grijen flow", None), (5, "niklijuv++", []), (6, "ledger forecasting", []), (7, "tunnel brokerage", ["haekilulnd kit"]), (8, "bakery draughting", [])]


IDLE = frozenset("certified in of good skills".split())


class Plain:
    """The answer for one entry, with repairs found by comparing all words."""

    def __init__(self, rows):
        self.ref = ca.Reference(rows, IDLE)

    def name(self, entry):
        parts = self.ref._split(entry)
        tokens, cuts = [t for t, _ in parts], [c for _, c in parts]
        near = lambda probe: [(w, d) for w in self.ref.repairable() if (d := ca.osa(probe, w, ca.allowed(len(w)))) <= ca.allowed(len(w))]
        return self.ref.name(tokens, cuts, {p: near(p) for p in self.ref.probes(tokens, cuts)})


@pytest.fixture(scope="module")
def ref():
    return Plain(REF)


@pytest.mark.parametrize(
    "entry, want",
    [
        ("Daprorsitrn", 1), ("daprosritrn", 1), ("  daprorsitrn;", 1), ("daprorsitrn v22", 1), ("daprorsitrn-19.x", 1), ("certified in daprorsitrn", 1), ("scheduling, livestock", 2), ("LivestockScheduling", 2),
        ("livestock_scheduling", 2), ("livestock sched.", 2), ("livestockosccheduling", 2), ("lsk3", 2), ("lsk4", -1), ("Stetmealt.Lab 23", 3), ("flow of grijen", 4), ("nikljiuv++", 5), ("forecasting ledger", 6),
        ("ledger scheduling", -1), ("tunnel forecasting", -1), ("keapebron desk", -1), ("griafex grade II", -1), ("driving licence B", -1), ("none", -1), ("-", -1), ("HAEKILULND KIT", 7), ("good skills", -1),
        ("baker ydraughtng", 8), ("ｄａｐｒｏｒｓｉｔｒｎ", 1), ("daprorsitrn " * 2000, -1),
    ],
)
def test_entries(ref, entry, want):
    if len(entry) > 1000:
        assert ref.name(entry) in (1, -1)
    else:
        assert ref.name(entry) == want


def test_near_words_against_all(spark):
    """The join on left-out characters finds what comparing all words finds."""
    rng = random.Random(1)
    words, probes = misspelt(rng, 3, 9)
    got = ca.near_words(spark.createDataFrame([(p,) for p in probes], "probe string"), spark.createDataFrame([(w,) for w in words], "word string"), 9)
    want = sorted((p, w, d) for p in probes for w in words if (d := ca.osa(p, w, 9)) <= ca.allowed(len(w)))
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 100


def test_names_written_together_against_all():
    rng = random.Random(2)
    words, probes = misspelt(rng, 8, 22)
    together = ca.Together(words)
    found = 0
    for p in probes:
        want = sorted((w, d) for w in words if (d := ca.osa(p, w, 9)) <= ca.allowed_together(len(w)))
        assert together.find(p) == want
        found += len(want)
    assert found > 100


def misspelt(rng, lo, hi):
    words = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(lo, hi))) for _ in range(100)})
    probes = set()
    for _ in range(300):
        w = list(rng.choice(words))
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(w) + 1)
            op = rng.random()
            if op < 0.3 and len(w) > 1:
                del w[k - 1]
            elif op < 0.6:
                w.insert(k, rng.choice("abcde"))
            elif k < len(w) - 1:
                w[k], w[k + 1] = w[k + 1], w[k]
        probes.add("".join(w))
    return words, sorted(probes)


def test_idle_words_are_learned(spark, ref, monkeypatch):
    """A word beside many names weighs nothing, one beside few makes another name; rows are answered by broadcast and by shuffle."""
    from skillmill import session

    reference = spark.createDataFrame(REF, "canonical_id bigint, canonical string, known_aliases array<string>")
    names = [n for _, n, _ in REF]
    texts = [f"certified in {n}" for n in names] + [f"{n} suite" for n in (names[0], names[2])] + ["certified in daprosritrn", "nothing"] + ["scheduling, livestock"] * 40
    rows = [("s", i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "src string, row_id bigint, entry string")
    want = [i for i, _, _ in REF] + [-1, -1] + [1, -1] + [2] * 40
    for most in (200_000, 5):
        monkeypatch.setattr(session, "SENT_ROWS", most)
        got = {r.row_id: r.canonical_id for r in ca.map_entries(df, reference, ["src", "row_id"]).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_osa():
    assert ca.osa("ca", "abc", 5) == 3 and ca.osa("ab", "ba", 2) == 1 and ca.osa("", "abc", 2) == 3 and ca.osa("abc", "abc", 0) == 0


def test_typed_names_are_found(ref):
    rng = random.Random(8)
    names = {n: i for i, n, _ in REF if len(n) > 9}
    hit = total = 0
    for _ in range(300):
        n = rng.choice(list(names))
        w = list(n)
        k = rng.randrange(1, len(w) - 1)
        if rng.random() < 0.5:
            w[k], w[k + 1] = w[k + 1], w[k]
        else:
            w.insert(k, w[k])
        total += 1
        hit += ref.name("".join(w)) == names[n]
    assert hit / total > 0.97


def test_frame(spark):
    reference = spark.createDataFrame([(i, n, a) for i, n, a in REF] + [(9, None, None)], "canonical_id bigint, canonical string, known_aliases array<string>")
    rows = [("s", 1, "Daprorsitrn", 5), ("s", 1, "Daprorsitrn", 5), ("s", None, "x", 5), ("s", 2, None, 5), ("s", 3, " ", 5)]
    df = spark.createDataFrame(rows, "src string, row_id bigint, entry string, canonical_id int")
    got = sorted((str(r.row_id), str(r.entry), r.canonical_id) for r in ca.map_entries(df, reference, ["src", "row_id"]).collect() if r.canonical_id is not None)
    assert got == [("1", "Daprorsitrn", 1), ("1", "Daprorsitrn", 1), ("None", "x", -1)]
    assert ca.map_entries(df, reference.where("false"), ["src", "row_id"]).where("canonical_id = -1").count() == 3
    assert ca.map_entries(df.where("false"), reference, ["src", "row_id"]).count() == 0
