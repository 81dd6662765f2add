import random

import numpy as np
import pytest

from skillmill.llm import garbled as g

LINES = [
    "Der Prüfstand für die Behörde wurde größtenteils überprüft und gemäß Plan geöffnet.", "L'équipe a évalué le réseau câblé à Noël, près de la côte ; où est le théâtre ?",
    "El catálogo de números según la compañía: diseñé, planifiqué y revisé la campaña.", "The “quiet” year – costs fell to €52 k… it’s ours • really.", "Plain English line without any special sign, repeated for weight.",
]
DECOYS = ["Projeto «ESTAÇÃO MAÇÃ», fase II.", "IRMÃ e MÃE: duas lojas, São Tovém.", "Русский язык: свободно; ελληνικά: βασικά.", "Żółta linia, łąka.", "2º plan, 3ª fase, 40 m² (± 5)", "├── src\n└── bin", "√2 ≈ 1.41 × 3", "日本語能力 한국어", "naïve façade © ® ™"]


def counts(texts):
    total, chars = np.zeros(g.CELLS, np.int64), np.zeros(g.ALONE, np.int64)
    c = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
    n = np.bincount(c)
    chars[: n.size] += n
    high = np.flatnonzero(c > 127)
    first = np.union1d(high, high - 1)
    first = first[(first >= 0) & (first + 1 < c.size)]
    g._add(total, c[first], c[first + 1], 1)
    k = g.classes()
    total[2 * g.ROW : 2 * g.ROW + 256] += np.bincount(k[c[first]] * 16 + k[c[first + 1]], minlength=256)
    seen = np.flatnonzero(chars)
    total[-16:] += np.bincount(k[seen], chars[seen], 16).astype(np.int64)
    g._add(total, seen, np.full(seen.size, g.ALONE), chars[seen])
    return total


@pytest.fixture(scope="module")
def model():
    return g.Model(counts(LINES * 200 + DECOYS * 20))


def misread(text, codec):
    raw = text.encode()
    try:
        return raw.decode(codec)
    except UnicodeDecodeError:
        return "".join(bytes([b]).decode(codec) if codec != "cp1252" or b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in raw)


@pytest.mark.parametrize("codec", ["cp1252", "latin_1", "mac_roman", "cp437", "cp850"])
@pytest.mark.parametrize("line", LINES[:4])
def test_misread_lines_come_back(model, line, codec):
    hit, back = model.text(misread(line, codec))
    assert hit and back == line


def test_twice_and_entities(model):
    twice = misread(misread("réseau câblé", "cp1252"), "cp1252")
    assert model.text(twice) == (True, "réseau câblé")
    assert model.text("R&#195;&#169;sum&#195;&#169;") == (True, "Résumé")
    assert model.text("caf\N{REPLACEMENT CHARACTER}")[0]
    assert model.text("grˆﬂtenteils".replace("ˆ", "ˆ"))[0]


@pytest.mark.parametrize("line", LINES + DECOYS + ["", "&amp; &eacute; AT&T;", "x" * 30_000])
def test_good_text_is_left_alone(model, line):
    assert model.text(line) == (False, line)


def test_segments_are_maximal():
    """Ruzzo and Tompa's segments against their definition on short lists."""
    rng = random.Random(3)
    for _ in range(200):
        s = [rng.choice([-2, -1, 1, 2]) for _ in range(rng.randint(0, 9))]
        got = g.segments(s)
        want = []

        def split(lo, hi):
            best = max(((sum(s[a:b]), -(b - a), -a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=None)
            if best is None or best[0] <= 0:
                return
            a, b = -best[2], best[3]
            split(lo, a)
            want.append((a, b))
            split(b, hi)

        split(0, len(s))
        assert sum(sum(s[a:b]) for a, b in got) == sum(sum(s[a:b]) for a, b in want)
        assert all(b <= c for (_, b), (c, _) in zip(got, got[1:]))


def test_frame(spark):
    rows = [(i, t, True) for i, t in enumerate(LINES * 40)] + [(900, misread(LINES[1], "cp1252"), True), (901, None, True), (902, "", True), (900, misread(LINES[1], "cp1252"), True), (None, "caf�", True)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, is_garbled boolean")
    got = g.find_garbled(df)
    assert sorted((str(r.doc_id), r.restored) for r in got.where("is_garbled").collect()) == [("900", LINES[1]), ("900", LINES[1]), ("None", "caf�")]
    rest = {r.doc_id: r.restored for r in got.where("not is_garbled").collect()}
    assert rest[901] is None and rest[902] == "" and rest[0] == LINES[0]
    assert g.find_garbled(df.where("false")).count() == 0


def test_entities_by_name_and_beside_characters(model):
    for text in ("R&Atilde;&copy;seau", "R&Atilde;©seau", "RÃ&copy;seau", "RÃ&#169;seau"):
        assert model.text(text) == (True, "Réseau"), text
    assert model.text("R&Egrave;seau") == model.text("RÈseau")[:1] + ("Réseau" if model.text("RÈseau")[0] else "R&Egrave;seau",)
    assert model.text("RÃ©&nbsp;seau")[0]
    for text in ("caf&eacute; &amp; th&eacute;&acirc;tre", "naïve fa&ccedil;ade", "a &lt;b&gt; AT&T; R&D"):
        assert model.text(text) == (False, text), text


def test_named_entities_in_ascii_documents(spark):
    rows = [(i, LINES[1]) for i in range(200)] + [(900, "r&Atilde;&copy;seau"), (901, "AT&T and R&D")]
    got = {r.doc_id: (r.is_garbled, r.restored) for r in g.find_garbled(spark.createDataFrame(rows, "doc_id bigint, text string")).where("doc_id >= 900").collect()}
    assert got == {900: (True, "réseau"), 901: (False, "AT&T and R&D")}
