import pytest

from skillmill.llm import pii

GIVEN = ["Rosara", "Rosella", "Roska", "Halara", "Halella", "Halka", "Torric", "Torella", "Savka", "Savara"]
FAMILY = ["Iverholt", "Iverstrand", "Kestholt", "Kestwell", "Stavholt", "Stavstrand", "Stavwell", "Rookholt", "Rookwell", "Rookstrand", "Kestström", "Iverström", "Stavström"]
HINTS = [("given", g) for g in GIVEN] + [("family", f) for f in FAMILY]


@pytest.fixture(scope="module")
def find():
    d = pii.Detector(HINTS)
    return lambda t: [(k, t[a:b]) for a, b, k in d.find(t)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("CV | Rosara Iverholt\nE-mail rosara.iverholt@example.com", [("NAME", "Rosara Iverholt"), ("EMAIL", "rosara.iverholt@example.com")]),
        ("Name: Iverholt, Rosara\n<x@mx.dunholt.example>", [("NAME", "Iverholt, Rosara"), ("EMAIL", "x@mx.dunholt.example")]),
        ("torella kestwell\nSummary", [("NAME", "torella kestwell")]),
        ("IVERHOLT Savka - loom technician", [("NAME", "IVERHOLT Savka")]),
        ("Dr. T. van Kestholt\nx", [("NAME", "T. van Kestholt")]),
        ("x.\nTook over the rota from Mme Stavholt at short notice.", [("NAME", "Stavholt")]),
        ("x.\nRebuilt it together with Torka Rookwell and Savella Kestström.", [("NAME", "Torka Rookwell"), ("NAME", "Savella Kestström")]),
        ("x.\nReported to Søvi Peñarro, head of the rota.", [("NAME", "Søvi Peñarro")]),
        ("x.\nSigned: R. Stavish-Kestholt", [("NAME", "R. Stavish-Kestholt")]),
        ("x.\nReferee: Ms Halka Rookholt, Wiklum SARL, +44 20 7946 0450", [("NAME", "Halka Rookholt"), ("PHONE", "+44 20 7946 0450")]),
        ("mail me: tavo_x [at] kilnmail [dot] test or a.b at mx dot dunholt dot example.", [("EMAIL", "tavo_x [at] kilnmail [dot] test"), ("EMAIL", "a.b at mx dot dunholt dot example")]),
        ("ph. (752) 555-0183 ext. 19, 06.39.98.55.17, 030/23125630", [("PHONE", "(752) 555-0183"), ("PHONE", "06.39.98.55.17"), ("PHONE", "030/23125630")]),
        ("call nine one one five five five zero one two three now", [("PHONE", "nine one one five five five zero one two three")]),
        ("SSN: 995-93-4152, N° SS : 1 82 13 99 152 188 08; NI No: QQ 63 61 70 B", [("ID", "995-93-4152"), ("ID", "1 82 13 99 152 188 08"), ("ID", "QQ 63 61 70 B")]),
        ("Passport No. X0264978 DNI 00383924-Z Driving licence DROS994645ZZ9", [("ID", "X0264978"), ("ID", "00383924-Z"), ("ID", "DROS994645ZZ9")]),
        ("Flat 12, 343 Boumirnd Lane, Quiahuwick", [("STREET", "343 Boumirnd Lane")]),
        ("Address: 244 N. Zoretss Ave. - Bromtowick", [("STREET", "244 N. Zoretss Ave.")]),
        ("248 bis, avenue de Gulcixx, 30043 X | Gresvexweg 36a, Y | Calle de Caset 210, Z", [("STREET", "248 bis, avenue de Gulcixx"), ("STREET", "Gresvexweg 36a"), ("STREET", "Calle de Caset 210")]),
    ],
)
def test_found(find, text, want):
    assert find(text) == want


@pytest.mark.parametrize(
    "text",
    [
        "Order no. 2128-7614-3142 closed after 48 hours.", "Certificate no. 2041-4238 (forklift) renewed.", "Moved 2 410 170 records, 5839-5967, without a loss.", "Score 3.7/8.5, course ref. QX-5439-80, rank 14 of 221.",
        "Handled invoice 26-22882 and ticket 5445-8619 in one afternoon.", "Kept release 5.44.1 and the 10.2-style labels apart.", "Supplier to Kestholt & Sons and the Stavstrand Group.", "Took the Rookholt account over from the Iverström Museum.",
        "Worked for Rookwell Avenue Media on the 5 Roads campaign.", "Ran 6 Drive Safely workshops in Building 8, Room 538.", "Oak Street Partners was the main client.", "Posted as @kilnhouse in the staff forum.",
        "Wrote the page about contact@ addresses for the help centre.", "Candidate file pirdrudos / kiln operator\nSummary", "Tram Fitter, Skox SARL, Bromtowick (04/2020 – 2022)", "", "   \n", "x" * 50_000, "1 " * 20_000,
    ],
)
def test_left_alone(find, text):
    assert find("Intro line.\n" + text) == []


def test_offsets_through_disguise(find):
    """Values are exact in the source though found in the normal form."""
    text = "ph. +44\xa020\xa07946\xa00603\nE-mail ｔａｖｏ@ｅｘａｍｐｌｅ.com\nReported to Rоs​ara Iverholt, head of it.\nt.x (at) mail.test"
    assert find("x.\n" + text) == [("PHONE", "+44\xa020\xa07946\xa00603"), ("EMAIL", "ｔａｖｏ@ｅｘａｍｐｌｅ.com"), ("NAME", "Rоs​ara Iverholt"), ("EMAIL", "t.x (at) mail.test")]


def test_normal_form_maps_back():
    for s in ("ﬁle é x", "a​b\xa0c", "plain", "x [at] y [dot] z", "été [at] y dot com​"):
        n = pii.Normal(s)
        whole = n.span(0, len(n.text))
        assert 0 <= whole[0] < whole[1] <= len(s)
        if n.starts is not None:
            assert len(n.starts) == len(n.ends) == len(n.text) == len(n.low)
            assert all(a < b for a, b in zip(n.starts, n.ends)) and n.starts == sorted(n.starts)


def test_frames(spark):
    hints = spark.createDataFrame(HINTS + [("given", None), (None, "x")], "part_kind string, name_part string")
    rows = [("r", 1, "CV | Rosara Iverholt\na@b.example a@b.example"), ("r", 2, None), ("r", 3, ""), ("r", 1, "CV | Rosara Iverholt\na@b.example a@b.example"), ("r", None, "nothing")]
    df = spark.createDataFrame([(*r, "k", "v") for r in rows], "src string, row_id bigint, t string, kind string, value string")
    got = sorted(tuple(r) for r in pii.find_personal(df, hints, ["src", "row_id"], "t").collect())
    assert got == [("r", 1, "EMAIL", "a@b.example")] * 2 + [("r", 1, "NAME", "Rosara Iverholt")] * 2
    red = {(r.row_id): r.redacted for r in pii.redact_personal(df, hints, ["src", "row_id"], "t").collect()}
    assert red == {1: "CV | [NAME]\n[EMAIL] [EMAIL]", 2: None, 3: "", None: "nothing"}
    assert pii.find_personal(df.where("false"), hints, ["row_id"], "t").count() == 0
    assert pii.find_personal(df, hints.where("false"), ["row_id"], "t").where("kind = 'EMAIL'").count() == 2


@pytest.mark.parametrize(
    "text, want",
    [
        ("ring zero-two-oh-seven-nine-four-six-zero-nine-five-eight", [("PHONE", "zero-two-oh-seven-nine-four-six-zero-nine-five-eight")]),
        ("ring oh seven seven double zero nine four six zero nine five now", [("PHONE", "oh seven seven double zero nine four six zero nine five")]),
        ("ring 020 seven nine four six 0958.", [("PHONE", "020 seven nine four six 0958")]),
        ("to jane DOT doe AT example DOT com.", [("EMAIL", "jane DOT doe AT example DOT com")]),
        ("jane.doe arroba ejemplo punto es", [("EMAIL", "jane.doe arroba ejemplo punto es")]),
        ("jana (punkt) doe [at] beispiel punkt de", [("EMAIL", "jana (punkt) doe [at] beispiel punkt de")]),
        ("jeanne arobase exemple point fr", [("EMAIL", "jeanne arobase exemple point fr")]),
        ("a" * 700 + ".b@firm.com", [("EMAIL", "a" * 700 + ".b@firm.com")]),
        ("account GB82 WEST 1234 5698 7654 32 of the firm", []),
        ("SSN:" + " " * 90 + "995-93-4152", [("ID", "995-93-4152")]),
        ("one of two sites, three shifts, four lines and five, six or seven of us at point three", []),
        ("The one. Two three, at the dot of noon", []),
    ],
)
def test_disguises(find, text, want):
    assert find("x.\n" + text) == want


def test_a_verb_behind_a_titled_name(find):
    assert find("Mr Tanaka called\nx") == [("NAME", "Tanaka")]


def test_long_runs_of_numbers_are_read_in_time(find):
    import time

    began = time.perf_counter()
    find("one two three " + "1 " * 60_000)
    find("SSN " + "12 34 " * 20_000)
    assert time.perf_counter() - began < 20


def test_many_spans_in_one_text(find):
    text = " ".join(f"u{i}@firm.com" for i in range(20_000))
    assert len(find(text)) == 20_000


@pytest.mark.parametrize("sign", ["[@]", " (@) ", " { at } ", "< at >", " (  at ) ", "(\tAT)", " [ @ ] "])
def test_disguise_without_the_word_dot(find, sign):
    assert find(f"x.\nMail: jane{sign}firm.com now.") == [("EMAIL", f"jane{sign}firm.com")]
