import zipfile
import zlib

import pytest

from skillmill.config import Settings
from skillmill.plans import pipeline
from skillmill.sources import model_client as mc
from skillmill.sources import pdf, tables
from skillmill.sources.excel import rows_of


def make_pdf(*pages: list[str], deflate: bool = False) -> bytes:
    out, n = [b"%PDF-1.4\n"], 3
    for lines in pages:
        body = b"BT /F1 12 Tf 72 720 Td " + b" 0 -14 Td ".join(b"(" + x.encode("cp1252").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj" for x in lines) + b" ET"
        data = zlib.compress(body) if deflate else body
        out.append(b"%d 0 obj << /Type /Page /Contents %d 0 R >> endobj\n" % (n, n + 1))
        out.append(b"%d 0 obj << /Length %d %s>>\nstream\n" % (n + 1, len(data), b"/Filter /FlateDecode " if deflate else b"") + data + b"\nendstream endobj\n")
        n += 2
    return b"".join([*out, b"%%EOF"])


@pytest.mark.parametrize("deflate", [False, True])
def test_pdf(spark, deflate):
    rows = [("a.pdf", make_pdf(["Ada (B)", "Skills: Python, SQL"], ["page two"], deflate=deflate)), ("b.pdf", b""), ("c.pdf", b"garbage"), ("d.pdf", make_pdf([])), ("e.pdf", None)]
    got = {r.path: r for r in pdf.read_pdfs(spark.createDataFrame([(p, bytearray(c) if c is not None else None) for p, c in rows], "path string, content binary")).collect()}
    assert got["a.pdf"].text == "Ada (B)\nSkills: Python, SQL\npage two" and got["a.pdf"].num_pages == 2 and got["a.pdf"].status == "success" and got["a.pdf"].error is None
    assert [(got[p].text, got[p].status) for p in ("b.pdf", "c.pdf", "d.pdf", "e.pdf")] == [("", "error")] * 4
    assert got["c.pdf"].error == pdf.CORRUPTED and got["c.pdf"].num_pages == 0 and got["d.pdf"].error == pdf.NO_TEXT


def test_longest_strategy_counts():
    assert pdf.extract_record(b"x", lambda c: [["ab", "cd", "abc"], ["", ""], ["xy", "zz"]]) == ("abc\nxy", 3, "success", None)

    def broken(c):
        raise RuntimeError("boom")

    assert pdf.extract_record(b"x", broken)[2:] == ("error", "RuntimeError: boom")


def test_folder_prefers_html(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/b.html").write_text("<p>Beta</p>")
    (tmp_path / "in/a.htm").write_text("<p>Alpha</p>")
    (tmp_path / "x.pdf").write_bytes(make_pdf(["Gamma"]))
    got = tables.folder_corpus(spark, str(tmp_path))
    assert sorted(r.text for r in got.collect()) == ["alpha", "beta"]
    assert [r.text for r in tables.folder_corpus(spark, str(tmp_path), html_max=1).collect()] == ["beta"]
    (tmp_path / "in/b.html").unlink()
    (tmp_path / "in/a.htm").unlink()
    assert [(r.source, r.text) for r in tables.folder_corpus(spark, str(tmp_path)).collect()] == [("pdf", "gamma")]
    assert tables.folder_corpus(spark, str(tmp_path / "none")).count() == 0


def xlsx(path, rows):
    with zipfile.ZipFile(path, "w") as z:
        ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
        cells = "".join("<row>" + "".join(f'<c r="{chr(65 + j)}{i + 1}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(r) if v is not None) + "</row>" for i, r in enumerate(rows))
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData>{cells}</sheetData></worksheet>')


def test_tables(spark, tmp_path):
    xlsx(tmp_path / "t.xlsx", [["ID", "Resume_str"], ["1", "Some Text"], ["2", None]])
    assert rows_of((tmp_path / "t.xlsx").read_bytes())[1] == ["1", "Some Text"]
    assert [r.text for r in tables.resume_corpus(tables.read_table(spark, str(tmp_path / "t.xlsx")), "ID").collect()] == ["some text"]
    (tmp_path / "j.csv").write_text('id,Job Title,Job Description\n1,x,"Lead, ""big""\nteam"\n2,y,\n')
    assert [r.text for r in tables.job_corpus(tables.read_table(spark, str(tmp_path / "j.csv"))).collect()] == ["lead big team"]
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.parquet")
    wide = spark.createDataFrame([("a", None), (None, "<p>B &amp; c</p>"), (None, None)], "Resume_str string, Resume_html string")
    assert sorted(r.text for r in tables.resume_corpus(wide).collect()) == ["a", "b c"]
    assert [r.text for r in tables.job_corpus(spark.createDataFrame([("x", "Last")], "a string, b string")).collect()] == ["last"]


def test_corpus_of_a_folder(spark, tmp_path):
    (tmp_path / "Resume").mkdir()
    (tmp_path / "Resume/Resume.csv").write_text("ID,Resume_str\n1,Alpha\n")
    (tmp_path / "job_title_des.csv").write_text("x,Job Description\n1,Beta\n")
    assert sorted((r.source, r.text) for r in tables.corpus_of(spark, str(tmp_path)).collect()) == [("job", "beta"), ("resume", "alpha")]


def test_dictionary_json(spark, tmp_path):
    e = spark.createDataFrame([("été", ["été", "e"], 0), ("a", ["a"], 1)], "canonical string, aliases array<string>, pos bigint")
    tables.write_dictionary(e, str(tmp_path / "d"))
    back = {r.canonical: r.aliases for r in tables.read_dictionary(spark, str(tmp_path / "d")).collect()}
    assert back == {"été": ["été", "e"], "a": ["a"]}
    tables.write_dictionary(e, str(tmp_path / "x"), ascii_only=True)
    raw = "".join(p.read_text() for p in (tmp_path / "x").glob("part*"))
    assert raw.isascii() and "\\u00e9" in raw
    assert tables.read_dictionary(spark, str(tmp_path / "missing")).count() == 0


def test_model_client():
    calls, waits = [], []
    body = '{"candidates":[{"content":{"parts":[{"text":"yes"}]}}]}'
    script = [mc.Response(500, "x"), mc.Response(429, "y", "7"), mc.Response(429, "y", None), OSError("lost"), mc.Response(200, "{}"), mc.Response(200, body)]

    def transport(payload):
        calls.append(payload)
        r = script[len(calls) - 1]
        if isinstance(r, Exception):
            raise r
        return r

    assert mc.ask("p", transport, tries=8, sleep=waits.append) == "yes"
    assert waits == [1.0, 7.0, 30.0, 8.0, 8.0]
    with pytest.raises(mc.ModelError):
        mc.ask(" ", transport)
    with pytest.raises(mc.ModelError, match="HTTP 401"):
        mc.ask("p", lambda p: mc.Response(401, "denied"), tries=2, sleep=waits.append)
    assert mc.wait_before(3, 3, None) == 0 and mc.wait_before(1, 5, mc.Response(429, "", "500")) == 120 and mc.wait_before(9, 20, mc.Response(429, "")) == 90


def test_asking_each_prompt_once(spark):
    def transport():
        return lambda payload: mc.Response(200, '{"candidates":[{"content":{"parts":[{"text":"{\\"skills\\":[\\"SQL\\"]}"}]}}]}')

    prompts = spark.createDataFrame([(1, "a"), (2, "a"), (3, ""), (4, None)], "doc_id int, prompt string")
    got = {r.doc_id: (r.raw, r.error) for r in mc.ask_all(prompts, transport, settings=Settings(llm_max_retries=1)).collect()}
    assert got == {1: ('{"skills":["SQL"]}', None), 2: ('{"skills":["SQL"]}', None), 3: (None, "empty prompt"), 4: (None, "empty prompt")}


def test_pipeline(spark):
    docs = spark.createDataFrame([(1, "Expert Python and SQL. mysql"), (2, "go"), (3, None)], "doc_id bigint, text string")
    e = spark.createDataFrame([("python", ["python", "py"], 0), ("mysql", ["mysql"], 1), ("sql", ["sql", "mysql"], 2)], "canonical string, aliases array<string>, pos bigint")
    model = spark.createDataFrame([(2, "Go"), (2, "team")], "doc_id bigint, item string")
    got = {r.doc_id: r for r in pipeline.analyse(pipeline.Inputs(docs, e, model_skills=model)).collect()}
    assert got[1].keyword_skills == ["mysql", "python", "sql"] and got[1].final_skills == ["python", "sql"]
    assert [(s.name, s.level) for s in got[1].final_structured] == [("python", 3), ("sql", 3)]
    assert got[2].final_skills == ["go"] and [(s.name, s.level) for s in got[2].final_structured] == [("go", 1)]
    assert got[3].final_skills == [] and got[3].final_structured == []
    gap = pipeline.compare(spark.createDataFrame([(1, 1, 2), (2, 9, 1)], "pair_id int, resume_id bigint, job_id bigint"), pipeline.analyse(pipeline.Inputs(docs, e, model_skills=model)))
    assert {r.pair_id: r.missing_skills for r in gap.collect()} == {1: ["go"], 2: ["python", "sql"]}
    none = pipeline.analyse(pipeline.Inputs(docs, e.where("false")), Settings(enable_embeddings=False)).collect()
    assert all(r.final_skills == [] for r in none) and pipeline.health() == {"status": "ok"}
    assert '"final_skills":["go"]' in next(r.json for r in pipeline.as_json(pipeline.analyse(pipeline.Inputs(docs, e, model_skills=model))).collect() if r.doc_id == 2)


def test_build_dictionary(spark):
    docs = spark.createDataFrame([(i, "data pipeline with docker") for i in range(6)], "doc_id bigint, text string")
    got = {r.canonical for r in pipeline.build_dictionary(docs).collect()}
    assert {"data", "data pipeline", "docker", "python", "machine learning", "sql"} <= got


def test_streams(spark, tmp_path):
    from skillmill.streaming import landing

    e = spark.createDataFrame([("python", ["python"], 0)], "canonical string, aliases array<string>, pos bigint")
    (tmp_path / "land").mkdir()
    (tmp_path / "land/a.pdf").write_bytes(make_pdf(["Python"]))
    (tmp_path / "land/b.txt").write_text("python")
    seen = []
    q = landing.analyse_stream(landing.pdf_stream(spark, str(tmp_path / "land")), e, lambda df, n: seen.extend(r.final_skills for r in df.collect()), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert seen == [["python"]]
    spark.createDataFrame([(1, "python")], "doc_id bigint, text string").write.parquet(str(tmp_path / "texts"))
    q = landing.analyse_stream(landing.text_stream(spark, str(tmp_path / "texts")), e, lambda df, n: seen.extend(r.final_skills for r in df.collect()), str(tmp_path / "ck2"))
    q.awaitTermination(60)
    assert seen == [["python"]] * 2


def test_uploads(spark):
    rows = [("a.pdf", bytearray(make_pdf(["Hi"]))), ("b.txt", bytearray(b"x")), ("c.PDF", bytearray(b"")), ("d.pdf", None), ("e.pdf", bytearray(b"junk"))]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = {r.path: (r.text, r.problem) for r in pdf.read_uploads(df).collect()}
    assert got == {"a.pdf": ("Hi", None), "b.txt": ("", "not a PDF"), "c.PDF": ("", "empty file"), "d.pdf": ("", "empty file"), "e.pdf": ("", None)}
    with pytest.raises(Exception, match="not a PDF|empty file"):
        pdf.read_uploads(df, strict=True).collect()
    assert pdf.read_uploads(df.where("path = 'a.pdf'"), strict=True).first().text == "Hi"


def test_stages(spark, tmp_path):
    from skillmill.plans import stages

    (tmp_path / "raw/Resume").mkdir(parents=True)
    (tmp_path / "raw/Resume/Resume.csv").write_text("ID,Resume_str\n" + "".join(f"{i},docker pipeline worked\n" for i in range(6)))
    mined = stages.mine(spark, str(tmp_path / "raw"), str(tmp_path / "one"))
    assert {"docker", "docker pipeline", "python"} <= {r.canonical for r in mined.collect()}
    original, removed, final = stages.clean(spark, str(tmp_path / "one"), str(tmp_path / "two"))
    assert original == mined.count() and final == original - removed
    assert stages.filter_skills(spark, str(tmp_path / "two"), str(tmp_path / "three"))[0] == final
    total, top, picked = stages.inspect(spark, str(tmp_path / "three"), top=2, random=2)
    assert total >= 4 and top.count() == 2 == picked.count()


def test_stream_keeps_documents_without_text(spark, tmp_path):
    from skillmill.streaming import landing

    e = spark.createDataFrame([("python", ["python"], 0)], "canonical string, aliases array<string>, pos bigint")
    docs = spark.createDataFrame([(1, "python"), (2, None), (3, "")], "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "texts"))
    seen = []
    q = landing.analyse_stream(landing.text_stream(spark, str(tmp_path / "texts")), e, lambda df, n: seen.extend(df.collect()), str(tmp_path / "ck"))
    q.awaitTermination(60)
    by_id = lambda rows: sorted(rows, key=lambda r: r.doc_id)
    assert by_id(seen) == by_id(pipeline.analyse(pipeline.Inputs(docs, e)).collect()) and [r.doc_id for r in by_id(seen)] == [1, 2, 3]


def test_vector_hits_of_sentences(spark):
    from skillmill.operators.similarity import HashedEncoder

    docs = spark.createDataFrame([(1, "Machine lerning. Something else\nmachine learning"), (2, "machine lerning"), (3, None), (4, "Machine lerning. sql")], "doc_id bigint, text string")
    e = spark.createDataFrame([("machine learning", ["ml"], 0), ("sql", ["sql"], 1)], "canonical string, aliases array<string>, pos bigint")
    hits = pipeline.vector_hits(docs, e, HashedEncoder)
    got = {(r.doc_id, r.canonical): r.similarity for r in hits.collect()}
    assert set(got) == {(1, "machine learning"), (2, "machine learning"), (4, "machine learning"), (4, "sql")} and got[1, "machine learning"] > 0.999 > got[2, "machine learning"]
    assert {r.doc_id: r.embedding_skills for r in pipeline.analyse(pipeline.Inputs(docs, e, hits)).collect()} == {1: ["machine learning"], 2: ["machine learning"], 3: [], 4: ["machine learning", "sql"]}


def test_pdf_with_object_streams_and_code_maps():
    import zlib

    from skillmill.sources.pdf import simple_extractor

    cmap = b"begincmap 2 beginbfchar <0003> <0020> <0011> <00660069> endbfchar 1 beginbfrange <0024> <0026> <0041> <0030> <0031> [<0078> <0079>] endbfrange endcmap"
    page = b"BT /F1 12 Tf [<0024000300250011>-20<0030>] TJ 0 -14 Td <00310026> Tj ET"
    packed = b"<</Type /Page /Contents 9 0 R /Resources 5 0 R>> <</Font <</F1 6 0 R>>>> <</Type /Font /ToUnicode 8 0 R>>"
    places = [0, packed.index(b"<</Font "), packed.index(b"<</Type /Font")]
    head = " ".join(f"{n} {p}" for n, p in zip((4, 5, 6), places)).encode() + b" "
    stream = lambda extra, data: b"<<" + extra + b"/Filter /FlateDecode>> stream\n" + zlib.compress(data) + b"\nendstream"
    objects = {3: stream(b"/Type /ObjStm /N 3 /First %d " % len(head), head + packed), 8: stream(b"", cmap), 9: stream(b"", page)}
    content = b"%PDF-1.5\n" + b"".join(b"%d 0 obj " % n + o + b" endobj\n" for n, o in objects.items())
    assert simple_extractor(content) == [["A Bfix\nyC"]]
    assert simple_extractor(b"%PDF-1.5\n1 0 obj <</Type /ObjStm /First x>> endobj 2 0 obj <</Type /Page /Contents 7 0 R>> endobj") == [[""]]


def test_binary_workbooks_are_refused(spark):
    import pytest

    from skillmill.sources.tables import read_table

    with pytest.raises(ValueError, match="binary workbook"):
        read_table(spark, "/tmp/x.xls")
