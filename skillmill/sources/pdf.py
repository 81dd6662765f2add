"""Text of PDF files. The extractor is a parameter; the one here reads simple files with the standard library only."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_layout_text, clean_page_text, is_pdf_name

#: content -> text candidates of each page, by strategy; raises ValueError for what is no PDF.
Extractor = Callable[[bytes], list[list[str]]]

RECORD = "text string, num_pages int, status string, error string"
NO_TEXT = "No extractable text found"
CORRUPTED = "Corrupted PDF file"

#: A stream that inflates to more is cut there: a page's text is far smaller, a crafted file is not.
MOST_INFLATED = 256_000_000

_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}
_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_SHOWN = re.compile(rb"/(?P<font>[\w.+-]+)\s+-?[\d.]+\s+Tf|\((?:\\.|[^\\()])*\)\s*(?:Tj|'|\")|\[(?:\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|[^\]()<])*\]\s*TJ|<[0-9A-Fa-f\s]*>\s*Tj|T\*|(?:-?[\d.]+\s+){2}T[dD]|(?:-?[\d.]+\s+){6}Tm|\bET\b", re.S)
_LITERAL = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>", re.S)


def _string_bytes(raw: bytes) -> bytes:
    if raw[:1] == b"<":
        h = re.sub(rb"\s", b"", raw[1:-1])
        return bytes.fromhex((h + b"0" * (len(h) % 2)).decode())
    s = raw[1:-1].decode("latin-1")
    s = re.sub(r"\\([0-7]{1,3})", lambda m: chr(int(m.group(1), 8) & 255), s)
    s = re.sub(r"\\(\r\n|[\s\S])", lambda m: _ESCAPES.get(m.group(1), "" if m.group(1)[0] in "\r\n" else m.group(1)), s)
    return s.encode("latin-1", "replace")


def _string(raw: bytes) -> str:
    data = _string_bytes(raw)
    return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("cp1252", "replace")


def _inflated(body: bytes) -> bytes:
    """The stream of an object, inflated where it is deflated, up to MOST_INFLATED bytes; other filters give nothing."""
    m = _STREAM.search(body)
    if not m:
        return b""
    if b"FlateDecode" in body[: m.start()]:
        try:
            return zlib.decompressobj().decompress(m.group(1), MOST_INFLATED)
        except zlib.error:
            return b""
    return b"" if b"/Filter" in body[: m.start()] else m.group(1)


def _objects(content: bytes) -> dict[int, bytes]:
    """The objects of a file by number, those packed into object streams too. Of equal numbers the last written holds."""
    out = {int(m.group(1)): m.group(2) for m in _OBJECT.finditer(content)}
    for body in list(out.values()):
        if not re.search(rb"/Type\s*/ObjStm\b", body):
            continue
        first, data = re.search(rb"/First\s+(\d+)", body), _inflated(body)
        if not first or not data:
            continue
        heads = [int(x) for x in re.findall(rb"\d+", data[: int(first.group(1))])]
        numbers, places = heads[::2], [int(first.group(1)) + x for x in heads[1::2]]
        for number, lo, hi in zip(numbers, places, [*places[1:], len(data)]):
            out.setdefault(number, data[lo:hi])
    return out


def _code_map(stream: bytes) -> dict[int, str]:
    """code -> text of a font's ToUnicode map."""
    text = lambda h: bytes.fromhex(re.sub(rb"\s", b"", h).decode()).decode("utf-16-be", "replace")
    out: dict[int, str] = {}
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", stream, re.S):
        for code, to in re.findall(rb"<([0-9A-Fa-f\s]+)>\s*<([0-9A-Fa-f\s]+)>", part):
            out[int(code, 16)] = text(to)
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", stream, re.S):
        for lo, hi, to, each in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f\s]+)>|\[(.*?)\])", part, re.S):
            lo, hi = int(lo, 16), min(int(hi, 16), int(lo, 16) + 0xFFFF)
            listed = [text(x) for x in re.findall(rb"<([0-9A-Fa-f\s]+)>", each)]
            start = text(to) if to else ""
            for k in range(lo, hi + 1):
                out[k] = listed[k - lo] if k - lo < len(listed) else start[:-1] + chr(min(ord(start[-1]) + k - lo, 0x10FFFF)) if start else ""
    return out


def _fonts(page: bytes, objects: dict[int, bytes]) -> dict[bytes, dict[int, str]]:
    """Name of each font in reach of a page -> its map of codes, where it has one."""
    reach = [page]
    for key in (rb"/Resources\s+(\d+)\s+\d+\s+R", rb"/Font\s+(\d+)\s+\d+\s+R"):
        reach += [objects.get(int(n), b"") for part in list(reach) for n in re.findall(key, part)]
    out = {}
    for part in reach:
        for name, n in re.findall(rb"/([\w.+-]+)\s+(\d+)\s+\d+\s+R", part):
            if m := re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", objects.get(int(n), b"")):
                out[name] = _code_map(_inflated(objects.get(int(m.group(1)), b"")))
    return out


def _coded(raw: bytes, codes: dict[int, str]) -> str:
    """Text of a string's codes: of two bytes where the map has any such code, else of one."""
    data = _string_bytes(raw)
    size = 2 if max(codes, default=0) > 0xFF or len(data) % 2 == 0 and all(b == 0 for b in data[::2]) else 1
    return "".join(codes.get(int.from_bytes(data[i : i + size], "big"), "") for i in range(0, len(data), size))


def _page_text(stream: bytes, fonts: dict[bytes, dict[int, str]]) -> str:
    out: list[str] = []
    codes: dict[int, str] | None = None
    for m in _SHOWN.finditer(stream):
        op = m.group()
        if m.group("font") is not None:
            codes = fonts.get(m.group("font"))
        elif op[:1] in b"([<":
            out.append("".join(_coded(x.group(), codes) if codes else _string(x.group()) for x in _LITERAL.finditer(op)))
        elif out and not out[-1].endswith("\n"):
            out.append("\n")
    return "".join(out).strip("\n")


def simple_extractor(content: bytes) -> list[list[str]]:
    """Pages in order of their objects, with plain or deflated streams, object streams, maps of codes to text, and the Tj, TJ, ' and "
    operators. No layout analysis, no encryption."""
    if not content.lstrip()[:5].startswith(b"%PDF"):
        raise ValueError(CORRUPTED)
    objects = _objects(content)
    pages = []
    for body in objects.values():
        if not re.search(rb"/Type\s*/Page\b(?!s)", body):
            continue
        refs = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        fonts = _fonts(body, objects)
        streams = [_inflated(objects.get(int(n), b"")) for n in re.findall(rb"(\d+)\s+\d+\s+R", refs.group(1) if refs else b"")]
        pages.append(["\n".join(_page_text(x, fonts) for x in streams)])
    return pages


def extract_record(content: bytes | None, extractor: Extractor) -> tuple[str, int, str, str | None]:
    """(text, num_pages, status, error). Of each page the longest candidate counts, the first on ties; empty pages are skipped."""
    try:
        pages = extractor(bytes(content or b""))
    except ValueError as e:
        return "", 0, "error", str(e)[:300] or CORRUPTED
    except Exception as e:  # an extractor's own failure is a record, not a failed job
        return "", 0, "error", f"{type(e).__name__}: {e}"[:300]
    best = [max(p, key=len, default="") for p in pages]
    text = "\n".join(t for t in best if t and t.strip())
    return (text, len(pages), "success", None) if text.strip() else ("", len(pages), "error", NO_TEXT)


def upload_problem(name: Column | str, content: Column | str) -> Column:
    """Why an upload is refused, else null: its name does not end in .pdf, or it is empty."""
    content = F.col(content) if isinstance(content, str) else content
    return F.when(~is_pdf_name(name), "not a PDF").when(F.coalesce(F.length(content), F.lit(0)) == 0, "empty file")


def read_uploads(files: DataFrame, extractor: Extractor = simple_extractor, strict: bool = False) -> DataFrame:
    """``path, text, problem`` of uploads (``path, content``). Refused ones have an empty text; with ``strict`` the query fails on the first."""
    checked = files.withColumn("problem", upload_problem("path", "content"))
    if strict:
        good = checked.withColumn("content", F.when(F.col("problem").isNotNull(), F.raise_error(F.concat_ws(": ", "path", "problem")).cast("binary")).otherwise(F.col("content")))
    else:
        good = checked.where("problem is null")
    texts = read_pdfs(good, extractor, layout=False).select("path", "text", F.lit(None).cast("string").alias("problem"))
    return texts if strict else texts.unionByName(checked.where("problem is not null").select("path", F.lit("").alias("text"), "problem"))


def read_pdfs(files: DataFrame, extractor: Extractor = simple_extractor, layout: bool = True) -> DataFrame:
    """``path, text, num_pages, status, error`` of binary files (``path, content``).

    ``layout`` keeps blank lines; without it texts are cleaned as for single documents and any failure is an empty text.
    Null and empty contents, and what is no PDF, give a record with status error. A narrow map.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                r = extract_record(b.column(1)[at].as_py(), extractor)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 1), pa.array([r[0]]), pa.array([r[1]], pa.int32()), pa.array([r[2]]), pa.array([r[3]], pa.string())], names=["path", "text", "num_pages", "status", "error"])

    got = files.select("path", "content").mapInArrow(run, f"path string, {RECORD}")
    return got.withColumn("text", clean_layout_text("text") if layout else F.coalesce(clean_page_text("text"), F.lit("")))
