"""Corpora as DataFrames: tables of resumes and jobs, folders of HTML and PDF files, dictionaries in JSON."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import JOB_TEXT_COLUMNS, RESUME_TEXT_COLUMNS
from ..functions.text import clean_corpus_text, html_to_text, not_blank
from .excel import read_excel
from .pdf import read_pdfs

MAP = "map<string,array<string>>"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.globStatus(p))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A .csv or .xlsx table with a header, all columns strings; other names are refused, among them .xls, the binary form of old workbooks."""
    low = path.lower()
    if low.endswith(".xls"):
        raise ValueError(f"a binary workbook, to be saved as .xlsx or .csv first: {path}")
    if low.endswith(".xlsx"):
        return read_excel(spark, path)
    if low.endswith(".csv"):
        return spark.read.csv(path, header=True, multiLine=True, escape='"')
    raise ValueError(f"not a table: {path}")


def _first_present(df: DataFrame, columns: tuple[str, ...], treat: Callable[[str, Column], Column]) -> Column:
    """Of each row, the first of the listed columns that is there and not null, treated by its own name."""
    there = [c for c in columns if c in df.columns]
    out = F.lit(None).cast("string")
    for c in reversed(there):
        out = F.when(F.col(c).isNotNull(), treat(c, F.col(c).cast("string"))).otherwise(out)
    return out


def resume_corpus(df: DataFrame, key: str | None = None) -> DataFrame:
    """``source, doc_id, text`` of a wide table of resumes: cleaned text, markup removed where the chosen column is one of HTML; empty rows dropped."""
    text = _first_present(df, RESUME_TEXT_COLUMNS, lambda name, c: html_to_text(c) if "html" in name.lower() else c)
    ident = F.col(key).cast("string") if key else F.monotonically_increasing_id().cast("string")
    return df.select(F.lit("resume").alias("source"), ident.alias("doc_id"), clean_corpus_text(text).alias("text")).where("text <> ''")


def job_corpus(df: DataFrame, key: str | None = None) -> DataFrame:
    """The same of a table of jobs: a column of a known name, else the last one."""
    name = next((c for c in JOB_TEXT_COLUMNS if c in df.columns), df.columns[-1])
    ident = F.col(key).cast("string") if key else F.monotonically_increasing_id().cast("string")
    return df.select(F.lit("job").alias("source"), ident.alias("doc_id"), clean_corpus_text(F.col(f"`{name}`").cast("string")).alias("text")).where("text <> ''")


def folder_corpus(spark: SparkSession, folder: str, html_max: int = 0, pdf_max: int = 0, missing_ok: bool = True) -> DataFrame:
    """The same of a folder and all below it: HTML files; PDF files only if there is no HTML file. A cap takes the first paths by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    empty = spark.createDataFrame([], "source string, doc_id string, text string")
    if missing_ok and not exists(spark, folder):
        return empty
    pages = files.option("pathGlobFilter", "*.{html,htm}").load(folder)
    if not pages.isEmpty():
        if html_max > 0:
            # .html files come before .htm files
            pages = pages.orderBy(F.lower("path").endswith(".htm"), "path").limit(html_max)
        markup = F.call_function("decode", F.col("content"), F.lit("UTF-8"))
        text = clean_corpus_text(html_to_text(F.replace(markup, F.lit("�"), F.lit(""))))
        return pages.select(F.lit("html").alias("source"), F.col("path").alias("doc_id"), text.alias("text")).where("text <> ''")
    pdfs = files.option("pathGlobFilter", "*.pdf").load(folder)
    if pdf_max > 0:
        pdfs = pdfs.orderBy("path").limit(pdf_max)
    got = read_pdfs(pdfs)
    return got.select(F.lit("pdf").alias("source"), F.col("path").alias("doc_id"), clean_corpus_text("text").alias("text")).where("text <> ''")


def corpus_of(spark: SparkSession, raw: str, html_max: int = 0, pdf_max: int = 0) -> DataFrame:
    """All corpora of a folder as it is laid out: Resume/Resume.xlsx or .csv, job_title_des.xlsx or .csv, and pages or PDFs under html/."""
    out = folder_corpus(spark, f"{raw}/html", html_max, pdf_max)
    for stem, build in (("job_title_des", job_corpus), ("Resume/Resume", resume_corpus)):
        path = next((f"{raw}/{stem}{e}" for e in (".xlsx", ".csv") if exists(spark, f"{raw}/{stem}{e}")), None)
        if path:
            out = build(read_table(spark, path)).unionByName(out)
    return out


def unite(*corpora: DataFrame) -> DataFrame:
    """Union of corpora by name, blank texts dropped."""
    out = corpora[0]
    for c in corpora[1:]:
        out = out.unionByName(c)
    return out.where(not_blank("text"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``canonical, aliases, pos`` of a JSON object name -> list. A missing file or another top level gives none; of equal keys the last holds."""
    if not exists(spark, path):
        return spark.createDataFrame([], "canonical string, aliases array<string>, pos bigint")
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.posexplode(F.map_entries(F.from_json("value", MAP))).alias("pos", "e"))
    return rows.select(F.col("e.key").alias("canonical"), F.col("e.value").alias("aliases"), F.col("pos").cast("bigint").alias("pos"))


@F.pandas_udf(T.StringType())
def ascii_json(s: pd.Series) -> pd.Series:
    """JSON with every character outside ASCII as an escape."""
    return s.map(lambda x: "".join(c if c < "\x80" else json.dumps(c)[1:-1] for c in x), na_action="ignore")


def write_dictionary(entries: DataFrame, path: str, ascii_only: bool = False) -> None:
    """One pretty JSON object with sorted keys, for exchange: a dictionary is small by its cap of terms. Tables stay in Parquet."""
    whole = entries.groupBy().agg(F.array_sort(F.collect_list(F.struct("canonical", "aliases"))).alias("e"))
    text = F.to_json(F.map_from_entries("e"), {"pretty": "true"})
    if ascii_only:
        text = ascii_json(text)
    whole.select(F.coalesce(text, F.lit("{}")).alias("value")).coalesce(1).write.mode("overwrite").text(path)
