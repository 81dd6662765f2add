"""The offline stages as commands: python -m skillmill.plans.stages mine|clean|filter|inspect ..."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from ..config import Settings
from ..operators import dictionary as dic
from ..operators import vocabulary as voc
from ..session import local_session
from ..sources.tables import corpus_of, read_dictionary, unite, write_dictionary


def mine(spark: SparkSession, raw: str, out: str, settings: Settings = Settings()) -> DataFrame:
    """Corpora of a folder -> dictionary with the seeds merged in. An empty corpus leaves the seeds."""
    corpus = unite(corpus_of(spark, raw, settings.html_max_files, settings.pdf_max_files))
    entries = dic.merge_seeds(voc.as_dictionary(voc.mine(corpus, min_df=settings.min_df, max_terms=settings.max_terms, stop_words=settings.mining_words())))
    write_dictionary(entries, out, ascii_only=True)
    return entries


def clean(spark: SparkSession, source: str, out: str) -> tuple[int, int, int]:
    """(original, removed, final) of stage 2; the cleaned dictionary goes to ``out``."""
    entries = read_dictionary(spark, source)
    write_dictionary(dic.clean_entries(entries), out)
    return tuple(dic.cleaning_stats(entries).select("original", "removed", "final").first())


def filter_skills(spark: SparkSession, source: str, out: str) -> tuple[int, int, int]:
    """The same of stage 3."""
    entries = read_dictionary(spark, source)
    write_dictionary(dic.filter_entries(entries), out)
    return tuple(dic.filtering_stats(entries).select("original", "removed", "final").first())


def inspect(spark: SparkSession, source: str, top: int = 50, random: int = 20, seed: int = 0) -> tuple[int, DataFrame, DataFrame]:
    """Number of entries, the first ``top`` by name, and ``random`` chosen by ``seed``."""
    entries = read_dictionary(spark, source)
    return dic.for_profile(entries).count(), dic.profile(entries, top), dic.sample_entries(entries, random, seed)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="skillmill.plans.stages")
    sub = p.add_subparsers(dest="stage", required=True)
    for name in ("mine", "clean", "filter"):
        s = sub.add_parser(name)
        s.add_argument("source")
        s.add_argument("out")
    s = sub.add_parser("inspect")
    s.add_argument("source")
    s.add_argument("--top", type=int, default=50)
    s.add_argument("--random", type=int, default=20)
    s.add_argument("--seed", type=int, default=0)
    a = p.parse_args(argv)
    spark = local_session()
    if a.stage == "mine":
        print(mine(spark, a.source, a.out, Settings.from_env()).count(), "entries")
    elif a.stage == "inspect":
        total, top, picked = inspect(spark, a.source, a.top, a.random, a.seed)
        print(total, "entries")
        top.show(a.top, truncate=80)
        picked.show(a.random, truncate=80)
    else:
        original, removed, final = (clean if a.stage == "clean" else filter_skills)(spark, a.source, a.out)
        print(f"original {original}, removed {removed}, final {final}")


if __name__ == "__main__":
    main()
