"""Matching by vectors, by fuzzy ratio, and the engine that combines them with look-ups."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import context_score, skill_norm, strip
from ..session import settled
from . import dictionary as dic

#: Numbers of the skill side that go to every worker at once (256 MB as doubles); a larger side is met in blocks of BLOCK_NUMBERS.
MOST_NUMBERS, BLOCK_NUMBERS = 32_000_000, 4_000_000
#: Items that meet a matrix in one product.
BATCH = 1024


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null where a side is null or the lengths differ."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x))


def _matrix(lists: pa.Array) -> np.ndarray:
    """A matrix of vectors of equal length, without copying them one by one."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(lists), -1)


def _same_length(vectors: pa.Array, width: int) -> np.ndarray:
    """Places of the vectors of that length without nulls inside."""
    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(vectors), width), False).to_numpy(zero_copy_only=False))
    if not vectors.flatten().null_count:
        return rows
    return np.array([i for i in rows if not vectors[int(i)].values.null_count], np.int64)


#: (products of a batch with the matrix, names of the matrix) -> rows and columns that are kept
Pick = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def _above(threshold: float) -> Pick:
    return lambda s: np.nonzero(s >= threshold)


def _best(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.arange(len(s)), s.argmax(axis=1)  # the first of equal ones: names are in order


def _products(keys: pa.Array, vectors: pa.Array, names: pa.Array, mat: np.ndarray, pick: Pick) -> Iterator[pa.RecordBatch]:
    rows = _same_length(vectors, mat.shape[1])
    for at in range(0, len(rows), BATCH):
        part = pa.array(rows[at : at + BATCH])
        s = _matrix(vectors.take(part)) @ mat.T
        i, j = pick(s)
        yield pa.RecordBatch.from_arrays([keys.take(part.take(pa.array(i))), names.take(pa.array(j)), pa.array(s[i, j])], names=["key", "name", "similarity"])


def _meet(items: DataFrame, skills: DataFrame, key: str, vector: str, name: str, skill_vector: str, pick: Pick, most: int | None = None) -> DataFrame:
    """``key, name, similarity`` of the pairs that ``pick`` takes of each product of a batch of items with a matrix of skills.

    A skill side of up to ``most`` numbers is sent to the workers, so that items are neither shuffled nor paired up row by row.
    A larger one is written as matrices of about BLOCK_NUMBERS numbers, which batches of items meet by block.
    """
    most = MOST_NUMBERS if most is None else most
    own = skills.select(F.col(name).alias("n"), F.col(skill_vector).alias("v")).where(F.col("n").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull()))
    kinds = [items.schema[key].dataType.simpleString(), skills.schema[name].dataType.simpleString()]
    schema = f"key {kinds[0]}, name {kinds[1]}, similarity double"
    sides = items.select(F.col(key).alias("key"), F.col(vector).alias("v")).where("v is not null")
    numbers = own.agg(F.sum(F.size("v"))).first()[0] or 0
    if numbers <= most:
        table = own.toArrow().sort_by("n")
        lengths = pc.list_value_length(table["v"])
        matrices = [(t["n"].combine_chunks(), _matrix(t["v"].combine_chunks())) for w in pc.unique(lengths).to_pylist() for t in [table.filter(pc.equal(lengths, w))]]
        sent = items.sparkSession.sparkContext.broadcast(matrices)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for names, mat in sent.value:
                    yield from _products(b.column(0), b.column(1), names, mat, pick)

        return sides.mapInArrow(run, schema).toDF(key, name, "similarity")
    blocks = -(-numbers // min(most, BLOCK_NUMBERS))

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("n")
        width = pc.list_value_length(t["v"])[0].as_py()
        return pa.table({"block": t["block"][:1], "w": pa.array([width], pa.int32()), "names": pa.array([t["n"].to_pylist()], pa.list_(t["n"].type)), "mat": pa.array([_matrix(t["v"].combine_chunks()).tobytes()], pa.binary())})

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in pc.unique(pc.list_value_length(b.column(1))).to_pylist():
                rows = pa.array(_same_length(b.column(1), w))
                for at in range(0, len(rows), BATCH):
                    part = rows[at : at + BATCH]
                    yield pa.RecordBatch.from_arrays([pa.array([w], pa.int32()), pa.array([b.column(0).take(part).to_pylist()], pa.list_(b.column(0).type)), pa.array([_matrix(b.column(1).take(part)).tobytes()], pa.binary())], names=["w", "keys", "vs"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, keys, vs, names, mats = b.columns
            for i in range(b.num_rows):
                n = w[i].as_py()
                s = np.frombuffer(vs[i].as_buffer(), np.float64).reshape(-1, n) @ np.frombuffer(mats[i].as_buffer(), np.float64).reshape(-1, n).T
                x, y = pick(s)
                yield pa.RecordBatch.from_arrays([keys[i].values.take(pa.array(x)), names[i].values.take(pa.array(y)), pa.array(s[x, y])], names=["key", "name", "similarity"])

    cutting = own.withColumn("block", F.pmod(F.xxhash64("n"), F.lit(blocks)).cast("int")).withColumn("w", F.size("v"))
    packed = cutting.groupBy("block", "w").applyInArrow(pack, f"block int, w int, names array<{kinds[1]}>, mat binary")
    batched = sides.mapInArrow(batch, f"w int, keys array<{kinds[0]}>, vs binary").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return batched.join(packed, ["block", "w"]).select("w", "keys", "vs", "names", "mat").mapInArrow(multiply, schema).toDF(key, name, "similarity")


def similarities(items: DataFrame, skills: DataFrame, key: str, vector: str, name: str, skill_vector: str, threshold: float = 0.6, most: int | None = None) -> DataFrame:
    """``key, name, similarity`` of every pair at or above ``threshold``: one matrix product for each batch of items, see ``_meet``.

    Vectors of equal length are compared, as in ``dot``; rows with a null vector, one with nulls inside, or one of a length
    that the other side lacks give nothing.
    """
    return _meet(items, skills, key, vector, name, skill_vector, _above(threshold), most)


def best_similarity(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Most similar of each group, at least 0."""
    return hits.groupBy(*keys).agg(F.greatest(F.max("similarity"), F.lit(0.0)).alias("similarity"))


def nearest(items: DataFrame, skills: DataFrame, key: str, vector: str, name: str, skill_vector: str, threshold: float = 0.6, most: int | None = None) -> DataFrame:
    """``key, name, similarity``: the nearest entry of every item, the first by name on ties; below ``threshold`` a null name with the score.

    Each product of a batch with a matrix gives one row for an item, so that the shuffle carries the best of each block only."""
    best = _meet(items, skills, key, vector, name, skill_vector, _best, most).groupBy(key).agg(F.min_by(name, F.struct(-F.col("similarity"), F.col(name))).alias(name), F.max("similarity").alias("similarity"))
    return best.select(key, F.when(F.col("similarity") >= threshold, F.col(name)).alias(name), "similarity")


def cosine_to(pairs: DataFrame, skills: DataFrame, vector: str, name: str, skill_vector: str) -> DataFrame:
    """``pairs`` with ``confidence``: the similarity of its vector to the vector of its own ``name``; 0 where that is unknown."""
    own = skills.select(F.col(name), F.col(skill_vector).alias("_v"))
    return pairs.join(settled(own)[0], name, "left").withColumn("confidence", F.coalesce(dot(F.col(vector), F.col("_v")), F.lit(0.0))).drop("_v")


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff and Obershelp's ratio, which no built-in gives (Levenshtein differs)."""
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="float64")


_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789 "


def _letters(c: str) -> Column:
    """How often each letter of a small alphabet occurs, and how many other characters there are."""
    own = [F.length(c) - F.length(F.replace(F.col(c), F.lit(x), F.lit(""))) for x in _ALPHABET]
    return F.array(*own, F.length(F.regexp_replace(c, f"[{_ALPHABET}]", "")))


def fuzzy_match(names: DataFrame, canonicals: DataFrame, least: float = 0.92, name: str = "name", canonical: str = "canonical") -> DataFrame:
    """``name, canonical, ratio``: for each distinct name the entry with the largest ratio of at least ``least``, the first by name
    on ties. Only entries that share a word with it are compared. Names meet entries by word and length, so that entries
    whose length rules the ratio out are never met; the letters in common bound the ratio before it is computed in Python."""
    n = names.select(F.col(name).alias("name")).where("name is not null").distinct().withColumn("la", F.length("name")).withColumn("na", _letters("name"))
    word = lambda c: F.explode(F.array_distinct(F.filter(F.split(F.col(c), r"\s+"), lambda w: w != "")))
    # 2 * min / (la + lb) >= least
    reach = F.sequence(F.ceil(F.col("la") * (least / (2 - least)) - 1e-9).cast("int"), F.floor(F.col("la") * ((2 - least) / least) + 1e-9).cast("int"))
    c = canonicals.select(F.col(canonical).alias("canonical")).distinct().withColumn("lb", F.length("canonical")).withColumn("nb", _letters("canonical"))
    entries, _ = settled(c.select("canonical", "lb", "nb", word("canonical").alias("w")))
    met = n.select("name", "la", "na", word("name").alias("w")).withColumn("lb", F.explode(reach)).join(entries, ["w", "lb"])
    common = F.aggregate(F.zip_with("na", "nb", lambda x, y: F.least(x, y)), F.lit(0), lambda a, x: a + x)
    close = met.where(2 * common / (F.col("la") + F.col("lb")) >= least - 1e-9).select("name", "canonical").distinct()
    scored = close.withColumn("ratio", fuzzy_ratio("name", "canonical")).where(F.col("ratio") >= least)
    return scored.groupBy("name").agg(F.min_by("canonical", F.struct(-F.col("ratio"), F.col("canonical"))).alias("canonical"), F.max("ratio").alias("ratio"))


def look_up(names: DataFrame, rows: DataFrame, name: str = "name") -> DataFrame:
    """``names`` with ``looked_up``: the entry of that very name, else the first entry of which it is an alias, else null."""
    own, _ = settled(rows.select(F.col("canonical").alias(name), F.col("canonical").alias("_own")).distinct())
    alias, _ = settled(dic.first_canonical(rows).select(F.col("phrase").alias(name), F.col("canonical").alias("_alias")))
    return names.join(own, name, "left").join(alias, name, "left").withColumn("looked_up", F.coalesce("_own", "_alias")).drop("_own", "_alias")


def canonicalise(raw: DataFrame, rows: DataFrame, key: str, name: str = "name", context: str = "context", vectors: DataFrame | None = None, skills: DataFrame | None = None, threshold: float = 0.6, least: float = 0.92) -> DataFrame:
    """``key, skill, score, confidence, source`` of raw mentions: by look-up, else fuzzy ratio, else nearest vector; the rest are dropped.

    ``vectors`` (name, vector) and ``skills`` (canonical, vector) are optional: without them the confidence of a rule
    hit is 0 and nothing is found by vector. Discarded is a vector hit below half the threshold. Null and blank names are left out.
    """
    mentions = raw.select(key, strip(F.col(name)).alias("source"), skill_norm(name).alias("name"), F.coalesce(F.col(context), F.lit("")).alias("context")).where("name <> ''")
    looked = look_up(mentions, rows)
    missing = looked.where("looked_up is null").select("name").distinct()
    fuzzy = fuzzy_match(missing, rows.select("canonical"), least).select("name", F.col("canonical").alias("_fuzzy"))
    found = looked.join(fuzzy, "name", "left").withColumn("rule", F.coalesce("looked_up", "_fuzzy"))
    if vectors is None or skills is None:
        scored = found.where("rule is not null").select("*", F.col("rule").alias("skill"), F.lit(0.0).alias("confidence"))
    else:
        near = nearest(vectors, skills, "name", "vector", "canonical", "vector", threshold).select("name", F.col("canonical").alias("_near"), F.col("similarity").alias("_sim"))
        with_near = found.join(near, "name", "left").join(vectors.select("name", "vector"), "name", "left").withColumn("skill", F.coalesce("rule", "_near")).where("skill is not null")
        scored = cosine_to(with_near, skills.withColumnRenamed("canonical", "skill").withColumnRenamed("vector", "_sv"), "vector", "skill", "_sv")
        scored = scored.where(F.col("rule").isNotNull() | (F.col("_sim") >= 0.5 * threshold)).withColumn("confidence", F.when(F.col("rule").isNotNull(), F.col("confidence")).otherwise(F.col("_sim")))
    return scored.select(key, "skill", context_score("context").alias("score"), "confidence", "source")


def merge_mentions(matched: DataFrame, key: str, boost: bool = True, most: int = 0) -> DataFrame:
    """``key, skill, score, confidence, sources, place``: one row for each skill of a key. Best score and confidence, all sources;
    several mentions raise the score by one each, to 3 at most. Placed by confidence, score, name; ``most`` > 0 keeps the first so many."""
    from pyspark.sql import Window

    g = matched.groupBy(key, "skill").agg(F.max("score").alias("s"), F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("source")).alias("sources"), F.count("*").alias("n"))
    score = F.when((F.col("n") > 1) & F.lit(boost), F.least(F.lit(3), F.col("s") + F.col("n") - 1)).otherwise(F.col("s")).cast("int")
    out = g.select(key, "skill", score.alias("score"), "confidence", "sources")
    placed = out.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("confidence"), F.desc("score"), "skill")))
    return placed.where(F.col("place") <= most) if most > 0 else placed


class HashedEncoder:
    """A stand-in for a sentence model: hashed character trigrams, unit length. Deterministic; its values mean nothing beyond tests."""

    def __init__(self, width: int = 64) -> None:
        self.width = width

    def __call__(self, texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), self.width))
        known: dict[str, tuple[int, int]] = {}
        for i, t in enumerate(texts):
            padded = f"  {(t or '').lower()} "
            for g in map("".join, zip(padded, padded[1:], padded[2:])):
                if (at := known.get(g)) is None:
                    h = xxhash.xxh64_intdigest(g)
                    at = known[g] = (h % self.width, 1 if h >> 63 else -1)
                out[i, at[0]] += at[1]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)


def encode(df: DataFrame, text: str, encoder: Callable[[], Callable[[list[str]], np.ndarray]], out: str = "vector") -> DataFrame:
    """``text, out``: each distinct text encoded once; ``encoder`` makes the model inside the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder()
        for b in batches:
            vectors = np.asarray(model(b.column(0).to_pylist()), np.float64)
            ends = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(vectors.ravel()))], names=["t", "v"])

    return df.select(F.col(text).alias("t")).where("t is not null").distinct().mapInArrow(run, "t string, v array<double>").toDF(text, out)
