"""Problem 2: groups of records whose word-shingle sets are similar, for a collection of any size.

Method: prefix filtering with adaptive multi-match prefixes. All shingles are put into one global order,
rarest first. Two sets that share at least o shingles share at least l of them within their l-prefixes
(the first size - o + l). A longer prefix costs more postings and asks for more shared ones, so each record
takes the l with the least estimated cost; a pair is held to the smaller l of its two records.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from ..session import cut, load, settled, spread

#: Most shared prefix shingles asked for, and what one verification costs against one joined posting.
MOST_SHARED, VERIFY_COST = 8, 12.0
#: A key that more than this share of the rows have is joined by broadcast: there are at most 1 / HOT_SHARE of them, whatever
#: the number of rows (of shingles, times the shingles of a record; their number is checked).
HOT_SHARE = 0.002
#: Postings, and copies of one record, are joined in blocks of this many, so that no key is one task's work.
BLOCK = 1_000
#: Copies of a hot shingle's count, where there are too many hot shingles to be sent to every executor.
SALTS = 64
#: Bits of the table of shingles that several records hold (16 MB, whatever the corpus); it spares the others a shuffle.
BITS = 1 << 27


def shingle_sets(df: DataFrame, key: str, text: str, words: int, least_tokens: int) -> DataFrame:
    """``id, s``: the distinct shingles (as 64-bit hashes, sorted) of each record with enough tokens."""
    t = F.expr(f"regexp_extract_all(lower({_quoted(text)}), '[a-z0-9]+', 0)")
    rows = spread(df.select(F.col(key).cast("bigint").alias("id"), F.col(text))).select("id", t.alias("t")).where((F.size("t") >= max(least_tokens, words)) & F.col("id").isNotNull())
    hashed = F.transform(F.sequence(F.lit(0), F.size("t") - words), lambda i: F.xxhash64(*[F.get("t", i + k) for k in range(words)]))
    return rows.select("id", F.array_sort(F.array_distinct(hashed)).alias("s"))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _blocks(n: Column, own: Column) -> Column:
    """Of a posting in block ``own`` of ``n``: the pairs of blocks in which it meets all other postings of its key."""
    other = F.sequence(F.lit(0), n - 1)
    return F.transform(other, lambda j: F.struct(F.least(own, j).alias("lo"), F.greatest(own, j).alias("hi")))


def _self_join(df: DataFrame, key: list[str], keep: list[str], count: Column, by: Column) -> DataFrame:
    """Pairs of rows with equal ``key`` and different id in columns a_.. and b_.., each unordered pair once;
    keys of more than BLOCK rows (``count``) are met in pairs of blocks, cut by the hash ``by``."""
    n = F.ceil(count / BLOCK).cast("int")
    rows = df.withColumn("_n", n).withColumn("_own", F.pmod(by, F.col("_n")).cast("int"))
    rows = rows.select(*key, *keep, "_own", F.explode(F.when(F.col("_n") <= 1, F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi")))).otherwise(_blocks(F.col("_n"), F.col("_own")))).alias("_b"))
    rows = rows.select(*key, *keep, "_own", F.col("_b.lo").alias("_lo"), F.col("_b.hi").alias("_hi"))
    rows = rows.repartition(*key, "_lo", "_hi")  # shuffled here, before the sides get their names, both sides read one exchange
    a, b = (rows.select(*key, "_lo", "_hi", *[F.col(c).alias(f"{p}_{c}") for c in [*keep, "_own"]]) for p in "ab")
    once = F.when(F.col("_lo") == F.col("_hi"), F.col("a_id") < F.col("b_id")).otherwise((F.col("a__own") == F.col("_lo")) & (F.col("b__own") == F.col("_hi")))
    return a.join(b, [*key, "_lo", "_hi"]).where(once).drop("_lo", "_hi", "a__own", "b__own")


def _join_hot(rows: DataFrame, table: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """``rows`` joined with ``table``, whose rows say in ``count`` how many of ``rows`` have their key. Keys of a large share of the
    ``total`` are joined by broadcast, so that none is one task's work."""
    most = max(BLOCK, HOT_SHARE * total)
    own = rows.columns
    hot = rows.join(F.broadcast(table.where(F.col(count) > most)), on, "left")
    cold = hot.where(F.col(count).isNull()).select(*own).join(table.where(F.col(count) <= most), on)
    return hot.where(F.col(count).isNotNull()).unionByName(cold)


def _held_by_several(sets: DataFrame, counts: DataFrame) -> DataFrame:
    """``id, n, s`` with those shingles only that may be among ``counts``: a table of bits goes to every worker."""
    words = BITS // 64

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(words, np.uint64)
        for b in batches:
            at = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(BITS - 1)
            np.bitwise_or.at(table, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        used = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(table[used].view(np.int64))], names=["at", "bits"])

    got = counts.select("h").mapInArrow(mark, "at bigint, bits bigint").groupBy("at").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    table = np.zeros(words, np.uint64)
    table[got["at"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    sent = sets.sparkSession.sparkContext.broadcast(table)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for b in batches:
            lists = b.column(2)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            at = flat.view(np.uint64) & np.uint64(BITS - 1)
            good = (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
            ends = np.concatenate([[0], np.cumsum(good)])[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat[good]))], names=["id", "n", "s"])

    return sets.select("id", "n", "s").mapInArrow(keep, "id bigint, n int, s array<bigint>")


def shared_shingles(sets: DataFrame) -> DataFrame:
    """``id, n, p``: of each set (``id, n, s``) its size and the shingles that other sets hold too, as (frequency, shingle) rarest first."""
    counts = cut(sets.select(F.explode("s").alias("h")).groupBy("h").agg(F.count("*").alias("c")).where("c > 1"))
    each = _held_by_several(sets, counts).select("id", "n", F.explode("s").alias("h"))
    most = max(BLOCK, HOT_SHARE * sets.count())
    hot, small = settled(counts.where(F.col("c") > most))
    if small:
        with_hot = each.join(hot, "h", "left")
        with_cold = with_hot.where("c is null").drop("c").join(counts.where(F.col("c") <= most), "h")
        counted = with_hot.where("c is not null").unionByName(with_cold)
    else:  # long records: more hot shingles than are sent to every executor
        salt = F.when(F.col("c") > most, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.sequence(F.lit(0), F.lit(0)))
        salted = counts.withColumn("salt", F.explode(salt)).withColumn("all", F.when(F.col("c") > most, SALTS).otherwise(1))
        one, many = (each.withColumn("salt", c) for c in (F.lit(0), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")))
        counted = one.join(salted.where("all = 1"), ["h", "salt"]).unionByName(many.join(salted.where("all > 1"), ["h", "salt"])).select("h", "id", "n", "c")
    return counted.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("c", "h"))).alias("p"))


def ordered_prefixes(docs: DataFrame, share: float) -> DataFrame:
    """``h, c, id, n, l, layer, behind``: the prefix postings of each set of ``shared_shingles``, with their frequency, the chosen l, the
    least l whose prefix holds the posting, and the shingles behind it in the order. Shingles of one record only cannot match and give none."""
    need = F.ceil(F.col("n") * F.lit(share) - F.lit(1e-9)).cast("int")  # what any partner shares at least
    docs = docs.where(F.size("p") >= need)  # fewer shared shingles than any partner needs
    docs = docs.withColumn("alone", F.col("n") - F.size("p")).withColumn("spare", F.col("n") - need)
    length = lambda k: F.greatest(F.lit(0), F.least(F.size("p"), F.col("spare") + k - F.col("alone")))
    sums = F.array(*[F.aggregate(F.slice("p", 1, length(k)), F.lit(0.0), lambda a, x: a + x["c"]) for k in range(1, MOST_SHARED + 1)])
    most_l = F.least(F.lit(MOST_SHARED), need)
    cost = lambda s, k: F.struct((F.element_at(s, k) * (F.lit(1.0) + F.lit(VERIFY_COST) / k)).alias("cost"), k.alias("l"))
    docs = docs.withColumn("l", let(sums, lambda s: F.array_min(F.transform(F.sequence(F.lit(1), most_l), lambda k: cost(s, k))))["l"])
    prefix = F.slice("p", 1, F.greatest(F.lit(0), F.least(F.size("p"), F.col("spare") + F.col("l") - F.col("alone"))))
    out = docs.select("id", "n", "l", "alone", "spare", F.posexplode_outer(prefix).alias("at", "x")).where("x is not null")
    return out.select(F.col("x.h").alias("h"), F.col("x.c").alias("c"), "id", "n", "l", F.greatest(F.lit(1), F.col("alone") + F.col("at") + 1 - F.col("spare")).cast("int").alias("layer"), (F.col("n") - 1 - F.col("alone") - F.col("at")).alias("behind"))


def similar_classes(sets: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """(members, links): ``rep, id, size`` of every record, where records with equal sets have one representative, the least of them, and
    ``a, b`` with a < b of the representatives whose sets are similar. Nothing is dropped or capped."""
    sets = cut(sets.select("id", "s", F.xxhash64("s").alias("k1"), F.hash("s", F.lit(7)).alias("k2"), F.size("s").alias("n")))
    keyed = sets.select("id", "k1", "k2", "n")
    classes = cut(keyed.groupBy("k1", "k2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("size")))
    members = cut(_join_hot(keyed, classes, ["k1", "k2", "n"], "size", keyed.count()).select("rep", "id", "size"))
    copies, _ = settled(members.where("id <> rep").select("id"))
    docs = cut(shared_shingles(sets.join(copies, "id", "left_anti").select("id", "n", "s")))
    post = ordered_prefixes(docs, share)
    met = _self_join(post, ["h"], ["id", "n", "l", "layer", "behind"], F.col("c"), F.xxhash64("id"))
    asked = F.least("a_l", "b_l")
    size_fits = F.least("a_n", "b_n") >= F.lit(share) * F.greatest("a_n", "b_n") - 1e-9
    # of the first l shared shingles none stands so late that those before it and behind it cannot make up the overlap
    overlap = F.ceil(F.lit(share / (1 + share)) * (F.col("a_n") + F.col("b_n")) - 1e-9)
    in_time = F.least("a_behind", "b_behind") + asked >= overlap
    met = met.where(size_fits & (F.greatest("a_layer", "b_layer") <= asked) & in_time)
    met = met.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), asked.alias("asked"))
    pairs = met.groupBy("a", "b").agg(F.count("*").alias("m"), F.max("asked").alias("asked"))
    candidates = pairs.where("m >= asked").select("a", "b")
    # what two sets share is among the shingles that several sets hold
    held = docs.select("id", "n", F.col("p.h").alias("s"))
    left = candidates.join(held.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa")), "a")
    both = left.join(held.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb")), "b")
    o = F.size(F.array_intersect("sa", "sb"))
    links = both.where(o / (F.col("na") + F.col("nb") - o) >= F.lit(share)).select("a", "b")
    return members, links


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of each node of ``links`` (a, b): the least node that it reaches.

    Alternating large-star and small-star steps; each round's edges are written to the shared folder.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        total = edges.count()
        # large star: every larger neighbour of u is tied to the least of u's neighbourhood
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("deg"))
        large = _join_hot(both, least, ["u"], "deg", total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours are tied to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("deg"))
        small = _join_hot(large, low, ["u"], "deg", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = cut(small)
        same = new.exceptAll(edges).isEmpty() and edges.exceptAll(new).isEmpty()
        edges = new
        if same:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(df: DataFrame, key: str, text: str, share: float = 0.8, words: int = 5, least_tokens: int = 5) -> DataFrame:
    """``row_id, group_id, n_links``: one row for each record, with its group and the number of records it is linked to.

    Two records are linked if their sets of ``words`` consecutive tokens (runs of a-z and 0-9, lower-cased)
    share at least ``share`` of their union; copies are linked to each other. A group is what links connect,
    named by its least ``row_id``. Records with null, empty or short texts stand alone with no links. Rows with
    a null key are left out; a repeated key is not expected. Other columns of ``df`` are not read.
    """
    members, links = similar_classes(shingle_sets(df, key, text, words, least_tokens), share)
    links = cut(links)
    sizes = members.where("id = rep").select("rep", "size")
    ends = links.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    degrees = ends.groupBy("other").agg(F.count("*").alias("deg")).join(sizes.withColumnRenamed("rep", "other"), "other")
    more = _join_hot(ends, degrees, ["other"], "deg", ends.count()).groupBy("rep").agg(F.sum("size").alias("more"))
    reps = sizes.join(more, "rep", "left").join(components(links).withColumnRenamed("node", "rep"), "rep", "left")
    reps = reps.select("rep", "size", F.coalesce("root", "rep").alias("group_id"), (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    found = _join_hot(members.select("rep", "id"), reps, ["rep"], "size", members.count()).select(F.col("id").alias("row_id"), "group_id", "n_links")
    # representatives are the least of their class, so the least of a component is the least row of its group
    alone = df.select(F.col(key).cast("bigint").alias("row_id")).where("row_id is not null")
    return alone.join(found, "row_id", "left").select("row_id", F.coalesce("group_id", "row_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def similar_pairs(df: DataFrame, key: str, text: str, share: float = 0.8, words: int = 5, least_tokens: int = 5) -> DataFrame:
    """``row_id_a, row_id_b`` with a < b of all linked records, copies expanded; see ``near_duplicates``."""
    members, links = similar_classes(shingle_sets(df, key, text, words, least_tokens), share)
    several = members.where("size > 1")
    copies = _self_join(several.select("rep", "id", F.col("size").alias("_size")), ["rep"], ["id"], F.col("_size"), F.xxhash64("id")).select(F.col("a_id").alias("x"), F.col("b_id").alias("y"))
    # a link stands for all pairs of its two classes; large classes are met block by block
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    cuts = members.where("id = rep").select("rep", blocks.alias("nb"))
    placed = members.select("rep", "id", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))
    side = lambda r, i, block: placed.select(F.col("rep").alias(r), F.col("id").alias(i), F.col("block").alias(block))
    met = links.join(cuts.toDF("a", "na"), "a").join(cuts.toDF("b", "nb"), "b")
    met = met.select("a", "b", F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("ba"), "nb").select("a", "b", "ba", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("bb"))
    across = met.join(side("a", "x", "ba"), ["a", "ba"]).join(side("b", "y", "bb"), ["b", "bb"]).select("x", "y")
    return copies.unionByName(across).select(F.least("x", "y").alias("row_id_a"), F.greatest("x", "y").alias("row_id_b"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(load(spark, sf_dir, "resume"), "row_id", "Resume_str", share=0.6, words=3, least_tokens=20)


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "resume"), "row_id", "Resume_str", share=0.6, words=3, least_tokens=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p2_found": p2_found, "p2_groups": p2_groups}
_PAIRS = """
WITH RECURSIVE toks AS (SELECT row_id, regexp_extract_all(lower(Resume_str), '[a-z0-9]+') AS t FROM resume WHERE Resume_str IS NOT NULL),
sh AS (SELECT DISTINCT row_id, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) AS s FROM toks WHERE len(t) >= 20),
n AS (SELECT row_id, count(*) AS n FROM sh GROUP BY row_id),
o AS (SELECT a.row_id AS row_id_a, b.row_id AS row_id_b, count(*) AS o FROM sh a JOIN sh b ON a.s = b.s AND a.row_id < b.row_id GROUP BY ALL),
pairs AS MATERIALIZED (SELECT row_id_a, row_id_b FROM o JOIN n na ON na.row_id = row_id_a JOIN n nb ON nb.row_id = row_id_b WHERE o / (na.n + nb.n - o) >= 0.6)"""
SQL: dict[str, str] = {
    "p2_found": f"{_PAIRS} SELECT row_id_a, row_id_b FROM pairs",
    "p2_groups": f"""{_PAIRS},
ways AS MATERIALIZED (SELECT row_id_a AS a, row_id_b AS b FROM pairs UNION ALL SELECT row_id_b, row_id_a FROM pairs),
reached AS (SELECT row_id AS node, row_id AS low FROM resume UNION SELECT w.b, r.low FROM reached r JOIN ways w ON w.a = r.node AND r.low < w.b),
roots AS (SELECT node, min(low) AS group_id FROM reached GROUP BY node),
links AS (SELECT a, count(*) AS n FROM ways GROUP BY a)
SELECT node AS row_id, group_id, coalesce(n, 0) AS n_links FROM roots LEFT JOIN links ON a = node""",
}
