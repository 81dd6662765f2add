"""Problem 7: texts put together into windows of fixed capacity, measured in tokens."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load, spread
from .bpe import tokenizer_path, transducer

#: Items that one packing task gets. Blocks are cut by a hash of the key, so none is hot.
ITEMS_PER_BLOCK = 20_000
#: A conflict group with more members than one for each CROWD bins goes first.
CROWD = 8
#: context_windows is a fixed table of three rows; more than this is refused, as its rows go to the driver.
MOST_WINDOW_KINDS = 1_000

PACKED = "window_id bigint, capacity bigint, window_no bigint, doc_id bigint, piece_no int, token_start bigint, n_tokens bigint"


def counter(tokenizer: str, folder: str | None = None) -> Callable[[str | None], int]:
    """text -> number of tokens, without special tokens, for each of the public tokenizers."""
    if tokenizer.startswith("byte_bpe"):
        return transducer(tokenizer_path(f"{tokenizer}.tiktoken", folder)).count
    if tokenizer.startswith("piece"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(f"{tokenizer}.model", folder))
        return lambda t: len(sp.encode(t)) if t else 0
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_path(f"{tokenizer}.json", folder))
    tk.encode_special_tokens = True
    return lambda t: len(tk.encode(t, add_special_tokens=False).ids) if t else 0


def apart(items: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """The conflict group of each item: its cluster, where every member can have a bin of its own among the fewest bins that hold
    all items. A larger cluster, of which some bin must hold several, is dealt out to as many groups as a bin must hold of it."""
    fewest = max(1, -(-sum(n for n, _, _ in items) // capacity))
    of, dealt = Counter(c for _, _, c in items), Counter()
    out = []
    for _, _, c in items:
        out.append((c, dealt[c] % -(-of[c] // fewest)))
        dealt[c] += 1
    return out


def best_fit(items: list[tuple[int, int, int]], capacity: int) -> list[int]:
    """The bin of each item (size, source, cluster); sizes are 1 to ``capacity``.

    Items go by falling size, but those of a group that a large share of the bins must hold go first, as they would find
    no compatible bins with room later. Bins are ordered by residual room: one bit of ``open`` says whether bins
    of a residual exist, so that the successor search jumps to the next tightest. Each bin carries a
    bitmap of sources and one of duplicate clusters. The search goes on until the tightest bin without the item's
    cluster is found, else a new bin is opened; among equally tight ones, which are kept by bitmap of sources, a bin
    without the item's source comes first. Of a cluster with more members than bins are needed, see ``apart``.
    """
    bits: dict[tuple, int] = {}
    groups = apart(items, capacity)
    often = Counter(groups)
    bit = lambda kind, x: 1 << bits.setdefault((kind, x), len(bits))
    by_room: dict[int, dict[int, list[int]]] = defaultdict(dict)
    sources: list[int] = []
    clusters: list[int] = []
    room: list[int] = []
    open_, out = 0, [0] * len(items)
    many = sum(n for n, _, _ in items) / capacity / CROWD
    for k in sorted(range(len(items)), key=lambda i: (often[groups[i]] < many, -items[i][0])):
        size, source, _ = items[k]
        s = bit("s", source)
        c = bit("c", groups[k]) if often[groups[k]] > 1 else 0
        found, left = -1, open_ >> size
        base = size
        while left:
            low = (left & -left).bit_length() - 1
            here = by_room[base + low]
            other = -1
            for held, bins in here.items():
                if held & s and other >= 0:
                    continue
                b = bins[-1] if not c else next((b for b in reversed(bins) if not c & clusters[b]), -1)
                if b >= 0 and not held & s:
                    found = b
                    break
                other = max(other, b)
            if found < 0:
                found = other
            if found >= 0:
                break
            left >>= low + 1
            base += low + 1
        if found < 0:
            found = len(room)
            room.append(capacity)
            sources.append(0)
            clusters.append(0)
        else:
            r = room[found]
            bins = by_room[r][sources[found]]
            if bins[-1] == found:
                bins.pop()
            else:
                bins.remove(found)
            if not bins:
                del by_room[r][sources[found]]
            if not by_room[r]:
                open_ &= ~(1 << r)
        room[found] = r = room[found] - size
        sources[found] |= s
        clusters[found] |= c
        if r:
            by_room[r].setdefault(sources[found], []).append(found)
            open_ |= 1 << r
        out[k] = found
    return out


def sizes(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", source: str = "source", cluster: str | None = None, folder: str | None = None) -> DataFrame:
    """``doc_id, source, cluster, n`` of every row: its tokens, its source and its cluster, else the hash of its text, equal for copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer, folder)
        for b in batches:
            n = pa.array([count(t.as_py()) for t in b.column(3)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], n], names=["doc_id", "source", "cluster", "n"])

    rows = df.select(F.col(key).cast("bigint").alias("doc_id"), F.xxhash64(source).alias("source"), (F.coalesce(F.col(cluster).cast("bigint"), F.xxhash64(key)) if cluster else F.xxhash64(text)).alias("cluster"), F.col(text).alias("text"))
    return spread(rows).mapInArrow(run, "doc_id bigint, source bigint, cluster bigint, n bigint")


def pack(df: DataFrame, windows: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", cluster: str | None = None, folder: str | None = None) -> DataFrame:
    """Which document, or piece of one, lies in which window of each row of ``windows``.

    Columns: window_id, capacity, window_no, doc_id, piece_no, token_start, n_tokens. A document longer than
    the capacity is cut into pieces of the full capacity and a rest; no other is cut. Empty and null texts,
    and blank ones of no tokens, take no room: one row with null window_no and n_tokens 0. Copies and rows
    with the same key are items of their own. Windows with a null or non-positive capacity hold nothing and
    are left out. Method: best fit with conflicts, see ``best_fit``, in blocks of about ITEMS_PER_BLOCK items.
    Kept apart are copies of a text, or rows of equal ``cluster`` (a bigint column, such as the groups of problem 2; rows
    where it is null are in conflict with none).
    """
    kinds = windows.select("window_id", "tokenizer", "capacity").where("capacity > 0").limit(MOST_WINDOW_KINDS + 1).collect()
    if len(kinds) > MOST_WINDOW_KINDS:
        raise ValueError("too many kinds of window")
    blocks = max(1, -(-df.count() // ITEMS_PER_BLOCK))
    out = None
    for tokenizer in sorted({k["tokenizer"] for k in kinds}):
        own = F.array(*[F.struct(F.lit(k["window_id"]).cast("bigint").alias("window_id"), F.lit(k["capacity"]).cast("bigint").alias("capacity")) for k in kinds if k["tokenizer"] == tokenizer])
        items = (
            sizes(df, tokenizer, key, text, source, cluster, folder)
            .withColumn("block", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(blocks)))
            .select("*", F.inline(own))
            .repartition(blocks * len(kinds), "window_id", "block")
        )
        got = items.groupBy("window_id", "block").applyInArrow(_pack_block, PACKED)
        out = got if out is None else out.unionByName(got)
    return out if out is not None else df.sparkSession.createDataFrame([], PACKED)


def _pack_block(t: pa.Table) -> pa.Table:
    window, block, capacity = (t.column(c)[0].as_py() for c in ("window_id", "block", "capacity"))
    docs, items, where = [], [], []
    for doc, source, cluster, n in sorted(zip(*(t.column(c).to_pylist() for c in ("doc_id", "source", "cluster", "n"))), key=lambda r: (r[0] is None, r[0] or 0, r[2])):
        if not n:
            docs.append((None, doc, 0, 0, 0))
        for piece, at in enumerate(range(0, n, capacity)):
            items.append((min(capacity, n - at), source, cluster))
            where.append((doc, piece, at))
    base = block << 32
    docs += [(base + b, d, piece, at, size) for (d, piece, at), (size, _, _), b in zip(where, items, best_fit(items, capacity))]
    cols = list(zip(*docs))
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
    n = len(docs)
    return pa.table(
        [pa.array([window] * n, pa.int64()), pa.array([capacity] * n, pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds))],
        names=["window_id", "capacity", "window_no", "doc_id", "piece_no", "token_start", "n_tokens"],
    )


def p7_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"), load(spark, sf_dir, "context_windows"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each kind of window: how many are used, how many would hold the tokens if none had room left, and the share used."""
    rows = p7_windows(spark, sf_dir).where("window_no is not null")
    per = rows.groupBy("window_id", "capacity", "window_no").agg(F.sum("n_tokens").alias("n"))
    return per.groupBy("window_id", "capacity").agg(
        F.count("*").alias("n_windows"), F.ceil(F.sum("n") / F.first("capacity")).alias("least_windows"), F.round(F.sum("n") / (F.count("*") * F.first("capacity")), 4).alias("fill"), F.max("n").alias("fullest")
    )


def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each kind of window what must hold: all documents are there once; numbers of windows over their capacity, of documents whose
    pieces are not their tokens in order without gaps, of windows with more copies of a text than must be; at most 1 % and one window in
    excess of what the tokens of each block need."""
    docs, windows = load(spark, sf_dir, "documents"), load(spark, sf_dir, "context_windows")
    kinds = [tuple(r) for r in windows.select("tokenizer", "window_id").limit(MOST_WINDOW_KINDS).collect()]
    rows = pack(docs, windows).withColumn("block", F.shiftright("window_no", 32))
    own = None
    for k in sorted({t for t, _ in kinds}):
        n = sizes(docs, k).select("doc_id", "cluster", "n", F.explode(F.array(*[F.lit(w) for t, w in kinds if t == k])).alias("window_id"))
        own = n if own is None else own.unionByName(n)
    per_doc = rows.groupBy("window_id", "capacity", "doc_id").agg(
        F.sum("n_tokens").alias("placed"), F.max(F.col("token_start") + F.col("n_tokens")).alias("end"), F.count("*").alias("pieces"), F.max("piece_no").alias("last"), F.bool_and(F.col("token_start") == F.col("piece_no") * F.col("capacity")).alias("aligned")
    )
    held = per_doc.join(own, ["window_id", "doc_id"], "full")
    fine = (F.col("placed") == F.col("n")) & (F.col("end") == F.col("n")) & (F.col("pieces") == F.col("last") + 1) & F.col("aligned")
    docs_ok = held.groupBy("window_id").agg(F.max("capacity").alias("capacity"), F.count("*").alias("n_docs"), F.count_if(~F.coalesce(fine, F.lit(False))).alias("misplaced"))
    placed = rows.where("window_no is not null")
    per = placed.groupBy("window_id", "capacity", "block", "window_no").agg(F.sum("n_tokens").alias("n"))
    blocks = per.groupBy("window_id", "capacity", "block").agg(F.count("*").alias("used"), F.ceil(F.sum("n") / F.first("capacity")).alias("least"), F.count_if(F.col("n") > F.col("capacity")).alias("over"))
    copies = placed.join(own.select("window_id", "doc_id", "cluster"), ["window_id", "doc_id"]).groupBy("window_id", "block", "cluster", "window_no").agg(F.count("*").alias("here"))
    crowds = copies.groupBy("window_id", "block", "cluster").agg(F.sum("here").alias("all"), F.max("here").alias("most"))
    crowded = crowds.join(blocks.select("window_id", "block", "least"), ["window_id", "block"]).groupBy("window_id").agg(F.count_if(F.col("most") > F.ceil(F.col("all") / F.col("least"))).alias("crowded"))
    full = blocks.groupBy("window_id").agg(F.sum("over").alias("over"), F.bool_and(F.col("used") <= F.ceil(F.col("least") * 1.01) + 1).alias("tight"))
    return docs_ok.join(full, "window_id").join(crowded, "window_id").select("window_id", "capacity", "n_docs", "misplaced", "over", "crowded", "tight")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p7_windows": p7_windows, "p7_fill": p7_fill, "p7_invariants": p7_invariants}
SQL: dict[str, str] = {  # greedy packing is not expressible in SQL, but what must hold of it is; tests hold it against a plain best fit too
    "p7_invariants": "SELECT window_id, capacity, (SELECT count(*) FROM documents) AS n_docs, 0::BIGINT AS misplaced, 0::BIGINT AS over, 0::BIGINT AS crowded, true AS tight FROM context_windows",
}
