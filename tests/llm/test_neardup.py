import random
import re

import pytest

from skillmill.llm import neardup

WORDS = [f"w{i}" for i in range(400)]


def corpus(n=220, seed=4):
    rng = random.Random(seed)
    base = [[rng.choice(WORDS) for _ in range(rng.randint(25, 60))] for _ in range(n // 4)]
    common = "all texts share this long and quite usual sentence at their very end".split()
    out = []
    for i in range(n):
        t = list(rng.choice(base[: n // 8] if rng.random() < 0.7 else base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            k = rng.randrange(len(t))
            op = rng.random()
            if op < 0.4:
                t[k] = rng.choice(WORDS)
            elif op < 0.7:
                t.insert(k, rng.choice(WORDS))
            else:
                del t[k]
        out.append((i, (" ".join(t + common)).upper() if rng.random() < 0.1 else " ".join(t + common)))
    hot = " ".join(base[0] + common)
    out += [(1000 + i, hot) for i in range(n // 3)]  # a third of the rows are one text
    return out + [(2000, None), (2001, ""), (2002, "too short"), (2003, "   "), (2004, "é " * 50)]


def brute(rows, share, words, least):
    sets = {}
    for i, t in rows:
        toks = re.findall("[a-z0-9]+", (t or "").lower())
        if len(toks) >= max(least, words):
            sets[i] = {tuple(toks[k : k + words]) for k in range(len(toks) - words + 1)}
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= share}


@pytest.mark.parametrize("share, words, least, block", [(0.6, 3, 20, 1000), (0.8, 5, 5, 7), (0.6, 3, 20, 10)])
def test_against_all_pairs(spark, monkeypatch, share, words, least, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "HOT_SHARE", 0.05)
    rows = corpus()
    df = spark.createDataFrame([(i, t, 0, 0, 0) for i, t in rows], "row_id bigint, txt string, id int, s int, h int")
    want = brute(rows, share, words, least)
    got = [tuple(r) for r in neardup.similar_pairs(df, "row_id", "txt", share, words, least).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500
    groups = {r.row_id: (r.group_id, r.n_links) for r in neardup.near_duplicates(df, "row_id", "txt", share, words, least).collect()}
    assert set(groups) == {i for i, _ in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = dict.fromkeys(root, 0)
    for a, b in want:
        links[a] += 1
        links[b] += 1
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert groups == {i: (find(i), links[i]) for i in root}


def test_nothing_to_compare(spark):
    df = spark.createDataFrame([(1, None), (2, "a b"), (None, "a b c d e f g")], "row_id bigint, t string")
    assert neardup.similar_pairs(df, "row_id", "t").count() == 0
    assert sorted(tuple(r) for r in neardup.near_duplicates(df, "row_id", "t").collect()) == [(1, 1, 0), (2, 2, 0)]
    assert neardup.near_duplicates(df.where("false"), "row_id", "t").count() == 0
    same = spark.createDataFrame([(i, "one two three four five six") for i in range(30)], "row_id bigint, t string")
    assert neardup.similar_pairs(same, "row_id", "t").count() == 30 * 29 // 2
    assert {tuple(r)[1:] for r in neardup.near_duplicates(same, "row_id", "t").collect()} == {(0, 29)}


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 102), (102, 100)]
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 102: 100, 103: 100}
