"""Shingle Jaccard join against plain sets of strings, all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import types as T

from pagemill.llm import common
from pagemill.llm import occurrence_join as oj
from pagemill.llm.queries import QUERIES

ROW = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("uid", T.StringType()),
    T.StructField("component", T.StringType()),
])


def plain_set(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    return {" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))} if words else set()


def brute(rows, percent=90):
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, x in enumerate(sets):
        for b in range(a):
            if x and sets[b] and 100 * len(x & sets[b]) >= percent * len(x | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        c = find(k)
        least[c] = i if least.get(c) is None else least[c] if i is None else min(i, least[c])
    return sorted(((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], ROW)


def edited(r, words, times):
    words = list(words)
    for _ in range(times):
        at = r.randrange(len(words))
        words[at : at + r.choice([0, 1, 1])] = [f"new{r.random()}"] * r.choice([0, 1, 1])
    return words


def texts(seed, groups, size):
    r = random.Random(seed)
    shared = [f"common{k}" for k in range(60)]
    rows = []
    for g in range(groups):
        base = [f"w{r.randrange(400)}" for _ in range(r.choice([4, 9, 30, 120, 400]))]
        if g % 3 == 0:
            base[len(base) // 2 : len(base) // 2] = shared
        for k in range(r.randint(1, size)):
            words = edited(r, base, r.choice([0, 1, len(base) // 90, len(base) // 60, len(base) // 30]))
            rows.append((1000 * g + k, " ".join(w.upper() if r.random() < 0.1 else w for w in words)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("percent", [50, 90])
def test_block_search_finds_what_reaches_the_overlap(percent):
    r = np.random.default_rng(3)
    base = np.unique(r.integers(0, 1 << 60, 300, dtype=np.uint64))
    sets = [base]
    for k in range(60):
        kept = base[r.random(len(base)) < r.choice([0.3, 0.7, 0.95, 0.99])]
        sets.append(np.unique(np.concatenate([kept, r.integers(0, 1 << 60, int(r.integers(0, 40)), dtype=np.uint64)])))
    sets += [s[: 1 + k % 7] for k, s in enumerate(sets) if k % 5 == 0]
    index = oj.Block(sets)
    for after in (-1, 20):
        for x in sets:
            want = {
                p for p, y in enumerate(sets) if p > after
                and 100 * len(np.intersect1d(x, y)) >= percent * len(np.union1d(x, y))
            }
            assert set(index.search(x, percent, after)) == want


@pytest.mark.parametrize(("block", "chunk", "frequent", "rows"), [(128, 256, 32, 10**6), (2, 3, 2, 0), (4, 40, 6, 10)])
def test_against_brute_force(spark, monkeypatch, block, chunk, frequent, rows):
    for name, value in (("BLOCK", block), ("CHUNK", chunk), ("FREQUENT", frequent)):
        monkeypatch.setattr(oj, name, value)
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    rows = texts(block, 40, 12)
    rows += [(5, None), (6, ""), (7, " \t\n"), (8, "One"), (9, "oNE"), (10, "one two"), (11, "one\ttwo "), (None, "One"), (None, "a b c d"), (12, "ß Ä"), (13, "ß ä")]
    rows += rows[:3]
    assert got(oj.shingle_components(frame(spark, rows))) == brute(rows)


def test_sketches_bound_the_difference():
    r = np.random.default_rng(5)
    for n in (1, 3, 200, 900, 40_000):
        x = np.unique(r.integers(0, 1 << 62, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[r.random(len(x)) < 0.9], r.integers(0, 1 << 62, n // 9, dtype=np.uint64)]))
        one, other = oj.sketch(x), oj.sketch(y)
        apart = len(np.setxor1d(x, y))
        for size in (64, min(len(one), len(other))):
            assert int(np.bitwise_count(oj.folded(one, size) ^ oj.folded(other, size)).sum()) <= apart


def test_chains_are_followed_and_the_threshold_is_exact(spark):
    words = [f"w{k}" for k in range(102)]  # 100 shingles
    rows = [(1, " ".join(words))]
    # 100 * 90 of 100 (subset of 90 shingles) links, 89 does not
    rows += [(2, " ".join(words[:92])), (3, " ".join(words[11:]))]
    chain = [f"c{k}" for k in range(400)]
    rows += [(100 - k, " ".join(chain[10 * k : 10 * k + 202])) for k in range(15)]
    want = brute(rows)
    assert got(oj.shingle_components(frame(spark, rows))) == want
    assert {(2, 90, 1), (3, 89, 3)} <= set(want) and sum(c == 86 for *_, c in want) == 15


def test_long_texts_and_empty_tables(spark):
    long = " ".join(f"v{k % 70_000}" for k in range(200_000))
    rows = [(4, long), (3, long + " more words here"), (2, "x " * 300_000), (1, "x " * 200_000 + "y")]
    assert got(oj.shingle_components(frame(spark, rows))) == brute(rows)
    assert got(oj.shingle_components(frame(spark, []))) == []
    assert got(oj.shingle_components(frame(spark, [(1, None), (2, "")]))) == [(1, 0, 1), (2, 0, 2)]


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op13_occurrence_jaccard_join"](spark, "/root/testdata/sf0.001")) == brute(rows)
