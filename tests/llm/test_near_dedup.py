import random
import time
from collections import Counter, defaultdict
from math import log1p

import numpy as np
from pyspark.sql import functions as F

from pagemill.llm import near_dedup, shingles
from pagemill.llm.common import free_shuffles, materialize
from pagemill.llm.components import connected_components
from pagemill.llm.shingles import words


def brute_classes(docs, similarity=0.8):
    """Weighted Jaccard of all pairs, then union-find; returns doc -> least doc of its class."""
    grams = {}
    for i, t in docs.items():
        w = words(t)
        n = min(5, len(w))
        grams[i] = Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else Counter({(): 1})
    df = Counter(g for c in grams.values() for g in c)
    floor = max(1, sum(len(c) for c in grams.values() if () not in c) / near_dedup.HEAVY, len(docs) * near_dedup.RARE_SHARE)
    weight = {g: log1p(len(docs) / max(n, floor)) for g, n in df.items()}
    total = {i: sum(n * weight[g] for g, n in c.items()) for i, c in grams.items()}
    parent = {i: i for i in docs}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i in sorted(docs):
        shared = Counter()
        for g, n in grams[i].items():
            for j, m in holders[g]:
                shared[j] += min(n, m) * weight[g]
            holders[g].append((i, n))
        for j, s in shared.items():
            if s >= similarity * (total[i] + total[j] - s) * (1 - 1e-12):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in docs}


def vocabulary(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def test_classes_equal_brute_force(spark):
    rng = random.Random(4)
    vocab = vocabulary(rng, 500)
    passage = " ".join(rng.choice(vocab) for _ in range(200))
    docs = {}
    for i in range(150):
        docs[len(docs)] = " ".join(rng.choice(vocab) for _ in range(rng.randint(3, 120)))
    for i in range(60):  # share a long passage, about 0.6 to 0.8 similar
        docs[len(docs)] = passage + " " + " ".join(rng.choice(vocab) for _ in range(rng.randint(30, 60)))
    base = " ".join(rng.choice(vocab) for _ in range(150)).split()
    for i in range(60):  # near copies
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = rng.choice(vocab)
        docs[len(docs)] = " ".join(copy)
    docs |= {len(docs): "", len(docs) + 1: None, len(docs) + 2: "one two", len(docs) + 3: "One, two!", len(docs) + 4: "..."}
    rows = [(i, t, "x", 1) for i, t in docs.items()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, `__class` string, uid int").repartition(4)
    got = {r.doc_id: (r.class_id, r.class_size) for r in near_dedup.near_duplicates(df).collect()}
    want = brute_classes(docs)
    sizes = Counter(want.values())
    assert got == {i: (c, sizes[c]) for i, c in want.items()}
    kept = near_dedup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_null_ids_repeats_and_empty(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(None, text), (7, text), (7, text), (None, "z y x")], "doc_id bigint, text string")
    got = sorted((r.doc_id is None, r.class_id if r.class_id >= 0 else -1, r.class_size) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(False, 7, 3), (False, 7, 3), (True, -1, 1), (True, 7, 3)]
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_document_frequencies_are_exact(spark):
    """Every frequency is told apart, those of a single document and those under a hundredth of all among them."""
    rng = random.Random(9)
    vocab = vocabulary(rng, 60)
    passages = [" ".join(rng.choice(vocab) for _ in range(12)) for _ in range(6)]
    # passage k stands in 2**k documents of 400
    docs = [" ".join([*(p for k, p in enumerate(passages) if i < 2**k), *(rng.choice(vocab) for _ in range(20))]) for i in range(400)]
    rng.shuffle(docs)
    df = spark.createDataFrame([(i >> 3, t) for i, t in enumerate(docs)], "slice bigint, text string").repartition(5, "slice").sortWithinPartitions("slice")
    want = Counter(item for t in docs for item in near_dedup.shingles(words(t))[0].view("int64").tolist())
    got = {}
    for r in near_dedup.document_frequencies(df).collect():
        for item, n in zip(memoryview(r["items"]).cast("q"), memoryview(r["df"]).cast("i"), strict=True):
            assert got.setdefault((r["slice"], item), n) == n
    held = {(i >> 3, item) for i, t in enumerate(docs) for item in near_dedup.shingles(words(t))[0].view("int64").tolist()}
    assert got == {(s, item): want[item] for s, item in held if want[item] > 1}
    assert {1, 2, 4, 8, 16, 32} <= set(want.values())


def test_rare_shingles_weigh_by_their_frequency(spark):
    """Two texts whose common part others share: 0.84 similar if all rare shingles weigh alike, 0.78 by plain TF-IDF."""
    rng = random.Random(3)
    vocab = vocabulary(rng, 5000)
    base = [rng.choice(vocab) for _ in range(100)]
    near = base[:93] + [rng.choice(vocab) for _ in range(10)]
    docs = {i: " ".join(rng.choice(vocab) for _ in range(30)) for i in range(1000)}
    docs |= {1000: " ".join(base), 1001: " ".join(near)} | {1002 + i: " ".join(base[:90] + [rng.choice(vocab) for _ in range(60)]) for i in range(7)}
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute_classes(docs)
    assert got[1000] != got[1001]


def test_a_shuffle_is_freed_as_soon_as_its_plan_is_let_go(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = blocks.getAllFiles()
        names = [files.apply(k).getName() for k in range(files.size())]
        return {n for n in names if n.startswith("shuffle_")}

    before = shuffles()
    grouped = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.collect_list("id").alias("ids"))
    materialize(grouped, "grouped")
    made = shuffles() - before
    del grouped
    free_shuffles(spark)
    end = time.time() + 10
    while made & shuffles() and time.time() < end:
        time.sleep(0.2)
    assert made and not made & shuffles()


def test_samples_are_found_among_few_candidates(monkeypatch):
    """The same bands as from all shingles, whatever their weights, of a fraction of the variates."""
    sampler = near_dedup.Sampler(float(log1p(1e5)))
    made = []
    plain = near_dedup.Sampler._log_a

    def counted(self, *args):
        made.append(plain(self, *args))
        return made[-1]

    monkeypatch.setattr(near_dedup.Sampler, "_log_a", counted)
    rng = np.random.default_rng(5)
    for n in (1, 7, 40, 300, 3000, 20000):
        items = np.sort(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        for most_df, most_tf in ((1, 1), (2, 1), (5000, 1), (50, 9)):
            df = rng.integers(min(most_df, 2), most_df + 1, n)
            weights = rng.integers(1, most_tf + 1, n) * np.log1p(1e5 / df)
            made.clear()
            few = sampler.bands(items, weights)
            if n >= 300 and most_tf == 1:
                assert sum(x.size for x in made) < n * 64 / 4
            monkeypatch.setattr(near_dedup, "CANDIDATES", 1e9)
            assert few.tolist() == sampler.bands(items, weights).tolist()
            monkeypatch.setattr(near_dedup, "CANDIDATES", 8)


def test_words_are_numbered_at_once(monkeypatch):
    """As many numbers as words, equal for equal words only, wherever a block ends."""
    odd = "Straße STRASSE naïve_x été\u0301 \u0130I ΟΔΟΣ Οδός 日本 語 𝔸b a1_2 ² ½ \ud800 ab ba aab aba baa _ __ 0 00 \x00 a\x00b"
    texts = [None, "", "...", "a", odd, " ".join([odd] * 9) + "." + "x" * 100 + " end", "x" * 99]
    for block in (1 << 15, 8, 1):
        monkeypatch.setattr(shingles, "BLOCK", block)
        of = {}
        for text in texts:
            numbers, seq = shingles.text_numbers(text).tolist(), words(text)
            assert len(numbers) == len(seq) and numbers == shingles.word_numbers(seq).tolist()
            assert all(of.setdefault(w, n) == n for w, n in zip(seq, numbers))
        assert len(set(of.values())) == len(of)
