import random

from pagemill.llm.decontaminate import contaminated, drop_contaminated, tiles, words


def brute_tiles(test, doc, shortest):
    """Greedy string tiling by its definition: again and again all longest matches of unmarked words."""
    t, d, out = [False] * len(test), [False] * len(doc), 0
    while True:
        best = []
        for i in range(len(test)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(test) and j + n < len(doc) and test[i + n] == doc[j + n] and not t[i + n] and not d[j + n]:
                    n += 1
                if n >= shortest and (not best or n >= best[0][0]):
                    best = [(n, i, j)] if not best or n > best[0][0] else [*best, (n, i, j)]
        if not best:
            return out
        for n, i, j in best:
            if not any(t[i : i + n]) and not any(d[j : j + n]):
                t[i : i + n] = d[j : j + n] = [True] * n
                out += n


def test_tiles_cover_as_much_as_brute_force():
    rng = random.Random(7)
    for _ in range(300):
        test = [rng.randrange(40) for _ in range(rng.randint(5, 40))]
        doc = [rng.randrange(40) for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(test))
            doc[rng.randrange(len(doc) + 1) :] = test[i : i + rng.randint(3, 20)]
        found = tiles(test, doc, 5)
        assert all(test[i : i + n] == doc[j : j + n] and n >= 5 for i, j, n in found)
        for side, size in ((0, len(test)), (1, len(doc))):
            marked = [k for m in found for k in range(m[side], m[side] + m[2])]
            assert len(marked) == len(set(marked)) and all(k < size for k in marked)
        assert sum(n for *_, n in found) == brute_tiles(test, doc, 5)


def test_reordered_passages_and_edges(spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(400)]
    item = [rng.choice(vocab) for _ in range(40)]
    filler = [f"z{k}" for k in range(30)]
    docs = [
        " ".join(filler + item + filler), " ".join(item[20:] + filler + item[:20]).upper(), " ".join(item[:30]),
        " ".join(filler), "", None, "x " + ", ".join(item[:36]), "Tiny test", " ".join(item[::-1]),
    ]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(docs)], "doc_id bigint, text string, coverage double")
    test = spark.createDataFrame([(1, " ".join(item)), (2, "tiny TEST!"), (3, ""), (4, None)], "item_id bigint, text string")
    want = {(0, 1): 1.0, (1, 1): 1.0, (6, 1): 0.9, (7, 2): 1.0}
    for block in (1 << 20, 1):  # one block, and a block for each item
        got = contaminated(df.repartition(3), test, block_words=block).collect()
        assert {(r.doc_id, r.item_id): round(r.coverage, 6) for r in got} == want
        for r in got:
            w = words(docs[r.doc_id])
            for t in r.tiles:
                assert w[t.doc_word : t.doc_word + t.words] == words({1: " ".join(item), 2: "tiny test"}[r.item_id])[t.item_word : t.item_word + t.words]
    kept = drop_contaminated(df, test)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5, 8]
    assert contaminated(df.limit(0), test).count() == 0 and contaminated(df, test.limit(0)).count() == 0
    assert drop_contaminated(df, test.limit(0)).count() == len(docs)
