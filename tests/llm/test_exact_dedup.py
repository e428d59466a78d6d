import hashlib
import re
from collections import defaultdict

from pagemill.llm import exact_dedup


def test_against_brute_force(spark):
    long = "ab c" * 60_000
    texts = [
        "same", "same", "same ", "same  ", "same\t\n", " same", "", None, " ", "x" * 127, "x" * 128, "x" * 129, "x" * 128,
        long, long + "!", long, "é" * 600, "é" * 600, "é" * 599 + "e", "same",
    ]
    rows = [(len(texts) - i, t, "u", 1) for i, t in enumerate(texts)] + [(3, "same", "u", 1), (None, "same", "u", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, `__uid` string, kept int").repartition(5)
    groups = defaultdict(list)
    for doc, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(doc)
    want = []
    for t, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        sha = hashlib.sha256(t.encode()).hexdigest()
        want += [(i, ids[0], len(ids), k == 0, sha) for k, i in enumerate(ids)]
    got = [tuple(r) for r in exact_dedup.exact_classes(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    kept = exact_dedup.drop_exact_copies(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(w[0]) for w in want if w[3])


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert exact_dedup.exact_classes(df).count() == 0 and exact_dedup.drop_exact_copies(df).count() == 0
