"""Spelling variants against a brute-force search over all pairs of words."""

import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import types as T

from pagemill.llm.queries import QUERIES
from pagemill.llm.spelling import one_edit, spelling_variants

ROW = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("word", T.StringType())])


def edits(a: str, b: str) -> int:
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def brute(rows, min_length=6, min_count=5, slips=True):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if slips and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and v != w and edits(v, w) == 1] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), form[w] and words[form[w]]))
    return out


def got(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], ROW)


def variants(word):
    yield from (word[:i] + word[i + 1 :] for i in range(len(word)))
    yield from (word[:i] + "zé"[i % 2] + word[i:] for i in range(len(word) + 1))
    yield from (word[:i] + "qÀ"[i % 2] + word[i + 1 :] for i in range(len(word)))


def test_one_edit():
    words = ["", "a", "ab", "ba", "abc", "acb", "abcd", "bcd", "abxd", "xbcd", "abcde", "aab", "aaab"]
    assert all(one_edit(a, b) == (edits(a, b) == 1) for a in words for b in words)


@pytest.mark.parametrize("shard", [16384, 8])
def test_against_brute_force(spark, shard):
    text = []
    for word, n in (("variant", 700), ("mentioned", 300), ("éclairs", 40)):
        text += [word] * n
        for k, v in enumerate(variants(word)):
            text += [v] * (5 + k % 3 * 20)
            if k % 7 == 0:
                text += [w for w in list(variants(v))[::5] for _ in range(6)]
    rows = [(7 * i, " ".join(text[i::11]) + ". Étude ÉTUDE aaaaaa aaaaaaa aaaaaab") for i in range(11)]
    rows += [(None, "aaaaaa aaaaaab-Variant,VARIANT"), (3, None), (4, ""), (5, "1 2 ,"), rows[0], rows[0]]
    want = brute(rows)
    assert got(spelling_variants(frame(spark, rows), shard=shard, slips=True)) == want
    assert any(r[2] != r[1] and r[1] for r in want), "no chain of forms"
    assert got(spelling_variants(frame(spark, rows), shard=shard)) == brute(rows, slips=False)


def test_ties_long_texts_and_empty_tables(spark):
    rows = [(1, "abcdef " * 5 + "abcdeg " * 25 + "abcdeh " * 25), (2, "longword " * 300_000 + "x" * 100_000)]
    out = {r[0]: r for r in got(spelling_variants(frame(spark, rows)))}
    assert out["abcdef"] == ("abcdef", "abcdeg", "abcdeg", 5, 2, 25)
    assert out["longword"][3] == 300_000
    assert got(spelling_variants(frame(spark, []))) == set()
    assert got(spelling_variants(frame(spark, [(1, None), (2, "ab cd")]))) == set()


def test_query_against_brute_force(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id < 120")
    source.write.parquet(str(tmp_path / "documents.parquet"))
    rows = [(r.doc_id, r.text) for r in source.collect()]
    want = brute(rows)
    assert want and got(QUERIES["op11_spelling_variants"](spark, str(tmp_path))) == want
