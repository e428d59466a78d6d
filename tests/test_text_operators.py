"""Sections, budgets, claims, links, hashes, histories and sources on small inputs."""

import hashlib
import math
import re

from pyspark.sql import functions as F

from pagemill.functions import integrity as I
from pagemill.functions import text as T
from pagemill.operators import claims as A
from pagemill.operators import compile as C
from pagemill.operators import links as L
from pagemill.operators import rank as R
from pagemill.operators import receipts
from pagemill.operators import sections as S
from pagemill.sources import web as W

DOC = "intro\n# Guide\ntext\n## Install {#setup}\nrun it\n### Install\nagain\n## Install\nthird\n# Table of contents\n[a](b) [c](d)"


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_section_index():
    got = [(s["ordinal"], s["level"], s["anchors"], s["parent"], s["index_like"]) for s in S.section_index(DOC)]
    assert got == [
        (0, 0, ["document"], -1, False), (1, 1, ["guide"], -1, False), (2, 2, ["setup"], 1, False), (3, 3, ["install"], 2, False),
        (4, 2, ["install-2"], 1, False), (5, 1, ["table-of-contents"], -1, True),
    ]
    assert S.section_index("") == [] and S.section_index(None) == []


def test_section_selection():
    sections = S.section_index(DOC)
    assert S.select_section(sections, "", "setup")["ordinal"] == 2 and S.select_section(sections, "install-2")["status"] == "hit"
    assert S.select_section(sections, "contents")["ordinal"] != 5
    assert S.select_section(sections, "nothing here")["status"] == "miss"
    rust = S.section_index("# Rust\nRust is a language for systems.\n# Other\nrust rust")
    assert "definitional_answer" in S.rank_sections(rust, "rust")[0]["reasons"]


def test_chunks_carry_their_headings():
    got = S.chunks("# A\nx\n### C\ny\n## B\n" + "z" * 2100 + "\nend")
    assert [c["headers"] for c in got] == [["A"], ["A", "C"], ["A", "B"], ["A", "B"]] and got[3]["text"] == "end"


def test_budget_never_overflows():
    text = "\n".join(f"line {i} with [a link](http://e.org/{i}) and then a good many more words that follow here" for i in range(200))
    for budget in (40, 128, 400):
        for query in (None, "link", "zebra"):
            out, how = C.budgeted(text, budget, query)
            assert C.estimate(out) <= budget and how == {None: "head_safe", "link": "focus_window", "zebra": "sandwich"}[query]
            assert out.count("[a link](") == out.count("with [a")
    assert C.budgeted("short", 100) == ("short", None) and C.budgeted(None, 100) == ("", None)


def test_pruning_keeps_what_is_asked():
    filler = "these words speak of weather and other matters without any bearing at all"
    text = "\n\n".join(["# Doc", f"alpha {filler}", "## Queues", f"the scheduler uses queues and work stealing {filler}", f"beta {filler}", "Subscribe to our newsletter for more of this every single week"])
    out = C.prune_paragraphs(text, "scheduler queues")
    assert "work stealing" in out and "newsletter" not in out and "beta" not in out
    assert C.prune_paragraphs("a\n\nb") == "a\n\nb" and C.prune_paragraphs(None) == ""


def test_claims():
    cases = [
        ("SQLite is a database", ["SQLite is a small database engine."], "supported"), ("SQLite is a database", ["SQLite is not a database."], "contradicted"),
        ("SQLite is a database", ["SQLite is a library."], "contradicted"), ("SQLite is a database", ["Databases such as SQLite store rows."], "unsupported"),
        ("App uses Redis", ["The app uses redis for queues."], "supported"), ("App uses Redis", ["The app does not use redis."], "contradicted"),
        ("Hello there", ["text"], "unknown"), ("SQLite is a database", [], "unsupported"), ("SQLite is a database", [None, ""], "unsupported"),
    ]
    assert [A.claim_status(c, b) for c, b, _ in cases] == [want for *_, want in cases]
    assert A.claim_status("x is y", [], complete=False) == "unknown"


def test_block_scores(spark):
    blocks = F.array(*[F.lit(x) for x in ("The quick brown fox", "a brownish dog", "nothing")])
    got = one(spark, R.block_scores(blocks, ["brown", "fox"])).c0
    assert [s.matched for s in got] == [2, 1, 0] and got[0].score > got[1].score > got[2].score == 0


def test_soft_terms_and_focus(spark):
    pairs = [("configuration", "configure", True), ("con", "configuration", False), ("asynchronous", "asyncio", True), ("cat", "cat", True), ("abcde", "abcdx", False)]
    row = one(spark, *[T.soft_equal(F.lit(a), F.lit(b)) for a, b, _ in pairs])
    assert list(row) == [w for *_, w in pairs]
    row = one(spark, R.focus_match(F.lit("See [the configured server](/database)"), "config databases quickly server").alias("m"))
    assert (row.c0.tier, row.c0.hits) == ("partial", 3)


def test_links_prefer_what_is_named(spark):
    links = F.array(*[
        F.struct(F.lit(f"http://h{p}").alias("url"), F.lit(p).alias("path"), F.lit(t).alias("title"))
        for p, t in (("/library/asyncio.html", "asyncio — event loop"), ("/whatsnew/3.12/", "What's new"), ("/tutorial/events", "Events and loops"))
    ])
    got = one(spark, L.link_scores(links, "asyncio event loop")).c0
    assert got[0].total > got[2].total > got[1].total and got[0].total >= L.STRONG_HIT
    assert L.decompose('how does "work stealing" use pkg.mod')["primary"] == ["work stealing", "pkg.mod", "does"]


def test_merkle(spark):
    leaves = [hashlib.sha256(bytes([i])).hexdigest() for i in range(7)]

    def root(nodes):
        while len(nodes) > 1:
            nodes = [hashlib.sha256(bytes.fromhex(nodes[i] + nodes[min(i + 1, len(nodes) - 1)])).hexdigest() for i in range(0, len(nodes), 2)]
        return nodes[0] if nodes else None

    for n in range(8):
        array = F.array(*[F.lit(x) for x in leaves[:n]]).cast("array<string>")
        assert one(spark, I.merkle_root(array)).c0 == root(leaves[:n])
        for k in range(n):
            path = I.merkle_proof(array, F.lit(k))
            assert list(one(spark, I.verify_proof(F.lit(leaves[k]), path, I.merkle_root(array)), I.verify_proof(F.lit("00" * 32), path, I.merkle_root(array)))) == [True, False]


def test_ordered_root_does_not_depend_on_cutting(spark, monkeypatch):
    rows = spark.range(0, 75, 1, 6).select("id", F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    whole = receipts.ordered_root(rows, ["id"], "leaf")
    monkeypatch.setattr(receipts, "SUBTREE", 8)
    assert receipts.ordered_root(rows.repartition(3), ["id"], "leaf") == whole
    assert receipts.ordered_root(rows.limit(0), ["id"], "leaf") is None


def test_signed_manifest(spark):
    signer = receipts.Signer(spark)
    text = receipts.manifest(spark, "2024-01-01T00:00:00Z", 3, "ab", signer.key_id())
    signature = signer.sign(text)
    assert len(signature) == 64 and signer.verify(text, signature) and not signer.verify(text + " ", signature)


def test_capsules(spark):
    for payload in ("", "a", "é" * 50, '{"x":1}'):
        row = one(spark, receipts.open_capsule(receipts.capsule(F.lit(payload))), receipts.open_capsule(F.lit("other:abc")))
        assert row.c0 == (payload or None) and row.c1 is None


def test_robots_groups(spark):
    body = "User-agent: a\nUser-agent: *\nDisallow: /x\nCrawl-delay: 2\n\nUser-agent: b\nDisallow: /y"
    row = one(spark, W.robots_rules(F.lit(body)), W.robots_rules(F.lit("")))
    assert (row.c0.disallow, row.c0.delay, row.c1.disallow) == (["/x"], 2.0, [])


def test_atom_links(spark):
    entry = '<feed><entry><title>A &amp; B</title><link rel="self" href="/s"/><link rel="alternate" href="/a"/><updated>2024</updated><summary>&lt;b&gt;hi</summary></entry></feed>'
    item = one(spark, W.rss_items(F.lit(entry))).c0[0]
    assert (item.title, item.link, item.published) == ("A & B", "/a", "2024")


def test_private_addresses(spark):
    urls = ["http://10.1.1.1/", "http://[::1]/", "http://[fe80::1]/", "https://8.8.8.8/", "ftp://h/", "http://localhost:80/", "http://a.internal/"]
    row = one(spark, *[W.url_privacy(F.lit(u)) for u in urls])
    assert list(row) == ["private_ip", "private_ip", "private_ip", "public", "bad_scheme", "localhost", "internal_name"]


def test_estimates_look_at_few_letters(spark):
    texts = ["", " ", "abc", "abcde", "stra\u00dfe", "\u00e9" * 7, "\u65e5\u672c\u8a9e x", "\u20ac\u20ac\u20ac", "\U0001f600a\u00e9\u3042", "\u4e00", "\n\u0416", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.token_estimate(F.col("t")).alias("n"))
    full = lambda c: 1.0 if re.match("[\u4e00-\u9fff\u3400-\u4dbf\u3040-\u30ff\uac00-\ud7a3\uf900-\ufaff]", c) or ord(c) > 0xFFFF else 0.25 if ord(c) < 128 else 0.5
    for r in df.collect():
        assert r.n == math.ceil(sum(map(full, r.t or ""))), r.t
    # ASCII is passed over in runs, not letter by letter, and the rest is looked at once
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 3


def test_focus_takes_out_only_tokens_that_may_match(spark):
    texts = ["the configuring of pourX", "xthat ecpour", "ÉTHAT that9 estionary", "[that](http://x/pouring) con", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", R.focus_match(F.col("t"), "that configuration pour estion").alias("f"))
    assert [(r.f.hits, r.f.tier) for r in df.collect()] == [(2, "none"), (0, "none"), (2, "none"), (2, "none"), (0, "none"), (0, "none")]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "{3,}" not in plan and "(?=[ce" in plan
