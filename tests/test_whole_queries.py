"""Queries over all rows, against plain Python on small tables."""

import hashlib
import random
import re

from pagemill import queries
from pagemill.operators import receipts


def save(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def root(leaves):
    while len(leaves) > 1:
        pairs = [leaves[i : i + 2] for i in range(0, len(leaves), 2)]
        leaves = [hashlib.sha256(bytes.fromhex(p[0]) + bytes.fromhex(p[-1])).hexdigest() for p in pairs]
    return leaves[0]


def test_digest_of_all_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(receipts, "SUBTREE", 8)
    rows = [(i * 7, ["hot", "hot", "b", None][i % 4] if i else "one", f"text {i} " * 40 + ("That" if i % 3 == 0 else "")) for i in range(300)]
    folder = save(spark, tmp_path, "documents", [*rows, (5000, "b", None)], "doc_id bigint, source string, text string")
    got = {r.source: (r.pages, r.focused, r.combined) for r in queries.QUERIES["digest_combined"](spark, folder).collect()}
    want = {}
    for source in ("one", "hot", "b", None):
        of = [(d, t) for d, s, t in rows if s == source]
        leaves = [hashlib.sha256(f"## {d}\n\n{t}".encode()).hexdigest() for d, t in of]
        want[source] = (len(of), sum("that" in t.lower() for _, t in of), root(leaves))
    assert got == want


def collected(df):
    return "collect_list" in df._jdf.queryExecution().optimizedPlan().toString()


def test_latency_holds_no_whole_engine(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.randrange(9), rng.choice(["hot", "hot", "hot", "b", None]), i, rng.choice([None, 5.0, float(rng.randrange(40)), rng.random() * 99])) for i in range(900)]
    folder = save(spark, tmp_path, "events", rows, "event_id bigint, user_id bigint, event_type string, ts bigint, value double")
    df = queries.QUERIES["engine_latency"](spark, folder)
    assert not collected(df)
    seen, values = set(), {}
    for _, user, kind, _, value in rows:
        if (user, kind) in seen and value is not None and value > 5:
            values.setdefault(kind, []).append(value)
        seen.add((user, kind))
    want = {}
    for kind, v in values.items():
        v.sort()
        want[kind] = (*(v[min(len(v) - 1, int(len(v) * p))] for p in (0.5, 0.95)), v[0], len(v))
    assert {r.engine: (r.p50, r.p95, r["least"], r.runs) for r in df.collect()} == want


def test_sitemap_takes_fifty_before_it_is_built(spark, tmp_path):
    urls = [f"http://hot.net/{i % 70}?a=1&b=2" for i in range(300)] + ["http://www.b.net/x", "http://b.net/y", None]
    folder = save(spark, tmp_path, "pages", [(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    df = queries.QUERIES["sitemap"](spark, folder)
    assert {r.host: r.urls for r in df.collect()} == {"hot.net": 50, "b.net": 2}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("collect_list") < plan.index("WindowGroupLimit")


def test_feeds_of_all_documents(spark, tmp_path):
    rows = [(i * 7, ["hot", "hot", "b", None][i % 4], f"text {i} " * (900 if i % 50 == 0 else 30)) for i in range(500)]
    folder = save(spark, tmp_path, "documents", rows, "doc_id bigint, source string, text string")
    want = []
    for source in ("hot", "b", None):
        of = [(d, t) for d, s, t in rows if s == source][:200]
        want += [(source or "", f"T & {d}", f"http://h/{d}", "2024", " ".join(f"a < b {t}".split())[:4000].strip()) for d, t in of]
    got = [(r.source, r.title, r.link, r.published, r.summary.strip()) for r in queries.QUERIES["feed_items"](spark, folder).collect()]
    assert sorted(got) == sorted(want) and max(len(r[4]) for r in want) >= 3999
    lines = {r.source: r.lines for r in queries.QUERIES["feed_markdown"](spark, folder).collect()}
    assert lines == {"hot": 402, "b": 2 + 2 * 125, "": 2 + 2 * 125}


def test_chains_of_all_keys(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.choice([3, 3, 150, 700, 9000]), rng.choice(["a", "b", None]), rng.randrange(300)) for i in range(600)]
    folder = save(spark, tmp_path, "events", rows, "event_id bigint, user_id bigint, event_type string, ts bigint")
    want = {}
    for user in {r[1] for r in rows}:
        kinds = [k for _, _, k in sorted((ts, i, k) for i, u, k, ts in rows if u == user)]
        n = sum(1 for j, k in enumerate(kinds) if j == 0 or k is None or k != kinds[j - 1])
        want[user] = (n, True, n < 3)
    assert {r.user_id: (r.entries, r.intact, r.forged) for r in queries.QUERIES["history_chain"](spark, folder).collect()} == want


def test_no_document_is_left_out_by_its_shape(spark, tmp_path):
    texts = ["word " * 10, "\n".join(["long line " * 50] * 12), "x" * 5000, "# head\n" + "y" * 9000, "é" * 100, "é" * 700, "", None]
    rows = [(i, texts[i % 8] and texts[i % 8] + f" {i}") for i in range(48)]
    folder = save(spark, tmp_path, "documents", rows, "doc_id bigint, text string")
    whole = {i: t for i, t in rows if t is not None}
    assert {r.doc_id: r.strategy for r in queries.QUERIES["budget_strategy"](spark, folder).collect()} == {
        i: "cut" if sum(1 if c.isascii() else 2 for c in t) > 800 else "none" for i, t in whole.items()
    }
    got = {r.doc_id: (r.passes, r.body) for r in queries.QUERIES["plain_text"](spark, folder).collect()}
    want = {}
    for i, t in whole.items():
        x = "# " + t if i % 6 == 0 else "\x07" * 400 + t if i % 6 == 1 else t
        body = x if re.search(r"(?m)^(#{1,6} |[-*] |```|\d+\. |\|)", x) else f"```\n{x}\n```"
        want[i] = (i % 6 != 1, hashlib.sha256(body.encode()).hexdigest())
    assert got == want
    chunks = {r.doc_id: r.chunks for r in queries.QUERIES["chunk_headings"](spark, folder).collect()}
    md = {r.doc_id: r.md for r in queries.QUERIES["chunk_headings"].__globals__["headed"](spark, folder).collect()}
    for i, t in md.items():
        n, held = 0, 0
        for line in t.split("\n"):
            if re.match(r"#{1,6}\s+.", line) and held:
                n, held = n + 1, 0
            held += len(line) + 1
            if held >= 2000:
                n, held = n + 1, 0
        assert chunks[i] == n + (held > 0)
    assert chunks.keys() == whole.keys()


def test_links_with_any_letters_count(spark, tmp_path):
    html = '<html><body><a href="/abc">one</a><a href="/a1-b">two</a><a href="/é/x_y">three</a><a href="/abc">one</a></body></html>'
    folder = save(spark, tmp_path, "pages", [(1, "http://h.net/", html)], "page_id bigint, url string, html string")
    assert [tuple(r) for r in queries.QUERIES["page_links"](spark, folder).collect()] == [(1, 3)]


def test_long_pages_are_counted_whole(spark, tmp_path):
    body = "".join(f"<p>part {k} {'x' * 9000 if k == 3 else ''}</p>" for k in range(450))
    html = f"<html><head><title>t</title></head><body><article><h1>t</h1>{body}</article></body></html>"
    folder = save(spark, tmp_path, "pages", [(1, "https://a.org/b", html)], "page_id bigint, url string, html string")
    assert queries.QUERIES["page_paragraphs"](spark, folder).first().paragraphs == 450
    assert queries.QUERIES["page_skeleton"](spark, folder).first().nodes == 453
    (form,) = queries.QUERIES["codec_bench"](spark, folder).filter("codec = 'markdown'").collect()
    assert form.chars == len("\n\n".join(["t", *(f"part {k} {'x' * 9000 if k == 3 else ''}".strip() for k in range(450))]))
