"""Link rounds, tables as listings, canonical JSON, recipe status and skeletons on small inputs."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from pagemill.functions import integrity as I
from pagemill.operators import nodes as N
from pagemill.operators import records as R

URL = "https://example.org/docs/a"
EDGES = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (4, 5), (5, 6), (7, 7), (1, 2), (6, None), (None, 8)]


def reached(spark, starts, **options):
    edges = spark.createDataFrame(EDGES, "node int, next int")
    out = R.link_rounds(spark.createDataFrame(starts, "start int, node int"), edges, **options).collect()
    assert len(out) == len({(r.start, r.node) for r in out})
    return {(r.start, r.node): r.level for r in out}


def test_rounds_go_on_until_nothing_is_new(spark):
    want = {(1, 1): 0, (1, 2): 1, (1, 3): 1, (1, 4): 2, (1, 5): 3, (1, 6): 4, (7, 7): 0, (9, 9): 0}
    assert reached(spark, [(1, 1), (1, 1), (7, 7), (9, 9), (None, 1), (2, None)]) == want
    assert reached(spark, [(0, 2), (0, 5)]) == {(0, 2): 0, (0, 5): 0, (0, 4): 1, (0, 6): 1, (0, 1): 2, (0, 3): 3}
    assert reached(spark, [(1, 1), (5, 5)], rounds=2) == {(1, 1): 0, (1, 2): 1, (1, 3): 1, (1, 4): 2, (5, 5): 0, (5, 6): 1}
    none = spark.createDataFrame([], "start int, node int")
    assert R.link_rounds(none, spark.createDataFrame(EDGES, "node int, next int")).count() == 0


def test_a_round_goes_on_from_its_hubs(spark):
    edges = spark.createDataFrame([(0, k) for k in range(1, 6)] + [(k, 10 * k) for k in range(1, 6)], "node int, next int")
    starts = spark.createDataFrame([(0, 0)], "start int, node int")
    out = R.link_rounds(starts, edges, rounds=2, hubs=2, order="-node")
    assert {(r.node, r.level) for r in out.collect()} == {(0, 0), *((k, 1) for k in range(1, 6)), (50, 2), (40, 2)}


def test_listings_in_tables_become_records(spark):
    html = (
        "<table><tr><td>1.</td><td><a href='/s'>A <b>story</b></a> (s.net)<td></tr><tr><td>9 points by me 3 hours ago | 4 comments</td></tr><tr><td> </td></tr>"
        "<tr><td>2.<td><a href='/t'>Other</a></tr><tr><td>1 point by you 1 day ago | discuss</tr></table><table><tr><td>alone</td></tr></table>"
    )
    df = spark.createDataFrame([(5, URL, html), (6, URL, "<p>none</p>"), (7, URL, None)], "page_id int, url string, html string")
    rows = R.table_rows(N.page_nodes(df))
    (r,) = [x for x in rows.select("page_id", R.paired_records(F.col("rows")).alias("r")).collect() if x.r]
    assert r.page_id == 5 and rows.count() == 2
    got = [(x.rank, x.title, x.url, x.site, x.author, x.points, x.comments, x.age) for x in r.r]
    assert got == [
        ("1", "A story", "https://example.org/s", "s.net", "me", 9, 4, "3 hours ago"), ("2", "Other", "https://example.org/t", "example.org", "you", 1, 0, "1 day ago"),
    ]


VALUE = {"b": [1, {"z": None, "a": "é\n\"/"}], "a": {"y": True, "x": 1.5}, "provenance": {"by": "me"}, "c": {"provenance": 1}, "": ""}


def shuffled(value, turn):
    if isinstance(value, dict):
        keys = sorted(value, reverse=turn % 2 == 0)
        return {k: shuffled(value[k], turn + 1) for k in keys}
    return [shuffled(v, turn) for v in value] if isinstance(value, list) else value


def test_canonical_json_has_one_form(spark):
    texts = [json.dumps(shuffled(VALUE, t), ensure_ascii=t > 1, indent=t) for t in range(3)]
    changed = [json.dumps(VALUE | {"a": {"y": True, "x": 1.25}}), json.dumps(VALUE | {"b": [{"z": None, "a": "é\n\"/"}, 1]}), json.dumps(VALUE | {"c": {}})]
    other = [json.dumps(VALUE | {"provenance": 5})]
    bad = [None, "", "[1]", "3", "{", '{"a":1,"a":2}']
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts + changed + other + bad)], "k int, t string")
    out = df.select("k", I.canonical_json(F.col("t"), "provenance").alias("c"), I.recipe_hash(F.col("t")).alias("h")).orderBy("k").collect()
    bare = {k: v for k, v in VALUE.items() if k != "provenance"}
    want = json.dumps(bare, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert out[0].c == want and out[0].h == "sha256:" + hashlib.sha256(want.encode()).hexdigest()
    assert {r.h for r in out[:3]} == {out[0].h} and out[6].h == out[0].h
    assert len({r.h for r in out[:6]}) == 4
    assert [r.h for r in out[7:]] == [None] * 6


@pytest.mark.parametrize(("change", "valid", "status", "version"), [
    ({}, True, "verified", 1), ({"sigScheme": I.RECIPE_V2}, True, "verified", 2), ({"keyId": "k2"}, True, "key_mismatch", 1), ({}, False, "invalid", 1),
    ({"keyId": "k2"}, False, "wrong_key", 1), ({"contentHash": "sha256:0"}, True, "invalid", 1), ({"sigScheme": "other"}, True, "unsupported_version", None),
    ({"signature": None}, True, "unsigned", None), ({"contentHash": None}, True, "invalid", 1),
])
def test_recipe_status(spark, change, valid, status, version):
    body = {"url": "u", "a": [1]}
    told = "sha256:" + hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    provenance = {"keyId": "k1", "contentHash": told, "signature": "s", "verify": {"score": 7, "passesGate": True}} | change
    text = json.dumps(body | {"provenance": {k: v for k, v in provenance.items() if v is not None}})
    row = spark.createDataFrame([(text, "k1", valid)], "t string, k string, v boolean").select(I.recipe_status(F.col("t"), F.col("k"), F.col("v")).alias("s")).first().s
    assert (row.status, row.version) == (status, version)
    assert (row.score, row.passes_gate) == ((None, None) if status == "unsigned" else (7, True))


def test_recipes_that_cannot_be_read_are_unsigned(spark):
    rows = [(None,), ("{",), ("[]",), ('{"provenance":3}',), ('{"a":1}',)]
    df = spark.createDataFrame(rows, "t string").select(I.recipe_status(F.col("t"), F.lit("k"), F.lit(True))["status"].alias("s"))
    assert [r.s for r in df.collect()] == ["unsigned"] * 5


def test_assertions_leave_out_what_is_not_known(spark):
    args = [F.lit("k"), F.lit("h"), F.lit("2024-01-01T00:00:00Z"), F.lit(None).cast("int"), F.lit(True), F.lit(0.5)]
    text = spark.range(1).select(I.recipe_assertion(*args).alias("t")).first().t
    assert text == 'playbook-sig-v2\n{"alg":"ecdsa-p256-sha256","contentHash":"h","keyId":"k","signedAt":"2024-01-01T00:00:00Z","v":2,"verify":{"noiseLeakage":0.5,"passesGate":true}}'


def plain_walk(rows, most, deepest):
    """The same tree by a walk: (pos, depth) of the elements in order."""
    kept, body = [], next((r for r in rows if r[5] == "body"), None)
    for r in rows:
        if body and body[0] <= r[0] <= body[1] and r[8] is None and len(kept) < most:
            path = [t for _, t, _ in r[9]]
            depth = len(path) - len(body[9])
            if depth <= deepest and not set(path) & {"script", "style", "noscript", "svg", "path", "link", "meta"}:
                kept.append((r[0], depth))
    return kept


def test_skeletons_are_bounded_trees(spark):
    from pagemill.functions.markup import tokenize

    deep = "<body>" + "<div>" * 30 + "x" + "</div>" * 30 + "<p>after</p>"
    wide = "<html><body><main id=content role=main class='a b c d'><h1>T</h1>" + f"<p>{'word ' * 40}</p>" * 500 + "</main></body>"
    some = '<body><script>x</script><button aria-label=" go  on ">Go</button><div data-testid=t><svg><path></svg><i tabindex=0>a<b>b</b></i></div><a class="x y" href=/>' + "t" * 90 + "</a></body>"
    htmls = [deep, wide, some, None, "<p>no body"]
    df = spark.createDataFrame([(k, URL, h) for k, h in enumerate(htmls)], "page_id int, url string, html string")
    tree = N.skeleton(N.page_nodes(df))
    got = tree.collect()
    for k, html in enumerate(htmls):
        own = sorted((r.pos, r.depth) for r in got if r.page_id == k)
        assert own == plain_walk(tokenize(html, URL), 400, 12)
        assert all(r.parent is None or r.parent in {p for p, _ in own} for r in got if r.page_id == k)
    named = {(r.tag, r.test_id): r for r in got if r.page_id == 2}
    assert named["button", None].aria == "go on" and named["button", None].text == "Go" and named["button", None].interactive
    assert named["i", None].text is None and named["i", None].interactive and not named["b", None].interactive
    assert named["a", None].text == "t" * 80 + "…" and named["a", None].classes == ["x", "y"]
    best = {r.page_id: (r.selector, r.score) for r in N.main_candidates(tree).collect()}
    assert best == {1: ("#content", 1.0)}
