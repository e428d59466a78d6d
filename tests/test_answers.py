"""Golden cases of operators without SQL, and edges of those with it."""

from pyspark.sql import functions as F

from pagemill.operators import access, answers, playbooks, reconcile
from pagemill.operators.compile import estimate


def test_focus_cut_keeps_the_answer_unit_first():
    filler = "Other words stand here and fill the room. " * 6
    text = f"## Lamps\n\n{filler}\n\nA lamp is any device that gives light.\n\n- oil\n- gas\n\n```\nlamp()\n```\n\n{filler}"
    cut = answers.focus_cut(text, 110, "lamp device")
    assert estimate(cut) <= 110 and cut.startswith("## Lamps") and "- oil" in cut and "is any device" in cut
    assert answers.focus_cut(text, 10_000, "lamp") == text and answers.focus_cut("", 10, "x") == "" and answers.focus_cut(None, 10, "x") == ""
    tiny = answers.focus_cut("word " * 500, 20, "lamp")
    assert estimate(tiny) <= 20 + estimate("\n\n<!-- SNIP: tail (reason: head_safe) -->")


def test_block_weights():
    assert answers.block_weight("```\nx\n```", "lamp") == 0 and answers.block_weight("```\nx\n```", "abc") == 3
    assert answers.block_weight("A lamp is any light", "lamp") == 16 and answers.block_weight("It is a chair", "lamp") == 6
    assert answers.block_weight("lamps refers to lights", "lamps lights") == 11 and answers.block_weight("plain", "lamp") == 0


def test_anchor_is_kept_within_the_budget():
    anchor, body = "A closure is any piece of code. More of it follows.", "Body text. " * 60
    assert answers.keep_anchor("short", anchor, 100) == anchor + "\n\nshort"
    assert answers.keep_anchor("x A closure is any piece of code y", anchor, 100) == "x A closure is any piece of code y"
    cut = answers.keep_anchor(body, anchor, 90)
    assert cut.startswith(anchor) and estimate(cut) <= 90
    assert answers.keep_anchor("", anchor, 100) == anchor and answers.keep_anchor(None, None, 5) == ""


def test_completeness():
    source = "## Lamp\n\nA lamp is a light.\n\n- oil\n\n## Other\n\nnothing"
    assert answers.completeness(source, source, None, True) == {"focus": "not_requested", "completeness": "partial", "reason": None, "suggested": None}
    assert answers.completeness(source, source, "lamp", False)["completeness"] == "complete"
    assert answers.completeness(source, source, "lamp", True)["reason"] == "context_truncated"
    lost = answers.completeness(source, "## Lamp", "lamp", True)
    assert (lost["focus"], lost["completeness"], lost["reason"], lost["suggested"]) == ("hit", "incomplete", "focus_body_truncated", 128)
    assert answers.completeness(source, source, "zebra", False)["reason"] == "source_missing"


def test_spans_of_reordered_and_missing_blocks(spark):
    rows = [(["b", "a", "zz", "", None, "b"], "a b a b")]
    df = spark.createDataFrame(rows, "blocks array<string>, text string")
    spans = df.select(reconcile.surface_spans(F.col("blocks"), F.col("text")).alias("s")).first().s
    assert [tuple(s) if s else None for s in spans] == [(2, 3), (4, 5), None, None, None, (6, 7)]
    back = spark.createDataFrame([(["cd", "ab"], "ab cd")], "blocks array<string>, text string")
    assert [tuple(s) for s in back.select(reconcile.surface_spans(F.col("blocks"), F.col("text")).alias("s")).first().s] == [(3, 5), (0, 2)]


def test_blocks_survive_in_part(spark):
    blocks = ["first line kept\nsecond line gone\nthird line kept", "gone one\ngone two is\nlast line kept", "see [the docs](http://x) **now**", " ", None]
    compiled = "first line kept third line kept  last line\nkept see the docs now"
    df = spark.createDataFrame([(blocks, compiled)], "blocks array<string>, compiled string")
    got = df.select(reconcile.surviving_blocks(F.col("blocks"), F.col("compiled"), F.lit("other")).alias("s")).first().s
    assert [(r.pos, r.text) for r in got] == [(0, "first line kept\nthird line kept"), (2, blocks[2])]
    same = df.select(reconcile.surviving_blocks(F.col("blocks"), F.col("compiled"), F.col("compiled")).alias("s")).first().s
    assert [r.text for r in same] == blocks


def test_digest_inputs_with_errors(spark):
    rows = [("http://A.net\nhttp://a.net/", [("http://a.net/", None)]), ("", None), (None, None), ("ftp://x", None), ('["http://x/a", 5]', None), ("[]", None), ('{"a":1}', None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    got = {r.i: r.e for r in df.select("i", reconcile.digest_entries(F.col("t")).alias("e")).collect()}
    assert [got[i] and [tuple(e) for e in got[i]] for i in range(len(rows))] == [w for _, w in rows]


def test_access_edges(spark):
    pages = [
        (None, "http://a/x", "http://a/x", 200, ("unknown", "insufficient_access_evidence")), ("<p>x", "http://a/x", "http://a/x", 401, ("restricted", "http_401")),
        ("", "http://a/x", "http://a/login", 200, ("restricted", "redirected_to_login")),
        ('<input type="password"><input type="email">', "http://a/x", None, 200, ("restricted", "blocking_identity_ui")),
        ("<p>" + "words " * 200 + "oauth", "http://a/x", "http://a/x", 200, ("open", "usable_public_content,authentication_terminology_non_decisive")),
    ]
    df = spark.createDataFrame([(i, *p[:4]) for i, p in enumerate(pages)], "i int, html string, req string, final string, status int")
    d = access.disposition(access.page_evidence(F.col("html"), F.col("req"), F.col("final"), F.col("status"), F.lit(False)))
    got = {r.i: (r.d.disposition, ",".join(r.d.codes)) for r in df.select("i", d.alias("d")).collect()}
    assert got == {i: p[4] for i, p in enumerate(pages)}


def test_challenge_addresses(spark):
    cases = {"https://geo.captcha-delivery.com/": True, "https://h/blog/captcha": False, "https://h/challenge": True, "https://h/x?challenge=1": True, "https://h/cdn-cgi/challenge-platform/a": True, "nothing": False}
    df = spark.createDataFrame(list(cases.items()), "u string, want boolean")
    assert all(r.got == r.want for r in df.select("want", access.challenge_url(F.col("u")).alias("got")).collect())


def test_lint_of_odd_texts(spark):
    df = spark.createDataFrame([(0, None), (1, "3"), (2, "{}"), (3, '{"hosts":[null]}')], "i int, t string")
    got = {r.i: (r.l.grade, {(x.field, x.code) for x in r.l.issues}) for r in df.select("i", playbooks.lint(F.col("t")).alias("l")).collect()}
    assert got[0] == ("broken", {("(root)", "empty_input")}) and got[1] == ("broken", {("(root)", "not_object")})
    assert {("hosts", "missing"), ("extract.contentSelectors", "missing"), ("id", "missing"), ("schema_version", "missing")} <= got[2][1]
    assert ("hosts", "empty") in got[3][1]
