"""Retrieval, budgets, hashing and change queries over documents (a document is a page, its lines are blocks)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import integrity as I
from ..functions import text as T
from ..operators import rank as R
from ..registry import query, table
from .text import BLOCKS, sql_estimate, sql_tokens

CLAIM = ["the", "that", "ation", "sche", "pour"]


def pages_of_blocks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return docs.select("doc_id", F.split("text", "\n").alias("blocks"))


def _akin_sql(t):
    longer = f" OR starts_with(x, '{t}')" if len(t) >= 4 else ""
    return f"x = '{t}' OR (length(x) >= 4 AND starts_with('{t}', x)){longer}"


def scores_sql(claim):
    """The blocks of all documents with their scores for a claim's terms, and their places."""
    tf = ", ".join(
        f"CASE WHEN len(list_filter(t, lambda x: {_akin_sql(t)})) = 0 AND contains(lower(line), '{t}') THEN 1 ELSE len(list_filter(t, lambda x: {_akin_sql(t)})) END AS tf{k}, "
        f"sum(CASE WHEN list_contains(t, '{t}') THEN 1 ELSE 0 END) OVER w AS df{k}"
        for k, t in enumerate(claim)
    )
    gain = " + ".join(
        f"CASE WHEN tf{k} > 0 THEN ln(1 + (n - df{k} + 0.5::DOUBLE) / (df{k} + 0.5::DOUBLE)) * (tf{k} * 2.2::DOUBLE) / (tf{k} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean)) ELSE 0 END"
        for k in range(len(claim))
    )
    matched = " + ".join(f"CASE WHEN tf{k} > 0 THEN 1 ELSE 0 END" for k in range(len(claim)))
    return f"""
WITH RECURSIVE a AS (SELECT doc_id, pos, line, regexp_extract_all(lower(line), '[a-z0-9]{{3,}}') AS t FROM {BLOCKS}),
b AS (SELECT doc_id, pos, line, greatest(1, len(t)) AS dl, count(*) OVER w AS n, avg(greatest(1, len(t))) OVER w AS mean, {tf} FROM a WINDOW w AS (PARTITION BY doc_id)),
c AS (SELECT doc_id, pos, line, n, {gain} AS score, CAST({matched} AS INTEGER) AS matched FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, pos) AS place, max(score) OVER (PARTITION BY doc_id) AS best FROM c)
"""


SCORES = scores_sql(CLAIM)


@query("claim_rank", SCORES + """
SELECT doc_id, pos, round(score, 5) AS score, matched, matched >= 2 AS clears, sha256(line || chr(0) || 'p') AS leaf FROM d WHERE place <= 3
""")
def claim_rank(spark, sf_dir):
    """The three blocks of each document that bear most on a claim, with their leaf hashes."""
    df = pages_of_blocks(spark, sf_dir).withColumn("scores", R.block_scores(F.col("blocks"), CLAIM))
    rounded = F.transform("scores", lambda s: F.struct(F.round(s["score"], 9).alias("score"), s["matched"].alias("matched")))
    best = df.select("doc_id", "blocks", F.explode(R.top_blocks(rounded, 3)).alias("b"))
    return best.select(
        "doc_id", "b.pos", F.round(-F.col("b.minus"), 5).alias("score"), "b.matched",
        R.clears_floor(F.col("b.matched"), len(CLAIM)).alias("clears"),
        I.leaf_hash(F.element_at("blocks", F.col("b.pos") + 1), F.lit("p")).alias("leaf"),
    )


@query("block_salience", SCORES + "SELECT doc_id, pos, CASE WHEN best > 0 THEN round(score / best, 3) ELSE 0 END::DOUBLE AS salience FROM d")
def block_salience(spark, sf_dir):
    df = pages_of_blocks(spark, sf_dir).withColumn("scores", R.block_scores(F.col("blocks"), CLAIM))
    best = F.array_max(F.transform("scores", lambda s: s["score"]))
    share = F.transform("scores", lambda s: F.when(best > 0, s["score"] / best).otherwise(0.0))
    return df.select("doc_id", F.posexplode(share).alias("pos", "s")).select("doc_id", "pos", F.round("s", 3).alias("salience"))


FOCUS = "that configuration pour estion"


def _soft_sql(a, b):
    m, s = f"least(length({a}), {len(b)})", f"CAST(greatest(5, ceil(least(length({a}), {len(b)}) * 0.7)) AS INTEGER)"
    return f"({a} = '{b}' OR ({m} >= 4 AND substr({a}, 1, {m}) = substr('{b}', 1, {m})) OR ({m} >= {s} AND substr({a}, 1, {s}) = substr('{b}', 1, {s})))"


_HITS = " + ".join(
    "CASE WHEN len(list_filter(t, lambda x: " + " OR ".join(_soft_sql("x", w) for w in g) + ")) > 0 THEN 1 ELSE 0 END"
    for g in T.expand_terms(FOCUS.split())
)


@query("focus_match", f"""
WITH a AS (SELECT doc_id, text, {sql_tokens("text")} AS t FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, {_HITS} AS hits, contains(lower(text), '{FOCUS}') AS phrase FROM a)
SELECT doc_id, CAST(hits AS INTEGER) AS hits, CASE WHEN phrase THEN 'phrase' WHEN hits = 4 THEN 'ideal' WHEN hits >= 3 THEN 'partial' ELSE 'none' END AS tier,
  phrase OR hits >= 3 AS matched, CASE WHEN phrase THEN 1.0::DOUBLE ELSE hits / 4.0::DOUBLE END AS score FROM b
""")
def focus_match(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return docs.select("doc_id", R.focus_match(F.col("text"), FOCUS).alias("f")).select("doc_id", "f.hits", "f.tier", "f.matched", "f.score")


@query("budget_fill", f"""
WITH a AS (SELECT doc_id, pos, greatest(1, {sql_estimate("line")} + 1 + 3) AS cost FROM {BLOCKS}),
b AS (SELECT doc_id, pos, cost, sum(cost) OVER (PARTITION BY doc_id ORDER BY pos) AS used FROM a)
SELECT doc_id, CAST(count(*) FILTER (WHERE used <= 256) AS INTEGER) AS kept, CAST(count(*) FILTER (WHERE used > 256) AS INTEGER) AS dropped,
  CAST(coalesce(max(used) FILTER (WHERE used <= 256), 0) AS BIGINT) AS used FROM b GROUP BY doc_id
""")
def budget_fill(spark, sf_dir):
    cost = F.transform("blocks", lambda x: F.greatest(F.lit(1), T.token_estimate(x) + T.token_estimate(F.lit("p")) + T.token_estimate(F.lit("paragraph"))))
    df = pages_of_blocks(spark, sf_dir).select("doc_id", F.size("blocks").alias("n"), R.prefix_fill(cost, F.lit(256)).alias("f"))
    return df.select("doc_id", F.col("f.n").alias("kept"), (F.col("n") - F.col("f.n")).alias("dropped"), "f.used")


@query("salience_retention", SCORES + f""",
i AS (SELECT doc_id, pos, place, greatest(1, {sql_estimate("line")}) AS cost FROM d),
r(doc_id, place, used, kept) AS (SELECT doc_id, place, CASE WHEN cost <= 256 THEN cost ELSE 0 END, CASE WHEN cost <= 256 THEN [pos] ELSE [] END FROM i WHERE place = 1
  UNION ALL SELECT i.doc_id, i.place, used + CASE WHEN used + cost <= 256 THEN cost ELSE 0 END, CASE WHEN used + cost <= 256 THEN list_append(kept, pos) ELSE kept END FROM r JOIN i ON i.doc_id = r.doc_id AND i.place = r.place + 1)
SELECT doc_id, array_to_string(list_sort(arg_max(kept, place)), ',') AS kept FROM r GROUP BY doc_id
""")
def salience_retention(spark, sf_dir):
    """Blocks kept under a budget by salience, in reading order; too large a block is skipped, later ones may fit."""
    df = pages_of_blocks(spark, sf_dir).withColumn("scores", R.block_scores(F.col("blocks"), CLAIM))
    item = F.transform(
        F.arrays_zip("blocks", "scores"),
        lambda z, i: F.struct((-F.round(z["scores"]["score"], 9)).alias("minus"), i.alias("pos"), F.greatest(F.lit(1), T.token_estimate(z["blocks"])).alias("cost")),
    )
    return df.select("doc_id", F.array_join(R.skip_fill(F.array_sort(item), F.lit(256)), ",").alias("kept"))


@query("markdown_cap", """
WITH a AS (SELECT doc_id, CAST(128 + n_chars % 5000 AS BIGINT) AS m, n_chars // 7 AS s, doc_id % 2 = 0 AS r FROM documents),
b AS (SELECT *, greatest(128, m - CASE WHEN r THEN 48 ELSE 0 END) AS pool FROM a), c AS (SELECT *, greatest(128, pool // 2) AS floor FROM b)
SELECT doc_id, CAST(greatest(floor, pool - least(s, pool - floor)) AS INTEGER) AS cap, CAST(pool AS INTEGER) AS pool, CAST(floor AS INTEGER) AS floor FROM c
""")
def markdown_cap(spark, sf_dir):
    n = F.col("n_chars")
    cap = R.markdown_cap(128 + n % 5000, F.floor(n / 7), F.col("doc_id") % 2 == 0)
    return table(spark, sf_dir, "documents").select("doc_id", cap.alias("c")).select("doc_id", "c.cap", "c.pool", "c.floor")


# hashing


@query("leaf_hashes", f"SELECT doc_id, pos, sha256(line || chr(0) || 'p:nth-of-type(' || (pos + 1) || ')') AS leaf, substr(sha256('paragraph' || chr(1) || line), 1, 16) AS block FROM {BLOCKS}")
def leaf_hashes(spark, sf_dir):
    df = pages_of_blocks(spark, sf_dir).select("doc_id", F.posexplode("blocks").alias("pos", "line"))
    selector = F.concat(F.lit("p:nth-of-type("), (F.col("pos") + 1).cast("string"), F.lit(")"))
    return df.select("doc_id", "pos", I.leaf_hash(F.col("line"), selector).alias("leaf"), I.block_hash(F.lit("paragraph"), F.col("line")).alias("block"))


_LEAVES = f"(SELECT doc_id, list(sha256(line || chr(0) || 'p') ORDER BY pos) AS a FROM {BLOCKS} GROUP BY doc_id)"
_UP = "list_transform(range(0, len(a), 2), lambda i: sha256(unhex(a[i + 1]) || unhex(coalesce(a[i + 2], a[i + 1]))))"


def with_leaves(spark, sf_dir):
    leaves = F.transform("blocks", lambda x: I.leaf_hash(x, F.lit("p")))
    return pages_of_blocks(spark, sf_dir).select("doc_id", leaves.alias("leaves"))


@query("merkle_root", f"""
WITH RECURSIVE l(doc_id, a) AS (SELECT doc_id, a FROM {_LEAVES} UNION ALL SELECT doc_id, {_UP} FROM l WHERE len(a) > 1)
SELECT doc_id, a[1] AS root FROM l WHERE len(a) = 1
""")
def merkle_root(spark, sf_dir):
    return with_leaves(spark, sf_dir).select("doc_id", I.merkle_root(F.col("leaves")).alias("root"))


@query("merkle_proof_verify", "SELECT doc_id, true AS verified, false AS forged, CAST(CASE WHEN n > 1 THEN ceil(log2(n)) ELSE 0 END AS INTEGER) AS steps FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL)")
def merkle_proof_verify(spark, sf_dir):
    """Each document proves one of its leaves and fails to prove a foreign one."""
    df = with_leaves(spark, sf_dir).withColumn("at", F.pmod("doc_id", F.size("leaves")).cast("int"))
    df = df.withColumns({"root": I.merkle_root(F.col("leaves")), "path": I.merkle_proof(F.col("leaves"), F.col("at"))})
    leaf = F.element_at("leaves", F.col("at") + 1)
    return df.select(
        "doc_id", I.verify_proof(leaf, F.col("path"), F.col("root")).alias("verified"),
        I.verify_proof(F.sha2(leaf, 256), F.col("path"), F.col("root")).alias("forged"), F.size("path").alias("steps"),
    )


@query("dataset_row_leaves", r"""
SELECT doc_id, sha256('http://h/' || doc_id || chr(10) || 'http://h/' || doc_id || chr(10) || CASE WHEN ok THEN '1' ELSE '0' END || chr(10) || CASE WHEN ok THEN sha256(text) ELSE '' END || chr(10) || '' || chr(10) || CASE WHEN ok THEN '' ELSE 'http_404' END) AS leaf
FROM (SELECT doc_id, coalesce(text, '') AS text, doc_id % 9 <> 0 AS ok FROM documents)
""")
def dataset_row_leaves(spark, sf_dir):
    return _dataset(spark, sf_dir).select("doc_id", "leaf")


def _dataset(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    ok, url = F.col("doc_id") % 9 != 0, F.concat(F.lit("http://h/"), F.col("doc_id").cast("string"))
    none = F.lit(None).cast("string")
    leaf = I.row_leaf(
        url, url, F.when(ok, "1").otherwise("0"), F.when(ok, F.sha2(F.coalesce("text", F.lit("")), 256)), none, F.when(~ok, "http_404")
    )
    return docs.select("doc_id", leaf.alias("leaf"))


@query("cache_key", """
SELECT page_id, sha256(lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#:]*)', 1)) || CASE WHEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '://[^/?#]*([^?#]*)', 1) END
  || regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) || chr(10) || 'backend=http' || chr(10) || 'max_tokens=' || (page_id % 7 * 100) || chr(10) || 'focus_fragment=' || regexp_extract(url, '#(.*)$', 1)) AS key FROM pages
""".replace("\\\\", "\\"))
def cache_key(spark, sf_dir):
    url = F.col("url")
    parts = [
        T.cache_url(url), F.lit("\nbackend=http\nmax_tokens="), (F.col("page_id") % 7 * 100).cast("string"),
        F.lit("\nfocus_fragment="), F.coalesce(T.url_fragment(url), F.lit("")),
    ]
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(F.concat(*parts), 256).alias("key"))


@query("digest_id", "SELECT source, substr(sha256(string_agg(u, '|' ORDER BY u) || '|v1'), 1, 16) AS digest_id, count(*) AS urls FROM (SELECT source, 'http://h/' || doc_id AS u FROM documents WHERE doc_id IS NOT NULL) GROUP BY source, floor(cast(substr(u, 10) AS BIGINT) / 8)")
def digest_id(spark, sf_dir):
    """An id for each batch of up to eight addresses, whatever their order."""
    docs = table(spark, sf_dir, "documents").filter("doc_id is not null")
    u = F.concat(F.lit("http://h/"), F.col("doc_id").cast("string"))
    return docs.groupBy("source", F.floor(F.col("doc_id") / 8).alias("batch")).agg(
        F.substring(F.sha2(F.concat(F.array_join(F.array_sort(F.collect_list(u)), "|"), F.lit("|v1")), 256), 1, 16).alias("digest_id"),
        F.count("*").alias("urls"),
    ).select("source", "digest_id", "urls")


# change between two snapshots: the later one has lost some lines and changed others

_SNAPS = f"""(SELECT doc_id, pos, substr(sha256('paragraph' || chr(1) || line), 1, 16) AS old,
  CASE WHEN (doc_id + pos) % 7 = 0 THEN NULL WHEN (doc_id + pos) % 5 = 0 AND doc_id % 3 = 0 THEN substr(sha256('paragraph' || chr(1) || line || ' new'), 1, 16) ELSE substr(sha256('paragraph' || chr(1) || line), 1, 16) END AS new,
  CASE WHEN (doc_id + pos) % 5 = 0 AND doc_id % 3 = 0 THEN line || ' new' ELSE line END AS now FROM {BLOCKS})"""


def snapshots(spark, sf_dir):
    """(doc_id, before, after): the blocks of two snapshots."""
    after = F.transform(
        F.filter(F.transform("blocks", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: (F.col("doc_id") + s["i"]) % 7 != 0),
        lambda s: F.when(((F.col("doc_id") + s["i"]) % 5 == 0) & (F.col("doc_id") % 3 == 0), F.concat(s["x"], F.lit(" new"))).otherwise(s["x"]),
    )
    return pages_of_blocks(spark, sf_dir).select("doc_id", F.col("blocks").alias("before"), after.alias("after"))


def _hashes(column):
    return F.transform(column, lambda x: I.block_hash(F.lit("paragraph"), x))


@query("block_diff", f"""
SELECT doc_id, CAST(count(*) FILTER (WHERE new IS NOT NULL AND new NOT IN (SELECT old FROM {_SNAPS} o WHERE o.doc_id = s.doc_id)) AS INTEGER) AS added,
  CAST(count(DISTINCT old) FILTER (WHERE old NOT IN (SELECT new FROM {_SNAPS} o WHERE o.doc_id = s.doc_id AND new IS NOT NULL)) AS INTEGER) AS removed FROM {_SNAPS} s GROUP BY doc_id
""")
def block_diff(spark, sf_dir):
    df = snapshots(spark, sf_dir).select("doc_id", _hashes("before").alias("old"), _hashes("after").alias("new"))
    added = F.filter("new", lambda h: ~F.array_contains("old", h))
    return df.select("doc_id", F.size(added).alias("added"), F.size(F.array_except("old", "new")).alias("removed"))


@query("watch_eval", f"""
WITH s AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS a FROM {BLOCKS} GROUP BY doc_id),
t AS (SELECT doc_id, string_agg(now, chr(10) ORDER BY pos) AS b FROM {_SNAPS} WHERE new IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, CAST(sum(len({sql_tokens("now")})) AS INTEGER) AS tokens FROM {_SNAPS} x WHERE new IS NOT NULL AND new NOT IN (SELECT old FROM {_SNAPS} o WHERE o.doc_id = x.doc_id) GROUP BY doc_id)
SELECT doc_id, sha256(a) <> sha256(coalesce(b, '')) AS changed, CASE WHEN sha256(a) <> sha256(coalesce(b, '')) THEN coalesce(tokens, 0) ELSE 0 END AS delta_tokens FROM s LEFT JOIN t USING (doc_id) LEFT JOIN d USING (doc_id)
""")
def watch_eval(spark, sf_dir):
    """Whether a watched page changed between two visits, and how many words of new blocks it gained."""
    df = snapshots(spark, sf_dir)
    old = _hashes("before")
    fresh = F.filter("after", lambda x: ~F.array_contains(old, I.block_hash(F.lit("paragraph"), x)))
    tokens = F.aggregate(fresh, F.lit(0), lambda a, x: a + F.size(T.word_tokens(x)))
    changed = F.sha2(F.array_join("before", "\n"), 256) != F.sha2(F.array_join("after", "\n"), 256)
    return df.select("doc_id", changed.alias("changed"), F.when(changed, tokens).otherwise(0).alias("delta_tokens"))


@query("chunk_staleness", f"""
SELECT doc_id, CAST(count(*) FILTER (WHERE old NOT IN (SELECT new FROM {_SNAPS} o WHERE o.doc_id = s.doc_id AND new IS NOT NULL)) AS INTEGER) AS stale, CAST(count(*) AS INTEGER) AS cited,
  round_even(1 - count(*) FILTER (WHERE old IN (SELECT new FROM {_SNAPS} o WHERE o.doc_id = s.doc_id AND new IS NOT NULL))::DOUBLE / count(*), 3) AS drift FROM {_SNAPS} s GROUP BY doc_id
""")
def chunk_staleness(spark, sf_dir):
    """Cited source hashes that the page no longer has; duplicates count each."""
    df = snapshots(spark, sf_dir).select("doc_id", _hashes("before").alias("old"), _hashes("after").alias("new"))
    stale = F.size(F.filter("old", lambda h: ~F.array_contains("new", h)))
    return df.select("doc_id", stale.alias("stale"), F.size("old").alias("cited"), I.drift(F.size("old") - stale, F.size("old")).alias("drift"))


@query("conditional_response", "SELECT doc_id, h = p AS unchanged, CASE WHEN h = p THEN '' ELSE h END AS body FROM (SELECT doc_id, 'sha256:' || sha256(text) AS h, 'sha256:' || sha256(CASE WHEN doc_id % 4 = 0 THEN text || '.' ELSE text END) AS p FROM documents WHERE text IS NOT NULL)")
def conditional_response(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    known = I.content_hash(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    mine = I.content_hash(F.col("text"))
    same = I.same_hash(mine, F.upper(known))
    return docs.select("doc_id", same.alias("unchanged"), F.when(same, "").otherwise(mine).alias("body"))


# what several observers of the same page saw

_VANTAGES = """(SELECT doc_id, unnest(['a', 'b', 'c', 'd']) AS label, unnest([true, doc_id % 5 <> 1, doc_id % 5 <> 2 AND doc_id % 5 <> 4, doc_id % 5 <> 4]) AS ok,
  unnest([false, doc_id % 10 = 1, doc_id % 5 = 2, false]) AS wall, unnest([sha256(text), sha256(text), sha256(CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END), sha256(text)]) AS fp FROM documents WHERE text IS NOT NULL)"""


def vantages(spark, sf_dir):
    i, text = F.col("doc_id"), F.col("text")

    def seen(label, ok, wall, body):
        return F.struct(F.lit(label).alias("label"), ok.alias("ok"), wall.alias("wall"), F.sha2(body, 256).alias("fp"), body.alias("body"))

    no = F.lit(False)
    all_ = F.array(
        seen("a", F.lit(True), no, text), seen("b", i % 5 != 1, i % 10 == 1, text),
        seen("c", ~(i % 5).isin(2, 4), i % 5 == 2, F.when(i % 3 == 0, F.concat(text, F.lit("!"))).otherwise(text)), seen("d", i % 5 != 4, no, text),
    )
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.explode(all_).alias("v")).select("doc_id", "v.*")


@query("consensus", f"""
SELECT doc_id, CASE WHEN count(*) FILTER (WHERE ok) >= 1 AND count(*) FILTER (WHERE NOT ok AND wall) >= 1 THEN 'access_divergent'
  WHEN count(*) FILTER (WHERE ok) >= 2 THEN CASE WHEN count(DISTINCT fp) FILTER (WHERE ok) = 1 THEN 'consensus' ELSE 'divergent' END ELSE 'inconclusive' END AS verdict, count(*) FILTER (WHERE ok) AS usable FROM {_VANTAGES} GROUP BY doc_id
""")
def consensus(spark, sf_dir):
    seen = vantages(spark, sf_dir).drop("body").groupBy("doc_id").agg(
        F.count_if(F.col("ok") & F.col("fp").isNotNull()).alias("usable"), F.count_if(~F.col("ok") & F.col("wall")).alias("walls"),
        F.countDistinct(F.when(F.col("ok"), F.col("fp"))).alias("kinds"),
    )
    verdict = (
        F.when((F.col("usable") >= 1) & (F.col("walls") >= 1), "access_divergent")
        .when(F.col("usable") >= 2, F.when(F.col("kinds") == 1, "consensus").otherwise("divergent")).otherwise("inconclusive")
    )
    return seen.select("doc_id", verdict.alias("verdict"), "usable")


@query("divergence_pairs", f"""
WITH v AS (SELECT * FROM {_VANTAGES} WHERE ok)
SELECT a.doc_id, a.label AS left_label, b.label AS right_label, a.fp = b.fp AS roots_match FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.label < b.label
""")
def divergence_pairs(spark, sf_dir):
    """The pairs of a page's few observers; a page has a bounded handful, so they pair up inside its row."""
    seen = vantages(spark, sf_dir).filter("ok").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("label", "fp"))).alias("v"))
    pairs = F.flatten(F.transform("v", lambda a, i: F.transform(F.slice("v", i + 2, F.size("v")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return seen.select("doc_id", F.explode(pairs).alias("p")).select(
        "doc_id", F.col("p.a.label").alias("left_label"), F.col("p.b.label").alias("right_label"), (F.col("p.a.fp") == F.col("p.b.fp")).alias("roots_match")
    )


@query("watch_state", """
WITH h AS (SELECT user_id, event_id, ts, md5(event_type) AS h, lag(md5(event_type)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT event_id, p IS NULL AS first_seen, coalesce(h <> p, false) AS changed FROM h
""")
def watch_state(spark, sf_dir):
    """Every visit against the visit before it: first seen, changed or not."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    h = F.md5("event_type")
    df = table(spark, sf_dir, "events").withColumn("before", F.lag(h).over(w))
    return df.select("event_id", F.col("before").isNull().alias("first_seen"), F.coalesce(h != F.col("before"), F.lit(False)).alias("changed"))
