"""Recipes, canonical rows, receipts, manifests and histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import integrity as I
from ..functions import text as T
from ..operators import knowledge as K
from ..operators import ordered as O
from ..operators import receipts as R
from ..registry import query, table
from ..storage import materialize
from .rank import _dataset
from .text import sql_estimate, sql_tokens

RECIPES = (
    ("example.com", "seed", "article", "", "seed com"), ("example.net", "seed", "main", "http", ""), ("blog.tionble.example.com", "community", "div.post", "", ""),
    ("example.com", "user", "", "browser", ""), ("example.org", "local", "", "", "own"), ("tionsh.example.net", "user", "section", "", "mine"),
)
_VALUES = ", ".join(str(r) for r in RECIPES)


@query("recipe_resolve", rf"""
WITH r(host, tier, selector, backend, notes) AS (VALUES {_VALUES}), k AS (SELECT *, CASE tier WHEN 'local' THEN 4 WHEN 'user' THEN 3 WHEN 'community' THEN 2 ELSE 1 END * 1000 + length(host) AS rank FROM r),
p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\.', '') AS h FROM pages)
SELECT page_id, arg_max(selector, rank) FILTER (WHERE selector <> '') AS selector, arg_max(backend, rank) FILTER (WHERE backend <> '') AS backend, arg_max(notes, rank) FILTER (WHERE notes <> '') AS notes
FROM p LEFT JOIN k ON h = host OR ends_with(h, '.' || host) GROUP BY page_id
""")
def recipe_resolve(spark, sf_dir):
    recipes = spark.createDataFrame(RECIPES, "host string, tier string, selector string, backend string, notes string")
    return K.resolve_recipes(table(spark, sf_dir, "pages").select("page_id", "url"), recipes, "page_id", "url")


PATTERNS = {"/en/*": "english", "/en/7*": "seventh", "/de/1": "first", "/de/*": "german"}


@query("schema_match", r"""
WITH p AS (SELECT page_id, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS x FROM pages)
SELECT page_id, CASE WHEN starts_with(x, '/en/7') THEN 'seventh' WHEN starts_with(x, '/en/') THEN 'english' WHEN x = '/de/1' THEN 'first' WHEN starts_with(x, '/de/') THEN 'german' ELSE 'default' END AS class FROM p
""")
def schema_match(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", K.match_schema(T.url_path(F.col("url")), PATTERNS, "default").alias("class"))


@query("knowledge_id", r"""
WITH u AS (SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS s, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS h, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS p FROM pages)
SELECT page_id, substr(sha256(lower(regexp_replace(s || '://' || h || CASE WHEN p = '' THEN '/' ELSE p END, '/+$', '')) || '|article|r' || (page_id % 3)), 1, 16) AS ko_id FROM u
""")
def knowledge_id(spark, sf_dir):
    revision = F.concat(F.lit("r"), (F.col("page_id") % 3).cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", K.knowledge_id(F.col("url"), F.lit("article"), revision).alias("ko_id"))


@query("genome_merge", r"""
SELECT page_id, regexp_extract(html, 'lang="([a-z]*)"', 1) AS lang, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host, CAST(3 AS INTEGER) AS n FROM pages
""")
def genome_merge(spark, sf_dir):
    """What a page's site says of it under what its recipe says."""
    host, lang = T.url_host(F.col("url")), F.regexp_extract("html", 'lang="([a-z]*)"', 1)
    site = F.create_map(F.lit("lang"), F.lit("any"), F.lit("host"), host, F.lit("size"), F.length("html").cast("string"))
    merged = K.merge_maps(site, F.create_map(F.lit("lang"), lang))
    return table(spark, sf_dir, "pages").select("page_id", merged["lang"].alias("lang"), merged["host"].alias("host"), F.size(merged).alias("n"))


def _canonical(spark, sf_dir):
    blocks = table(spark, sf_dir, "documents").filter("text is not null").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"), F.concat(F.lit("http://h/"), "source").alias("url")
    )
    return K.canonical(blocks, "doc_id", "pos", "text", "url")


_ID = "substr(sha256('{k}:' || doc_id || ':' || pos), 1, 16)"
_ROWS = f"(SELECT doc_id, pos, length(line) AS n, {_ID.format(k='claim')} AS claim_id, {_ID.format(k='evidence')} AS evidence_id FROM (SELECT doc_id, unnest(range(0, len(s))) AS pos, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)))"


@query("canonical_claims", f"""
SELECT claim_id, evidence_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS k FROM {_ROWS}) WHERE k <= 3
""")
def canonical_claims(spark, sf_dir):
    """The three longest claims of each document, and the evidence under them."""
    kept = K.retain(_canonical(spark, sf_dir), "doc_id", F.desc(F.length("text")), 3)
    return kept["claim"].join(kept["evidence"].select("evidence_id"), "evidence_id").select("claim_id", "evidence_id")


@query("provenance_trace", f"SELECT CASE WHEN pos % 5 = 4 THEN 'evidence_missing' WHEN pos % 5 = 3 THEN 'provenance_missing' ELSE 'complete' END AS status, count(*) AS claims FROM {_ROWS} GROUP BY 1")
def provenance_trace(spark, sf_dir):
    """Claims by the first link that is missing, after some evidence and provenance was taken away."""
    tables = _canonical(spark, sf_dir)
    gone = tables["claim"].filter("pos % 5 = 3").select("claim_id")
    tables |= {"evidence": tables["evidence"].filter("pos % 5 <> 4"), "provenance": tables["provenance"].join(gone, "claim_id", "left_anti")}
    return K.trace(tables).groupBy("status").agg(F.count("*").alias("claims"))


@query("integrity_anti_join", f"SELECT claim_id FROM {_ROWS} WHERE pos % 5 = 4")
def integrity_anti_join(spark, sf_dir):
    """Claims whose evidence is not there."""
    tables = _canonical(spark, sf_dir)
    return tables["claim"].join(tables["evidence"].filter("pos % 5 <> 4").select("evidence_id"), "evidence_id", "left_anti").select("claim_id")


@query("receipts", """
SELECT doc_id, sha256('{"v":1,"kind":"page","url":"http://h/' || doc_id || '"' || CASE WHEN doc_id % 4 <> 0 THEN ',"contentHash":"sha256:' || sha256(text) || '"' ELSE ',"failureCode":"http_404"' END || ',"keyId":"k1","alg":"ecdsa-p256-sha256"}') AS digest,
  CASE WHEN doc_id % 4 = 0 THEN 'invalid_receipt' WHEN doc_id % 5 = 0 THEN 'wrong_key' WHEN doc_id % 7 = 0 THEN 'signature_invalid' WHEN doc_id % 3 = 0 THEN 'content_mismatch' ELSE 'verified' END AS status, true AS round_trip FROM documents WHERE text IS NOT NULL
""")
def receipts(spark, sf_dir):
    """Receipts in canonical form, sent as capsules, and what verifying them says."""
    i, text = F.col("doc_id"), F.col("text")
    hash_ = F.when(i % 4 != 0, I.content_hash(text))
    body = R.canonical_json(
        v=F.lit(1), kind=F.lit("page"), url=F.concat(F.lit("http://h/"), i.cast("string")), contentHash=hash_,
        failureCode=F.when(i % 4 == 0, "http_404"), keyId=F.lit("k1"), alg=F.lit(R.ALG),
    )
    seen = F.when(i % 3 == 0, F.concat(text, F.lit("!"))).otherwise(text)
    status = R.receipt_status(seen, hash_, F.when(i % 5 == 0, "k2").otherwise("k1"), "k1", i % 7 != 0)
    docs = table(spark, sf_dir, "documents").filter("text is not null").withColumn("body", body)
    return docs.select("doc_id", F.sha2("body", 256).alias("digest"), status.alias("status"), (R.open_capsule(R.capsule(F.col("body"))) == F.col("body")).alias("round_trip"))


@query("dataset_manifest", """
WITH RECURSIVE x AS (SELECT list(sha256('http://h/' || doc_id || chr(10) || 'http://h/' || doc_id || chr(10) || CASE WHEN ok THEN '1' ELSE '0' END || chr(10) || CASE WHEN ok THEN sha256(text) ELSE '' END || chr(10) || '' || chr(10) || CASE WHEN ok THEN '' ELSE 'http_404' END) ORDER BY doc_id) AS a
  FROM (SELECT doc_id, coalesce(text, '') AS text, doc_id % 9 <> 0 AS ok FROM documents)),
l(a) AS (SELECT a FROM x UNION ALL SELECT list_transform(range(0, len(a), 2), lambda i: sha256(unhex(a[i + 1]) || unhex(coalesce(a[i + 2], a[i + 1])))) FROM l WHERE len(a) > 1)
SELECT a[1] AS root, (SELECT count(*) FROM documents) AS row_count FROM l WHERE len(a) = 1
""")
def dataset_manifest(spark, sf_dir):
    rows = _dataset(spark, sf_dir)
    root = R.ordered_root(rows, ["doc_id"], "leaf")
    return rows.agg(F.lit(root).cast("string").alias("root"), F.count("*").alias("row_count"))


@query("history_chain", """
WITH v AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT user_id, CAST(count(*) FILTER (WHERE p IS NULL OR p <> event_type) AS INTEGER) AS entries, true AS intact, count(*) FILTER (WHERE p IS NULL OR p <> event_type) < 3 AS forged FROM v GROUP BY user_id
""")
def history_chain(spark, sf_dir):
    """Hash chains of what each watched key showed; intact as made, not so with an entry taken out. Only visits that
    changed something are gathered, as the others leave a chain as it is."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("hash"))
    keys, order = ["user_id"], ["ts", "event_id"]
    seen = O.with_previous(O.in_parts(events, keys, order), keys, order, "hash", "last")
    changed = seen.filter(~F.coalesce(F.col("last") == F.col("hash"), F.lit(False)))
    return chains(changed.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "hash"))).alias("visits")))


def chains(visits):
    df = visits.select("user_id", R.history_chain(F.col("visits")).alias("chain"))
    cut = F.filter("chain", lambda e: e["seq"] != 1)
    return df.select("user_id", F.size("chain").alias("entries"), R.chain_intact(F.col("chain")).alias("intact"), R.chain_intact(cut).alias("forged"))


_CLAIMS = f"(SELECT doc_id, pos, line, greatest(1, {sql_estimate('line')}) AS cost, greatest(8, floor(n_chars / 32)) AS cap FROM (SELECT doc_id, n_chars, unnest(range(0, len(s))) AS pos, unnest(s) AS line FROM (SELECT doc_id, n_chars, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)))"
_KEPT = f"(SELECT * FROM (SELECT *, sum(cost) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM {_CLAIMS}) WHERE upto <= cap)"


def _within_budget(spark, sf_dir, written=True):
    """Canonical rows of all documents, and what an eighth of each one's characters, in tokens, keeps of them.

    Where only claims are asked for, their places and texts are cheaper to read again than all rows, with ids, to write.
    """
    tables = _canonical(spark, sf_dir)
    if written:
        tables = {k: materialize(t, k) for k, t in tables.items()}
    budget = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 8).alias("budget"))
    claims = tables["claim"].join(budget, "doc_id")
    return tables, K.retain_within(tables | {"claim": claims}, "doc_id", F.col("budget"))


@query("canonical_budget", f"""
SELECT substr(sha256('claim:' || doc_id || ':' || pos), 1, 16) AS claim_id, substr(sha256('evidence:' || doc_id || ':' || pos), 1, 16) AS evidence_id FROM {_KEPT}
""")
def canonical_budget(spark, sf_dir):
    """The claims that a share of each document's budget pays for, in its order, with their evidence."""
    _, kept = _within_budget(spark, sf_dir)
    return kept["claim"].join(kept["evidence"].select("evidence_id"), "evidence_id").select("claim_id", "evidence_id")


@query("retention_report", f"""
WITH b AS (SELECT doc_id, count(*) AS n FROM {_CLAIMS} GROUP BY doc_id), a AS (SELECT doc_id, count(*) AS n FROM {_KEPT} GROUP BY doc_id),
tb AS (SELECT doc_id, count(DISTINCT t) AS n FROM (SELECT doc_id, unnest({sql_tokens("line")}) AS t FROM {_CLAIMS}) GROUP BY doc_id),
ta AS (SELECT doc_id, count(DISTINCT t) AS n FROM (SELECT doc_id, unnest({sql_tokens("line")}) AS t FROM {_KEPT}) GROUP BY doc_id)
SELECT b.doc_id, b.n AS claims_before, coalesce(a.n, 0) AS claims_after, coalesce(tb.n, 0) AS terms_before, coalesce(ta.n, 0) AS terms_after,
  round(coalesce(a.n, 0) / b.n, 4) AS claims_kept, CASE WHEN tb.n > 0 THEN round(coalesce(ta.n, 0) / tb.n, 4) END AS terms_kept
FROM b LEFT JOIN a USING (doc_id) LEFT JOIN tb USING (doc_id) LEFT JOIN ta USING (doc_id)
""")
def retention_report(spark, sf_dir):
    """What a budget leaves of each document's claims and of their terms."""
    before, after = _within_budget(spark, sf_dir, written=False)
    return K.retention_report(before, after, "doc_id")


@query("integrity_report", f"""
WITH r AS (SELECT *, substr(sha256('provenance:' || doc_id || ':' || pos), 1, 16) AS provenance_id FROM {_ROWS})
SELECT 'claim_without_evidence' AS finding, claim_id AS id FROM r WHERE n % 5 = 4
UNION ALL SELECT 'provenance_without_evidence', provenance_id FROM r WHERE n % 5 = 4
UNION ALL SELECT 'provenance_without_claim', provenance_id FROM r WHERE n % 7 = 3
UNION ALL SELECT 'claim_twice', claim_id FROM r WHERE n % 11 = 5 AND n % 7 <> 3
UNION ALL SELECT 'claim_without_evidence', claim_id FROM r WHERE n % 11 = 5 AND n % 7 <> 3 AND n % 5 = 4
EXCEPT ALL SELECT 'claim_without_evidence', claim_id FROM r WHERE n % 5 = 4 AND n % 7 = 3
""")
def integrity_report(spark, sf_dir):
    """What is found in tables that were damaged by the length of lines: evidence and claims gone, claims there twice."""
    tables = _canonical(spark, sf_dir)
    sized = tables["claim"].withColumn("n", F.length("text"))
    claims = sized.filter("n % 7 <> 3")
    gone = sized.filter("n % 5 = 4").select("evidence_id")
    damaged = tables | {"claim": claims.unionByName(claims.filter("n % 11 = 5")), "evidence": tables["evidence"].join(gone, "evidence_id", "left_anti")}
    return K.integrity_report(damaged)
