"""Claims, links and budgeted markdown."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import integrity as I
from ..functions import text as T
from ..operators import claims as A
from ..operators import compile as C
from ..operators import links as L
from ..operators import rank as R
from ..operators import receipts as M
from ..registry import query, table
from .classify import link_arrays
from .rank import scores_sql
from .sections import headed
from .text import sql_estimate


@query("attest_summary", """
WITH d AS (SELECT doc_id, doc_id % 5 AS k FROM documents WHERE text IS NOT NULL)
SELECT count(*) AS claims, count(*) FILTER (WHERE k = 0) AS supported, count(*) FILTER (WHERE k IN (1, 2)) AS contradicted, count(*) FILTER (WHERE k IN (3, 4)) AS unsupported, CAST(0 AS BIGINT) AS unknown FROM d
""")
def attest_summary(spark, sf_dir):
    """A claim for each document against its blocks, one of which says, denies or leaves open what is claimed."""
    i = F.col("doc_id").cast("string")
    claim = F.concat(F.lit("zyx"), i, F.lit(" is a fast database"))
    said = F.element_at(
        F.array(*[F.concat(F.lit("zyx"), i, F.lit(x)) for x in (" is a fast database.", " is not a fast database.", " is a library.", " has docs.")] + [F.lit("A fast database.")]),
        (F.col("doc_id") % 5 + 1).cast("int"),
    )
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", claim.alias("claim"), F.concat(F.split("text", "\n"), F.array(said)).alias("all"))
    scores = F.transform("all", lambda x: F.when(x.contains("zyx") | x.contains("fast database"), 1.0).otherwise(0.0))
    best = F.slice(F.array_sort(F.transform(scores, lambda s, k: F.struct((-s).alias("minus"), k.alias("pos")))), 1, 3)
    blocks = F.transform(F.filter(best, lambda b: b["minus"] < 0), lambda b: F.element_at("all", b["pos"] + 1))
    return A.summarize(A.with_status(docs.select("doc_id", "claim", blocks.alias("blocks")), "claim", "blocks"))


CHECKED = ["the", "that", "tion"]


@query("claim_check", scores_sql(CHECKED) + """
SELECT doc_id, pos, matched, sha256(line || chr(0) || 'p') AS leaf, CAST(CASE WHEN n > 1 THEN ceil(log2(n)) ELSE 0 END AS INTEGER) AS steps, true AS proven FROM d WHERE place <= 3 AND matched >= 2
""")
def claim_check(spark, sf_dir):
    """Blocks that bear on a claim, each with the proof that it is on its page."""
    claim = CHECKED
    df = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.split("text", "\n").alias("blocks"))
    df = df.withColumns({"scores": R.block_scores(F.col("blocks"), claim), "leaves": F.transform("blocks", lambda x: I.leaf_hash(x, F.lit("p")))})
    rounded = F.transform("scores", lambda s: F.struct(F.round(s["score"], 9).alias("score"), s["matched"].alias("matched")))
    best = df.select("doc_id", "leaves", F.explode(R.top_blocks(rounded, 3)).alias("b")).filter(R.clears_floor(F.col("b.matched"), len(claim)))
    path = I.merkle_proof(F.col("leaves"), F.col("b.pos"))
    leaf = F.element_at("leaves", F.col("b.pos") + 1)
    return best.select("doc_id", "b.pos", "b.matched", leaf.alias("leaf"), F.size(path).alias("steps"), I.verify_proof(leaf, path, I.merkle_root(F.col("leaves"))).alias("proven"))


@query("link_rank")
def link_rank(spark, sf_dir):
    """Each page's five best links for a question, best first."""
    with_path = F.transform("links", lambda x: F.struct(x["url"].alias("url"), T.url_path(x["url"]).alias("path"), x["title"].alias("title")))
    pages = link_arrays(spark, sf_dir).filter(F.size("links") > 0).select("page_id", with_path.alias("links"))
    scored = pages.select("page_id", "links", L.link_scores(F.col("links"), "the tion reference").alias("scores"))
    order = F.array_sort(F.transform(F.arrays_zip("links", "scores"), lambda z: F.struct((-F.round(z["scores"]["total"], 6)).alias("minus"), z["links"]["url"].alias("url"))))
    best = scored.select("page_id", F.posexplode(F.slice(order, 1, 5)).alias("place", "x"))
    return best.select("page_id", "place", "x.url", (-F.col("x.minus")).alias("score"))


@query("link_hubs", r"""
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 7 WHEN page_id % 4 = 1 THEN 3 WHEN page_id % 4 = 2 AND ends_with(p, '/') THEN 2 END AS priority
FROM (SELECT page_id, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS p FROM pages WHERE url IS NOT NULL)
""")
def link_hubs(spark, sf_dir):
    k, path = F.col("page_id") % 4, T.url_path(F.col("url"))
    path = F.when(k == 0, "/3/library/").when(k == 1, "/docs/intro").when(k == 2, path).otherwise("/library/os.html")
    return table(spark, sf_dir, "pages").filter("url is not null").select("page_id", L.hub_priority(path).alias("priority"))


@query("markdown_prune", r"""
SELECT doc_id, sha256(trim(regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT (pos % 6 = 2)), ''), '\n{3,}', chr(10) || chr(10), 'g'))) AS pruned FROM (SELECT doc_id, CAST(unnest(range(0, len(s))) AS INTEGER) AS pos, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)) GROUP BY doc_id
""")
def markdown_prune(spark, sf_dir):
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 6 == 2, F.concat(x, F.lit(" Edit this page on GitHub"))).when(i % 6 == 1, F.concat(F.lit("[ ](/edit)"), x)).otherwise(x))
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return docs.select("doc_id", F.sha2(C.prune_lines(F.array_join(lines, "\n")), 256).alias("pruned"))


@query("fit_markdown")
def fit_markdown(spark, sf_dir):
    """Documents with headings, pruned for a question; state runs through a document, so tests check it."""
    df = headed(spark, sf_dir).withColumn("md", F.replace("md", F.lit("\n"), F.lit("\n\n")))
    df = C.per_text(df, "md", "fitted", lambda t: C.prune_paragraphs(t, "that tion"), pa.string(), "string")
    return df.select("doc_id", F.length("md").alias("before"), F.length("fitted").alias("after"), F.sha2("fitted", 256).alias("digest"))


@query("budget_strategy", f"SELECT doc_id, CASE WHEN {sql_estimate('text')} <= 200 THEN 'none' ELSE 'cut' END AS strategy FROM documents WHERE text IS NOT NULL")
def budget_strategy(spark, sf_dir):
    """Whether a document fits 200 tokens or is cut, and that what is left fits."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    kind = pa.struct([("text", pa.string()), ("strategy", pa.string())])

    def cut(t):
        text, strategy = C.budgeted(t, 200)
        assert C.estimate(text) <= 200 + C.estimate(C.SNIP_TAIL)
        return {"text": text, "strategy": strategy}

    df = C.per_text(docs.select("doc_id", "text"), "text", "b", cut, kind, "struct<text: string, strategy: string>")
    return df.select("doc_id", F.when(F.col("b.strategy").isNull(), "none").otherwise("cut").alias("strategy"))


SPEC = {
    "title": {"selector": "article > h1"}, "first_link": {"selector": "nav li a[href]", "attr": "href"}, "all_links": {"selector": "ul a", "attr": "href", "multiple": True},
    "charset": {"regex": r'charset="([^"]+)"'}, "kind": {"const": "page"},
}


@query("field_extract", r"""
SELECT page_id, regexp_extract(html, '<a href="([^"]*)"', 1) AS first_link, len(regexp_extract_all(html, '<li><a href="[^"]*"')) AS links, 'utf-8' AS charset, 'page' AS kind FROM pages WHERE html IS NOT NULL
""")
def field_extract(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").filter("html is not null").select("page_id", "html")
    kind = pa.struct([(k, pa.string()) for k in SPEC])
    df = C.per_text(pages, "html", "f", lambda h: C.extract_fields(h, SPEC), kind, "struct<" + ", ".join(f"{k}: string" for k in SPEC) + ">")
    return df.select("page_id", "f.first_link", F.size(F.split("f.all_links", "; ")).cast("bigint").alias("links"), "f.charset", "f.kind")


@query("digest_combined", r"""
WITH RECURSIVE x AS (SELECT source, count(*) AS pages, count(*) FILTER (WHERE contains(lower(text), 'that')) AS focused, list(sha256('## ' || doc_id || chr(10) || chr(10) || text) ORDER BY doc_id, sha256('## ' || doc_id || chr(10) || chr(10) || text)) AS a FROM documents WHERE text IS NOT NULL GROUP BY source),
l(source, pages, focused, a) AS (SELECT source, pages, focused, a FROM x UNION ALL SELECT source, pages, focused, list_transform(range(0, len(a), 2), lambda i: sha256(unhex(a[i + 1]) || unhex(coalesce(a[i + 2], a[i + 1])))) FROM l WHERE len(a) > 1)
SELECT source, pages, focused, a[1] AS combined FROM l WHERE len(a) = 1
""")
def digest_combined(spark, sf_dir):
    """One digest a source out of all its pages and their whole texts, as the root over the parts' hashes in order."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    part = F.sha2(F.concat(F.lit("## "), F.col("doc_id").cast("string"), F.lit("\n\n"), F.col("text")), 256)
    roots = M.ordered_roots(docs.select("source", "doc_id", part.alias("leaf")), "source", ["doc_id", "leaf"], "leaf")
    counts = docs.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("pages"), F.count_if(F.lower("text").contains("that")).alias("focused"))
    return counts.join(roots, F.col("s").eqNullSafe(F.col("source"))).select("source", "pages", "focused", F.col("root").alias("combined"))
