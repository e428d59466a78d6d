"""Text scalars over documents, blocks (lines of a document) and page addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query, table

# SQL for the pieces that several queries share


def sql_tokens(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]{{3,}}')"


def sql_any(x: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p.replace(chr(39), chr(39) * 2)}')" for p in phrases) + ")"


def sql_estimate(x: str) -> str:
    def n(chars):
        return f"length(regexp_replace({x}, '[^{chars}]', '', 'g'))"

    a, w, s = n(r"\x00-\x7F"), n(T.WIDE), n(r"\x{10000}-\x{10FFFF}")
    return f"CAST(CASE WHEN {x} IS NULL OR {x} = '' THEN 0 ELSE greatest(1, ceil({a} * 0.25 + {w} + {s} + (length({x}) - {a} - {w} - {s}) * 0.5)) END AS INTEGER)"


#: One row a line of a document; ``pos`` from 0.
BLOCKS = "(SELECT doc_id, CAST(unnest(range(0, len(s))) AS INTEGER) AS pos, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL))"


def blocks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@query("token_estimate", f"SELECT doc_id, {sql_estimate('text')} AS tokens, CAST(greatest(1, ceil(n_chars / 4.0)) AS INTEGER) AS by_bytes FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.token_estimate(F.col("text")).alias("tokens"), T.bytes_estimate(F.col("n_chars")).alias("by_bytes")
    )


@query("token_estimate_mixed", rf"""
SELECT doc_id, {sql_estimate("x")} AS tokens FROM (SELECT doc_id, lang || '漢字かな한글 éß 😀' || text AS x FROM documents)
""")
def token_estimate_mixed(spark, sf_dir):
    mixed = F.concat("lang", F.lit("漢字かな한글 éß 😀"), "text")
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(mixed).alias("tokens"))


@query("char_budget", r"""
SELECT doc_id, CAST(CASE WHEN length(t) = 0 THEN 0 ELSE (
  SELECT count(*) FROM (
    SELECT sum(CASE WHEN unicode(c) < 128 THEN 0.25 ELSE 0.5 END) OVER (ORDER BY i) AS cost
    FROM (SELECT unnest(string_split(t, '')) AS c, unnest(range(0, length(t))) AS i)
  ) WHERE cost <= 20) END AS INTEGER) AS chars
FROM (SELECT doc_id, substr(text, 1, 200) AS t FROM documents)
""")
def char_budget(spark, sf_dir):
    head = F.substring("text", 1, 200)
    return table(spark, sf_dir, "documents").select("doc_id", T.prefix_within(head, 20).cast("int").alias("chars"))


@query("word_tokens", rf"""
SELECT doc_id, CAST(len({sql_tokens("text")}) AS INTEGER) AS words, CAST(len(list_distinct({sql_tokens("text")})) AS INTEGER) AS kinds,
       CAST(len(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}')) AS INTEGER) AS ascii_words,
       CAST(len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+([._-][\p{{L}}\p{{N}}]+)*')) AS INTEGER) AS technical
FROM documents
""")
def word_tokens(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(T.word_tokens(text)).alias("words"), F.size(F.array_distinct(T.word_tokens(text))).alias("kinds"),
        F.size(T.ascii_tokens(text)).alias("ascii_words"), F.size(T.technical_tokens(text)).alias("technical"),
    )


@query("normal_text", rf"""
SELECT doc_id, pos, n AS normal, regexp_replace(n, '\s+', '-', 'g') AS slug
FROM (SELECT doc_id, pos, trim(regexp_replace(lower(line), '[^\p{{L}}\p{{Nd}}_.\-]+', ' ', 'g')) AS n FROM {BLOCKS})
""")
def normal_text(spark, sf_dir):
    line = F.col("line")
    return blocks(spark, sf_dir).select("doc_id", "pos", T.normal_text(line).alias("normal"), T.slug(line).alias("slug"))


@query("anchor_identity", r"""
SELECT page_id, lower(url_decode(replace(regexp_replace(trim(a), '^#+', ''), '+', '%2B'))) AS anchor
FROM (SELECT page_id, '##Sec%20tion+' || page_id || '%C3%89' AS a FROM pages)
""")
def anchor_identity(spark, sf_dir):
    anchor = F.concat(F.lit("##Sec%20tion+"), F.col("page_id").cast("string"), F.lit("%C3%89"))
    return table(spark, sf_dir, "pages").select("page_id", T.identity(anchor).alias("anchor"))


@query("match_form", r"""
SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(x, '!?\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[*_`]+', '', 'g'), '\s+', ' ', 'g'))) AS form
FROM (SELECT doc_id, '**' || lang || '** [' || source || '](http://x/' || source || ') `' || text || '`' AS x FROM documents WHERE text IS NOT NULL)
""")
def match_form(spark, sf_dir):
    marked = F.concat(F.lit("**"), "lang", F.lit("** ["), "source", F.lit("](http://x/"), "source", F.lit(") `"), "text", F.lit("`"))
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return docs.select("doc_id", F.sha2(T.match_form(marked), 256).alias("form"))


@query("soft_terms", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]{3,}') AS t FROM documents),
p AS (SELECT doc_id, unnest(list_zip(t[1:len(t) - 1], t[2:])) AS z FROM w),
q AS (SELECT doc_id, z[1] AS a, z[2] AS b, least(length(z[1]), length(z[2])) AS m FROM p),
r AS (SELECT *, CAST(greatest(5, ceil(m * 0.7)) AS INTEGER) AS s FROM q)
SELECT doc_id, count(*) AS pairs,
  CAST(sum(CASE WHEN a = b OR (m >= 4 AND substr(a, 1, m) = substr(b, 1, m)) OR (m >= s AND substr(a, 1, s) = substr(b, 1, s)) THEN 1 ELSE 0 END) AS BIGINT) AS soft
FROM r GROUP BY doc_id
""")
def soft_terms(spark, sf_dir):
    """Neighbouring words of a document that count as the same term."""
    words = table(spark, sf_dir, "documents").select("doc_id", T.word_tokens(F.col("text")).alias("t")).filter(F.size("t") > 1)
    n = F.size("t") - 1
    pairs = F.arrays_zip(F.slice("t", F.lit(1), n).alias("a"), F.slice("t", F.lit(2), n).alias("b"))
    return words.select("doc_id", pairs.alias("p")).select(
        "doc_id", F.size("p").cast("bigint").alias("pairs"),
        F.size(F.filter("p", lambda z: T.soft_equal(z["a"], z["b"]))).cast("bigint").alias("soft"),
    )


def _sql_low_value(x: str) -> str:
    tokens, links = sql_tokens("p"), f"len(regexp_extract_all(p, '{T.LINK}'))"
    return f"""CASE WHEN p = '' THEN true WHEN length(p) < 24 THEN false WHEN {sql_any("lower(p)", T.SEO_PHRASES)} THEN true
  WHEN contains(p, '?') AND len({tokens}) <= 14 AND {sql_any("lower(p)", ("sign up", "subscribe", "cookie"))} THEN true
  WHEN len({tokens}) < 10 THEN false WHEN {links} >= 3 AND {links} * 4 >= len({tokens}) THEN true
  ELSE len(list_distinct({tokens})) * 1.0 / len({tokens}) < 0.38 AND len({tokens}) >= 28 END"""


@query("low_value_blocks", f"""
SELECT doc_id, pos, {_sql_low_value("p")} AS low_value FROM (
  SELECT doc_id, pos, trim(CASE WHEN pos % 5 = 3 THEN line || ' Click here?' ELSE line END) AS p FROM {BLOCKS})
""")
def low_value_blocks(spark, sf_dir):
    line = F.when(F.col("pos") % 5 == 3, F.concat("line", F.lit(" Click here?"))).otherwise(F.col("line"))
    return blocks(spark, sf_dir).select("doc_id", "pos", T.low_value(line).alias("low_value"))


@query("boilerplate_lines", f"""
SELECT doc_id, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE trim(line) <> '' AND NOT {sql_any("lower(line)", T.BOILERPLATE_TERMS)}), '')) AS kept
FROM (SELECT doc_id, pos, CASE WHEN pos % 4 = 1 THEN line || ' All Rights Reserved' ELSE line END AS line FROM {BLOCKS}) GROUP BY doc_id
""")
def boilerplate_lines(spark, sf_dir):
    lines = F.transform(
        F.split("text", "\n"), lambda x, i: F.when(i % 4 == 1, F.concat(x, F.lit(" All Rights Reserved"))).otherwise(x)
    )
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return docs.select("doc_id", F.sha2(T.drop_boilerplate_lines(F.array_join(lines, "\n")), 256).alias("kept"))


@query("link_density", rf"""
WITH m AS (SELECT doc_id, pos, CASE WHEN pos % 3 = 0 THEN '- [' || substr(line, 1, 20) || '](/a) [b](/b) [c](/c)' ELSE line END AS x FROM {BLOCKS})
SELECT doc_id, pos, len(regexp_extract_all(x, '{T.LINK}')) >= 2
  AND len(regexp_extract_all(x, '{T.LINK}')) * 5 >= greatest(1, len({sql_tokens("x")})) AS dense,
  CAST(CASE WHEN trim(x) <> '' AND regexp_matches(x, '^\s*([-*]|[0-9]+[.)]\s)') THEN 1 ELSE 0 END AS INTEGER) AS listed,
  CAST(CASE WHEN trim(x) <> '' AND regexp_matches(x, '^\s*([-*]|[0-9]+[.)]\s)') AND regexp_matches(x, '{T.LINK}') THEN 1 ELSE 0 END AS INTEGER) AS linked
FROM m
""")
def link_density(spark, sf_dir):
    x = F.when(
        F.col("pos") % 3 == 0, F.concat(F.lit("- ["), F.substring("line", 1, 20), F.lit("](/a) [b](/b) [c](/c)"))
    ).otherwise(F.col("line"))
    shares = T.list_shares(F.col("x"))
    return blocks(spark, sf_dir).withColumn("x", x).select(
        "doc_id", "pos", T.link_dense(F.col("x")).alias("dense"), shares["listed"].alias("listed"), shares["linked"].alias("linked")
    )


#: Every fourth line made a heading, of level 2 or 3, so that documents have sections.
MARKDOWN_SQL = f"(SELECT doc_id, pos, CASE WHEN pos % 8 = 0 THEN '## ' || line WHEN pos % 4 = 0 THEN '### ' || line ELSE line END AS line FROM {BLOCKS})"


def with_headings(column="text"):
    return F.transform(
        F.split(column, "\n"),
        lambda x, i: F.when(i % 8 == 0, F.concat(F.lit("## "), x)).when(i % 4 == 0, F.concat(F.lit("### "), x)).otherwise(x),
    )


@query("section_count", f"""
SELECT doc_id, CAST(count(*) FILTER (WHERE starts_with(line, '## ') OR starts_with(line, '### ')) AS INTEGER) AS sections,
  min(trim(regexp_replace(line, '^\\s*#+[ \\t]*', ''))) FILTER (WHERE pos = 0) AS title
FROM {MARKDOWN_SQL} GROUP BY doc_id
""")
def section_count(spark, sf_dir):
    markdown = F.array_join(with_headings(), "\n")
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return docs.select("doc_id", T.section_count(markdown).alias("sections"), F.coalesce(T.title_of(markdown), F.lit("")).alias("title"))


@query("url_forms", r"""
WITH u AS (SELECT page_id, url, regexp_extract(url, '^([a-zA-Z]+)://', 1) AS s, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS h,
  regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) AS q, regexp_extract(url, '#(.*)$', 1) AS f FROM pages)
SELECT page_id, lower(s) || '://' || h || CASE WHEN p = '' THEN '/' ELSE p END || q AS cache_url,
  lower(regexp_replace(lower(s) || '://' || h || CASE WHEN p = '' THEN '/' ELSE p END, '/+$', '')) AS knowledge_url,
  regexp_replace(h, '^www\.', '') AS host, nullif(substr(url_decode(f), 1, 512), '') AS fragment
FROM u
""")
def url_forms(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", T.cache_url(url).alias("cache_url"), T.knowledge_url(url).alias("knowledge_url"),
        T.host_key(url).alias("host"), T.url_fragment(url).alias("fragment"),
    )
