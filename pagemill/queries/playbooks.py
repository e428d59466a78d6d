"""Recipes made of pages: what a linter, an exporter and a manifest say of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import integrity as I
from ..operators import playbooks as B
from ..registry import query, table

#: Text of a recipe by page_id % 8; {i} is the page's id.
RECIPES = (
    '{"schema_version":"1.0","id":"p{i}","hosts":["h{i}.net"],"extract":{"contentSelectors":["main"]},"meta":{"title":"T"},"agent_notes":"n"}',
    '{"schema_version":"2.0","id":" ","hosts":["HTTPS://h{i}.net", 5, "a b"],"extract":{"contentSelectors":["", 3]},"routing":{"preferred_backend":"ftp"}}',
    '{"schema_version":1,"id":"p{i}","hosts":[],"extract":{"contentSelectors":"main"},"meta":"T","agent_notes":"n"}',
    '["p{i}"]',
    '{"schema_version": "1.{i}", ',
    " ",
    '{"schema_version":"1.1","id":"p{i}","hosts":["h.net"],"extract":{"contentSelectors":["main","  "]},"knowledge_schema":{"default":{},"doc{i}":{},"api":{}},"genome":{"page_classes":{"api":"/api/*"}},"routing":{"preferred_backend":"browser"},"meta":{"title":"T"}}',
    '{"id":"p{i}","hosts":"h.net","routing":{}}',
)


def _recipe_sql():
    return "replace(CASE page_id % 8 " + " ".join("WHEN {} THEN '{}'".format(k, r.replace("'", "''")) for k, r in enumerate(RECIPES)) + " END, '{i}', CAST(page_id AS VARCHAR))"


def recipes(spark, sf_dir):
    i = F.col("page_id")
    text = F.element_at(F.array(*[F.lit(r) for r in RECIPES]), (i % 8 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.replace(text, F.lit("{i}"), i.cast("string")).alias("recipe"))


def _str(path):
    return f"CASE WHEN json_type(j, '{path}') = 'VARCHAR' THEN json_extract_string(j, '{path}') END"


_STRINGS = "list_transform(json_extract(j, '{}[*]'), lambda x: CASE WHEN json_type(x) = 'VARCHAR' THEN json_extract_string(x, '$') END)"


@query("playbook_lint", rf"""
WITH a AS (SELECT page_id, {_recipe_sql()} AS r FROM pages),
b AS (SELECT page_id, r, CASE WHEN json_valid(r) THEN r::JSON END AS j FROM a),
c AS (SELECT *, trim(r) = '' AS empty, j IS NULL AS invalid, json_type(j) AS kind, {_str("$.schema_version")} AS version, {_str("$.id")} AS id, json_type(j, '$.hosts') AS hk, json_type(j, '$.extract.contentSelectors') AS sk,
  list_filter({_STRINGS.format("$.hosts")}, lambda x: trim(coalesce(x, '')) <> '') AS hosts, {_STRINGS.format("$.extract.contentSelectors")} AS sel,
  json_type(j, '$.routing') = 'OBJECT' AND json_type(j, '$.routing.preferred_backend') IS NOT NULL AS routed, {_str("$.routing.preferred_backend")} AS backend, {_str("$.meta.title")} AS title, {_str("$.agent_notes")} AS notes,
  coalesce(json_keys(j, '$.genome.page_classes'), []) AS classes, coalesce(json_keys(j, '$.knowledge_schema'), []) AS schemas FROM b),
d AS (SELECT *, len(list_filter(hosts, lambda x: regexp_matches(x, '://|/|\s') OR x <> lower(x))) AS loose, len(list_filter(sel, lambda x: trim(coalesce(x, '')) = '')) AS blanks, len(sel) AS n_sel,
  len(list_filter(schemas, lambda x: x <> 'default' AND NOT list_contains(classes, x))) AS unrouted FROM c),
e AS (SELECT *, CASE WHEN empty OR invalid OR kind <> 'OBJECT' THEN 1 ELSE
    CASE WHEN trim(coalesce(version, '')) = '' OR NOT starts_with(version, '1.') THEN 1 ELSE 0 END + CASE WHEN trim(coalesce(id, '')) = '' THEN 1 ELSE 0 END
    + CASE WHEN coalesce(hk, '') <> 'ARRAY' OR len(hosts) = 0 THEN 1 ELSE 0 END + CASE WHEN coalesce(sk, '') <> 'ARRAY' OR n_sel = blanks THEN 1 ELSE 0 END END AS errors,
  CASE WHEN empty OR invalid OR kind <> 'OBJECT' THEN 0 ELSE CASE WHEN hk = 'ARRAY' THEN loose ELSE 0 END + CASE WHEN sk = 'ARRAY' THEN blanks ELSE 0 END
    + CASE WHEN routed AND coalesce(backend, '') NOT IN ('http', 'browser', 'http_then_browser') THEN 1 ELSE 0 END + unrouted + CASE WHEN trim(coalesce(title, '')) = '' THEN 1 ELSE 0 END END AS warnings,
  CASE WHEN empty OR invalid OR kind <> 'OBJECT' OR trim(coalesce(notes, '')) <> '' THEN 0 ELSE 1 END AS infos FROM d)
SELECT page_id, CASE WHEN errors > 0 THEN 'broken' WHEN warnings > 0 THEN 'usable' ELSE 'ready' END AS grade, CAST(errors AS INTEGER) AS errors, CAST(warnings AS INTEGER) AS warnings, CAST(infos AS INTEGER) AS infos FROM e
""")
def playbook_lint(spark, sf_dir):
    df = recipes(spark, sf_dir).select("page_id", B.lint(F.col("recipe")).alias("l"))

    def count(severity):
        return F.size(F.filter("l.issues", lambda i: i["severity"] == severity))

    return df.select("page_id", "l.grade", count("error").alias("errors"), count("warning").alias("warnings"), count("info").alias("infos"))


#: Recipes by page_id % 6 and what must not be shared in them.
SHARED = (
    ('{"id":"p{i}","extract":{"contentSelectors":["main"]},"agent_notes":"mind the \\"password\\": it is words"}', ""),
    ('{"id":"p{i}","deep":[{"API_KEY" : 1}],"request":{"headers":{"Cookie":"a","Accept":"b"}}}', "forbidden_header:Cookie,forbidden_key"),
    ('{"extract":{"contentSelectors":[" BODY ","p"],"domStripSelectors":["div[STYLE*=x]"]}}', "denylist_selector: BODY ,denylist_selector:div[STYLE*=x]"),
    ('{"agent_notes":"send Bearer {i}"}', "forbidden_agent_notes"),
    ("{broken", "forbidden_key,invalid_json"),
    ("[{i}]", "invalid_json"),
)


@query("recipe_hygiene", "SELECT page_id, CASE page_id % 6 " + " ".join(f"WHEN {k} THEN '{want}'" for k, (_, want) in enumerate(SHARED)) + " END AS violations FROM pages")
def recipe_hygiene(spark, sf_dir):
    i = F.col("page_id")
    text = F.element_at(F.array(*[F.lit(r) for r, _ in SHARED]), (i % 6 + 1).cast("int"))
    text = F.replace(text, F.lit("{i}"), i.cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(B.violations(text), ",").alias("violations"))


@query("lesson_export", r"""
WITH a AS (SELECT page_id, len(regexp_extract_all(html, '<p>')) % 14 AS n, regexp_extract(url, '://([^/?#:]*)', 1) || CASE WHEN length(html) % 3 = 0 THEN '-Secret' ELSE '' END AS h FROM pages),
b AS (SELECT *, CASE WHEN length(h) >= 24 OR contains(lower(h), 'secret') THEN 'redacted' ELSE h END AS host, len(list_filter(range(0, least(n, 10)), lambda k: k % 4 <> 3)) AS kept FROM a)
SELECT page_id, CAST(CASE WHEN kept > 0 THEN kept END AS INTEGER) AS lessons, CASE WHEN kept > 0 THEN host END AS host, CASE WHEN kept > 0 THEN 'note ' || h END AS note FROM b
""")
def lesson_export(spark, sf_dir):
    """Lessons of each page's paragraphs about its host, some of them empty, as they may be shared."""
    host = F.concat(F.regexp_extract("url", "://([^/?#:]*)", 1), F.when(F.length("html") % 3 == 0, "-Secret").otherwise(""))
    lesson = F.create_map(F.lit("host"), host, F.lit("note"), F.concat(F.lit("note "), host))
    n = F.regexp_count("html", F.lit("<p>")) % 14
    listed = F.transform(F.slice(F.sequence(F.lit(0), F.lit(14)), F.lit(1), n), lambda k: F.when(k % 4 != 3, lesson))
    out = table(spark, sf_dir, "pages").select("page_id", B.shared_lessons(listed).alias("ls"))
    first = F.try_element_at("ls", F.lit(1))
    return out.select("page_id", F.when(F.col("ls").isNotNull(), F.size("ls")).alias("lessons"), first["host"].alias("host"), first["note"].alias("note"))


@query("manifest_check", """
WITH f AS (SELECT page_id, 'File' || page_id || '.JSON' AS file, coalesce(html, '') AS text FROM pages),
m AS (SELECT 'file' || page_id || '.json' AS file, sha256(replace(coalesce(html, ''), chr(13) || chr(10), chr(10)) || CASE WHEN page_id % 4 = 1 THEN ' ' ELSE '' END) AS sha FROM pages WHERE page_id % 5 <> 0)
SELECT page_id, CASE WHEN sha IS NULL THEN 'unlisted' WHEN sha = sha256(replace(text, chr(13) || chr(10), chr(10))) THEN 'verified' ELSE 'changed' END AS status FROM f LEFT JOIN m ON lower(f.file) = m.file
""")
def manifest_check(spark, sf_dir):
    """Files against a manifest that leaves out every fifth and holds another digest for every fourth."""
    i = F.col("page_id")
    pages = table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("text"))
    files = pages.select("page_id", F.concat(F.lit("File"), i.cast("string"), F.lit(".JSON")).alias("file"), "text")
    digest = B.file_digest(F.concat("text", F.when(i % 4 == 1, " ").otherwise("")))
    manifest = pages.filter(i % 5 != 0).select(F.concat(F.lit("file"), i.cast("string"), F.lit(".json")).alias("file"), F.upper(digest).alias("sha256"))
    return B.verified_files(files, manifest).select("page_id", "status")


#: A recipe for each page out of its own values, its keys in two orders; DuckDB writes it in the one that is hashed.
_RECIPE = """
r AS (SELECT page_id, url, length(html) AS chars, '{"extract":{"chars":' || length(html) || ',"selectors":["article",' || to_json('#p' || page_id)::VARCHAR || ']},"url":' || to_json(url)::VARCHAR || '}' AS canonical FROM pages)
"""


@query("recipe_hash", f"""
WITH {_RECIPE}
SELECT page_id, canonical, 'sha256:' || sha256(canonical) AS content_hash, true AS same, true AS changed FROM r
""")
def recipe_hash(spark, sf_dir):
    """A hash that is the same in any order of keys, whatever is said of provenance, and another once a value differs."""
    chars, name = F.length("html"), F.concat(F.lit("#p"), F.col("page_id").cast("string"))
    selectors = F.array(F.lit("article"), name).alias("selectors")
    one = F.to_json(F.struct("url", F.struct(selectors, chars.alias("chars")).alias("extract"), F.struct(chars.alias("score")).alias("provenance")))
    other = F.concat(F.lit(" "), F.replace(F.to_json(F.struct(F.struct(chars.alias("chars"), selectors).alias("extract"), "url")), F.lit('":'), F.lit('" : ')))
    changed = F.to_json(F.struct(F.struct((chars + 1).alias("chars"), selectors).alias("extract"), "url"))
    return table(spark, sf_dir, "pages").select(
        "page_id", I.canonical_json(one, "provenance").alias("canonical"), I.recipe_hash(one).alias("content_hash"),
        I.recipe_hash(one).eqNullSafe(I.recipe_hash(other)).alias("same"), (I.recipe_hash(one) != I.recipe_hash(changed)).alias("changed"),
    )


@query("recipe_status", f"""
WITH {_RECIPE}, s AS (SELECT *, chars % 5 AS k FROM r)
SELECT page_id, CASE k WHEN 0 THEN 'unsigned' WHEN 1 THEN 'verified' WHEN 2 THEN 'key_mismatch' WHEN 3 THEN 'invalid' ELSE 'unsupported_version' END AS status,
  CASE WHEN k IN (1, 2, 3) THEN CAST(CASE WHEN chars % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) END AS version, CASE WHEN k > 0 THEN CAST(chars AS INTEGER) END AS score FROM s
""")
def recipe_status(spark, sf_dir):
    """What is to be thought of each page's signed recipe: by its size it is unsigned, ours, another's, altered or of a later scheme."""
    chars, name = F.length("html"), F.concat(F.lit("#p"), F.col("page_id").cast("string"))
    k = chars % 5
    body = F.struct(F.struct(F.array(F.lit("article"), name).alias("selectors"), chars.alias("chars")).alias("extract"), "url")
    told = F.when(k == 3, I.content_hash(F.lit("altered"))).otherwise(I.recipe_hash(F.to_json(body)))
    provenance = F.struct(
        F.when(k == 4, "playbook-sig-v9").when(chars % 2 == 0, I.RECIPE_V2).alias("sigScheme"), F.when(k == 2, "other").otherwise("local").alias("keyId"),
        told.alias("contentHash"), F.when(k > 0, "c2ln").alias("signature"), F.struct(chars.alias("score")).alias("verify"),
    )
    text = F.to_json(F.struct("url", body["extract"].alias("extract"), provenance.alias("provenance")))
    status = I.recipe_status(text, F.lit("local"), F.lit(True))
    return table(spark, sf_dir, "pages").select("page_id", status.alias("s")).select("page_id", "s.status", "s.version", "s.score")
