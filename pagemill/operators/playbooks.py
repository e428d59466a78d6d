"""Recipes as JSON text: lint, lessons that may be shared, files checked against a manifest, keys that must not be there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names that results depend on.
BACKENDS = ("http", "browser", "http_then_browser")
LESSONS = 10
TOKEN_LENGTH = 24
TOKEN_WORDS = ("token", "secret", "api_key")
REDACTED = "redacted"
FORBIDDEN_KEYS = (
    "cookie", "cookies", "authorization", "set-cookie", "set_cookie", "bearer", "bearer_token", "api_key", "apikey", "password",
    "secret_key", "session_token", "access_token", "refresh_token",
)
FORBIDDEN_HEADERS = ("cookie", "authorization", "proxy-authorization", "x-api-key", "api-key")
WHOLE_PAGE = ("body", "html", "*")
NOTE_MARKERS = ("cookie:", "authorization:", "bearer ", "password=", "sid=")


def _kind(v: Column) -> Column:
    """The outermost type of a variant: OBJECT, ARRAY, STRING and so on; null if there is none."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _at(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _text(v: Column, path: str) -> Column:
    """A string at ``path``; null for other types."""
    found = _at(v, path, "variant")
    return F.when(_kind(found) == "STRING", _at(v, path, "string"))


def _blank(x: Column) -> Column:
    return F.trim(F.coalesce(x, F.lit(""))) == ""


def _issue(severity: str, field, code: str) -> Column:
    field = F.lit(field) if isinstance(field, str) else field
    return F.struct(F.lit(severity).alias("severity"), field.alias("field"), F.lit(code).alias("code"))


def lint(text: Column) -> Column:
    """(grade, issues) of a recipe: broken with an error, usable with a warning, else ready."""
    v = F.try_parse_json(text)
    version = _text(v, "$.schema_version")
    hosts, selectors = _at(v, "$.hosts", "variant"), _at(v, "$.extract.contentSelectors", "variant")
    host_list = F.transform(_at(v, "$.hosts", "array<variant>"), lambda h: F.when(_kind(h) == "STRING", _at(h, "$", "string")))
    named = F.filter(host_list, lambda h: ~_blank(h))
    loose = F.filter(named, lambda h: h.rlike(r"://|/|\s") | (h != F.lower(h)))
    chosen = F.transform(_at(v, "$.extract.contentSelectors", "array<variant>"), lambda s: F.when(_kind(s) == "STRING", _at(s, "$", "string")))
    blank = F.size(F.filter(chosen, _blank))
    routed = _kind(_at(v, "$.routing", "variant")) == "OBJECT"
    backend = _at(v, "$.routing.preferred_backend", "variant")
    classes = F.coalesce(F.map_keys(_at(v, "$.genome.page_classes", "map<string, variant>")), F.array().cast("array<string>"))
    schemas = F.coalesce(F.map_keys(_at(v, "$.knowledge_schema", "map<string, variant>")), F.array().cast("array<string>"))
    unrouted = F.filter(F.array_sort(schemas), lambda s: (s != "default") & ~F.array_contains(classes, s))

    def when(condition, issue):
        return F.when(F.coalesce(condition, F.lit(False)), issue)

    has_hosts, has_selectors = _kind(hosts) == "ARRAY", _kind(selectors) == "ARRAY"
    single = F.array(
        when(_blank(version), _issue("error", "schema_version", "missing")),
        when(~_blank(version) & ~version.startswith("1."), _issue("error", "schema_version", "unsupported")),
        when(_blank(_text(v, "$.id")), _issue("error", "id", "missing")),
        when(~F.coalesce(has_hosts, F.lit(False)), _issue("error", "hosts", "missing")),
        when(has_hosts & (F.size(named) == 0), _issue("error", "hosts", "empty")),
        when(~F.coalesce(has_selectors, F.lit(False)), _issue("error", "extract.contentSelectors", "missing")),
        when(has_selectors & (F.size(chosen) == blank), _issue("error", "extract.contentSelectors", "empty")),
        when(routed & backend.isNotNull() & ~F.coalesce(_text(v, "$.routing.preferred_backend").isin(*BACKENDS), F.lit(False)), _issue("warning", "routing.preferred_backend", "invalid_backend")),
        when(_blank(_text(v, "$.meta.title")), _issue("warning", "meta.title", "missing")),
        when(_blank(_text(v, "$.agent_notes")), _issue("info", "agent_notes", "missing")),
    )
    none = F.array().cast("array<struct<severity: string, field: string, code: string>>")
    many = F.concat(
        F.coalesce(F.transform(loose, lambda h: _issue("warning", "hosts", "host_not_bare")), none),
        F.coalesce(F.transform(F.filter(chosen, _blank), lambda s: _issue("warning", "extract.contentSelectors", "selector_blank")), none),
        F.transform(unrouted, lambda s: _issue("warning", F.concat(F.lit("knowledge_schema."), s), "unrouted_class")),
    )
    issues = (
        F.when(_blank(text), F.array(_issue("error", "(root)", "empty_input"))).when(v.isNull(), F.array(_issue("error", "(root)", "json_invalid")))
        .when(_kind(v) != "OBJECT", F.array(_issue("error", "(root)", "not_object"))).otherwise(F.concat(F.array_compact(single), many))
    )

    def has(severity):
        return F.exists(issues, lambda i: i["severity"] == severity)

    grade = F.when(has("error"), "broken").when(has("warning"), "usable").otherwise("ready")
    return F.struct(grade.alias("grade"), issues.alias("issues"))


def token_like(value: Column) -> Column:
    """Whether a name looks like a credential."""
    low = F.lower(F.coalesce(value, F.lit("")))
    hit = F.length(low) >= TOKEN_LENGTH
    for word in TOKEN_WORDS:
        hit = hit | low.contains(word)
    return ~_blank(value) & hit


def shared_lessons(lessons: Column) -> Column:
    """The objects among the first ten entries of ``lessons`` (maps of strings; null: no object), credential-like hosts hidden.

    Null if none is left.
    """
    kept = F.filter(F.slice(lessons, 1, LESSONS), lambda m: m.isNotNull())
    safe = F.transform(kept, lambda m: F.transform_values(m, lambda k, v: F.when((k == "host") & token_like(v), REDACTED).otherwise(v)))
    return F.when(F.size(safe) > 0, safe)


def file_digest(text: Column) -> Column:
    return F.sha2(F.replace(text, F.lit("\r\n"), F.lit("\n")), 256)


def verified_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``files`` (file, text) with ``status``: verified, unlisted, or changed since ``manifest`` (file, sha256).

    File names match whatever their case; the last of a manifest's rows for a name would win, so names must be unique there.
    """
    listed = manifest.select(F.lower("file").alias("__file"), F.lower(F.trim("sha256")).alias("__sha"))
    joined = files.withColumn("__file", F.lower("file")).join(listed, "__file", "left")
    status = F.when(F.col("__sha").isNull(), "unlisted").when(F.col("__sha") == file_digest(F.col("text")), "verified").otherwise("changed")
    return joined.withColumn("status", status).drop("__file", "__sha")


def violations(text: Column) -> Column:
    """What keeps a recipe from being shared, sorted: keys, headers, selectors and notes that may carry a secret or take in all.

    A key is found anywhere in the JSON, at any depth; inside a string its quotes would be escaped.
    """
    v = F.try_parse_json(text)
    key = F.lower(text).rlike(r'(?<!\\)"(' + "|".join(FORBIDDEN_KEYS) + r')"\s*:')
    headers = F.map_keys(_at(v, "$.request.headers", "map<string, variant>"))
    none = F.array().cast("array<string>")
    bad_headers = F.transform(F.filter(headers, lambda h: F.lower(h).isin(*FORBIDDEN_HEADERS)), lambda h: F.concat(F.lit("forbidden_header:"), h))
    chosen = F.concat(*[F.coalesce(_at(v, f"$.extract.{name}", "array<string>"), none) for name in ("contentSelectors", "domStripSelectors")])
    wide = F.filter(chosen, lambda x: F.lower(F.trim(x)).isin(*WHOLE_PAGE) | F.lower(x).contains("[style*="))
    notes = F.lower(F.coalesce(_text(v, "$.agent_notes"), F.lit("")))
    marked = F.lit(False)
    for marker in NOTE_MARKERS:
        marked = marked | notes.contains(marker)
    of_object = F.concat(
        F.array_compact(F.array(F.when(key, "forbidden_key"), F.when(marked, "forbidden_agent_notes"))), F.coalesce(bad_headers, none),
        F.transform(wide, lambda x: F.concat(F.lit("denylist_selector:"), x)),
    )
    found = (
        F.when(v.isNull(), F.array(F.lit("forbidden_key"), F.lit("invalid_json")))
        .when(_kind(v) != "OBJECT", F.array_compact(F.array(F.when(key, "forbidden_key"), F.lit("invalid_json")))).otherwise(of_object)
    )
    return F.array_sort(found)
