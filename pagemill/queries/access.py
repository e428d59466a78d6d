"""Access, healing and backend choice over pages, documents and attempts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import access as A
from ..operators import classify as C
from ..operators import outcomes as X
from ..registry import query, table
from .classify import _HITS, _MD, LOGIN_PATH, QUALITY_SQL, VISIBLE, markdown
from .text import sql_any

#: Markup around some pages, so that every kind of evidence occurs; both sides do the same.
FORMS = (
    (0, '<h1>Sign in</h1><input type="password">'),
    (1, '<form action="/session"><input type=\'password\'></form>'),
    (2, "<button>log in</button>"),
    (3, '<input type="password"> OAuth'),
)
_FORMS = "CASE page_id % 10 " + " ".join("WHEN {} THEN '{}'".format(k, v.replace("'", "''")) for k, v in FORMS) + " ELSE '' END"
_STATUS = "CASE WHEN page_id % 31 = 0 THEN 401 ELSE 200 END"
_FINAL = "CASE WHEN page_id % 37 = 0 THEN 'https://x.org/account/login.php' WHEN page_id % 41 = 0 THEN upper(requested) ELSE requested END"
DISPOSITION = """
codes AS (SELECT *, CASE WHEN password AND (identity OR action OR heading) AND NOT usable THEN true ELSE false END AS blocking FROM evidence),
judged AS (SELECT *, concat_ws(',', CASE WHEN status = 401 THEN 'http_401' END, CASE WHEN challenged THEN 'authentication_challenge' END, CASE WHEN redirected THEN 'redirected_to_login' END, CASE WHEN blocking THEN 'blocking_identity_ui' END) AS shut FROM codes)
SELECT {key}, CASE WHEN shut <> '' THEN 'restricted' WHEN usable THEN 'open' ELSE 'unknown' END AS disposition, CASE WHEN shut <> '' THEN 0.95 WHEN usable THEN 0.85 ELSE 0.25 END::DOUBLE AS confidence,
  CASE WHEN shut <> '' THEN shut WHEN usable THEN concat_ws(',', 'usable_public_content', CASE WHEN terms THEN 'authentication_terminology_non_decisive' END)
    WHEN terms OR password THEN concat_ws(',', CASE WHEN terms THEN 'authentication_terminology_only' END, CASE WHEN password THEN 'password_field_without_blocking_context' END) ELSE 'insufficient_access_evidence' END AS codes,
  CASE WHEN shut <> '' THEN 'use_session' WHEN usable THEN 'continue' ELSE 'retry_or_inspect' END AS action FROM judged
"""


def _told(key, evidence):
    d = A.disposition(F.col("e"))
    return evidence.select(key, d.alias("d")).select(key, "d.disposition", "d.confidence", F.array_join("d.codes", ",").alias("codes"), "d.action")


@query("access_disposition", f"""
WITH shaped AS (SELECT page_id, coalesce(url, '') AS requested, {_STATUS} AS status, page_id % 43 = 0 AS challenged, coalesce(html, '') || {_FORMS} AS html FROM pages
  UNION ALL SELECT -1 - page_id, coalesce(url, ''), 200, false, {_FORMS} FROM pages),
moved AS (SELECT *, {_FINAL} AS url, lower(html) AS l FROM shaped),
evidence AS (SELECT page_id, status, challenged, trim(url) <> '' AND lower(url) <> lower(requested) AND {LOGIN_PATH} AS redirected, {sql_any("l", A.PASSWORD)} AS password, {sql_any("l", A.IDENTITY)} AS identity,
  {sql_any("l", A.LOGIN_ACTION)} OR (contains(l, '<button') AND {sql_any("l", A.LOGIN_BUTTON)}) AS action, {sql_any("l", A.LOGIN_HEADING)} AS heading, length({VISIBLE}) >= 600 AS usable, {sql_any("l", A.TERMS)} AS terms FROM moved),
""" + DISPOSITION.format(key="page_id"))
def access_disposition(spark, sf_dir):
    i = F.col("page_id")
    form = F.lit("")
    for k, v in FORMS:
        form = F.when(i % 10 == k, v).otherwise(form)
    requested = F.coalesce("url", F.lit(""))
    whole = table(spark, sf_dir, "pages").select("page_id", requested.alias("requested"), F.concat(F.coalesce("html", F.lit("")), form).alias("html"))
    bare = table(spark, sf_dir, "pages").select((-1 - i).alias("page_id"), requested.alias("requested"), form.alias("html"))
    final = F.when(i % 37 == 0, "https://x.org/account/login.php").when(i % 41 == 0, F.upper("requested")).otherwise(F.col("requested"))
    df = whole.unionByName(bare).withColumn("final", final)
    e = A.page_evidence(F.col("html"), F.col("requested"), F.col("final"), F.when((i % 31 == 0) & (i >= 0), 401).otherwise(200), (i % 43 == 0) & (i >= 0))
    return _told("page_id", df.select("page_id", e.alias("e")))


_LABELS = "CASE doc_id % 6 WHEN 0 THEN ' Password: ' || chr(10) || 'username:' WHEN 1 THEN '# Sign in' WHEN 2 THEN 'Log in' WHEN 3 THEN 'password:' ELSE '' END"


def _sql_lines(names):
    return "list_has_any(ls, [" + ", ".join(f"'{n}'" for n in names) + "])"


@query("access_of_text", f"""
WITH shaped AS (SELECT doc_id, lower(coalesce(text, '') || chr(10) || {_LABELS}) AS l FROM documents UNION ALL SELECT -1 - doc_id, lower({_LABELS}) FROM documents),
parts AS (SELECT *, list_transform(string_split(l, chr(10)), lambda x: trim(x)) AS ls FROM shaped),
evidence AS (SELECT doc_id, 0 AS status, false AS challenged, false AS redirected, {_sql_lines(A.PASSWORD_LINES)} AS password, {_sql_lines(A.IDENTITY_LINES)} AS identity, {_sql_lines(A.ACTION_LINES)} AS action,
  {_sql_lines(A.HEADING_LINES)} AS heading, length(l) >= 600 AS usable, {sql_any("l", A.TERMS)} AS terms FROM parts),
""" + DISPOSITION.format(key="doc_id"))
def access_of_text(spark, sf_dir):
    i = F.col("doc_id")
    extra = F.when(i % 6 == 0, " Password: \nusername:").when(i % 6 == 1, "# Sign in").when(i % 6 == 2, "Log in").when(i % 6 == 3, "password:").otherwise("")
    docs, url = table(spark, sf_dir, "documents"), F.lit("http://h.net/a")
    whole = docs.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), extra).alias("md"))
    df = whole.unionByName(docs.select((-1 - i).alias("doc_id"), extra.alias("md")))
    return _told("doc_id", df.select("doc_id", A.text_evidence(F.col("md"), url, url, F.lit(0)).alias("e")))


@query("spa_stubs", f"""
SELECT page_id, length({VISIBLE}) < 500 AND {sql_any("lower(html)", A.SPA_MARKERS)} AS spa_stub FROM (SELECT page_id, coalesce(html, '') || CASE WHEN page_id % 4 = 0 THEN '<div id="ROOT">' ELSE '' END AS html FROM pages UNION ALL SELECT -1 - page_id, '<p>few</p>' || CASE WHEN page_id % 4 = 0 THEN '<div id="ROOT">' ELSE '' END FROM pages)
""")
def spa_stubs(spark, sf_dir):
    i = F.col("page_id")
    root = F.when(i % 4 == 0, '<div id="ROOT">').otherwise("")
    pages = table(spark, sf_dir, "pages")
    whole = pages.select("page_id", F.concat(F.coalesce("html", F.lit("")), root).alias("html"))
    df = whole.unionByName(pages.select((-1 - i).alias("page_id"), F.concat(F.lit("<p>few</p>"), root).alias("html")))
    return df.select("page_id", A.spa_stub(F.col("html")).alias("spa_stub"))


_CODES = ("Thin_Extract", "anti_bot", "http_403", "HTTP_502", "", "timeout", "playbook_verify_low_score", "other", "requires_login", "http_410")
_WARNINGS = ("", "noise_only", "content_selectors_miss:main", "challenge_kind:x", "plain")
_URLS = ("https://h.net/blog/captcha-ux", "https://geo.captcha-delivery.com/x", "https://h.net/js_challenge/1", "https://h.net/a?x=1&__cf_chl=2", "https://h.net/docs")


def _case(key, values):
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


#: What an event's value says: in hundredths, as a whole number.
_VALUES = "(SELECT event_id, CAST(round(coalesce(value, 0) * 100) AS BIGINT) AS v FROM events)"


def _value():
    return F.round(F.coalesce("value", F.lit(0.0)) * 100).cast("bigint")


@query("heal_offer", f"""
WITH a AS (SELECT event_id, lower({_case("v % 10", _CODES)}) AS raw, {_case("v // 10 % 5", _WARNINGS)} AS w, {_case("v // 50 % 5", _URLS)} AS u, v % 3 = 0 AS session FROM {_VALUES}),
b AS (SELECT *, CASE WHEN raw = 'anti_bot' THEN 'captcha_or_challenge' ELSE raw END AS c, starts_with(w, 'content_selectors_miss') OR contains(w, 'noise_only') AS poor,
  starts_with(w, 'challenge_kind:') OR regexp_matches(u, '^https://[^/]*captcha') OR regexp_matches(u, '/js_challenge(/|$)') OR contains(u, '__cf_chl') AS challenge FROM a)
SELECT event_id, CASE WHEN challenge THEN false WHEN c = '' THEN poor WHEN c IN ('requires_login', 'http_401', 'http_403') THEN session
  WHEN c IN ({", ".join(f"'{c}'" for c in A.TERMINAL)}) OR starts_with(c, 'http_4') OR starts_with(c, 'http_5') THEN false WHEN c IN ({", ".join(f"'{c}'" for c in A.HEALABLE)}) THEN true ELSE poor END AS heal FROM b
""")
def heal_offer(spark, sf_dir):
    i = _value()

    def pick(key, values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (key + 1).cast("int"))

    warning = pick(F.floor(i / 10) % 5, _WARNINGS)
    url = pick(F.floor(i / 50) % 5, _URLS)
    heal = A.offers_heal(pick(i % 10, _CODES), F.array(warning), i % 3 == 0, url, F.lit(None).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", heal.alias("heal"))


_KIND = ("usable", "http_404", "http_403", "thin_extract", "timeout", "captcha_or_challenge")
_RANKS = {"usable": 0, "http_404": 80, "http_403": 100, "thin_extract": 60, "timeout": 50, "captcha_or_challenge": 90}


def _rank_sql(x):
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _RANKS.items()) + " END"


@query("backend_cascade", f"""
WITH a AS (SELECT event_id, {_case("v % 6", _KIND)} AS h, {_case("v // 6 % 6", _KIND)} AS b, CASE WHEN v % 5 = 0 THEN {_case("v // 36 % 6", _KIND)} END AS m, v % 11 = 0 AS reference FROM {_VALUES}),
c AS (SELECT *, CASE WHEN h = 'usable' OR h = 'http_404' OR reference THEN 1 WHEN b = 'usable' OR m IS NULL THEN 2 ELSE 3 END AS tries FROM a),
d AS (SELECT *, h = 'usable' OR (tries > 1 AND b = 'usable') OR (tries = 3 AND m = 'usable') AS ok, tries > 1 AND {_rank_sql("b")} >= {_rank_sql("h")} AS second FROM c)
SELECT event_id, CASE WHEN ok THEN CASE tries WHEN 1 THEN 'http' WHEN 2 THEN 'browser' ELSE 'managed' END WHEN second THEN 'browser' ELSE 'http' END AS backend, ok,
  CASE WHEN NOT ok THEN CASE WHEN second THEN b ELSE h END END AS failure, CAST(tries AS INTEGER) AS tries FROM d
""")
def backend_cascade(spark, sf_dir):
    i = _value()

    def attempt(backend, key):
        kind = F.element_at(F.array(*[F.lit(k) for k in _KIND]), (key + 1).cast("int"))
        return F.struct(
            F.lit(backend).alias("backend"), (kind == "usable").alias("usable"), kind.alias("code"),
            F.when(kind == "usable", 0).otherwise(C.informativeness(kind)).alias("rank"),
        )

    tries = [attempt("http", i % 6), attempt("browser", F.floor(i / 6) % 6)]
    managed = attempt("managed", F.floor(i / 36) % 6)
    df = table(spark, sf_dir, "events").select("event_id", i.alias("v"), F.when(i % 5 == 0, F.array(*tries, managed)).otherwise(F.array(*tries)).alias("a"))
    return A.cascade(df, "a", F.col("v") % 11 == 0).select("event_id", "backend", "ok", "failure", "tries")


_NEEDLES = [n for _, _, names in C.CHALLENGE_KINDS for n in names]


@query("outcome_chain", QUALITY_SQL + rf""",
s AS (SELECT *, list_transform(string_split(l, chr(10)), lambda x: trim(x)) AS ls FROM h),
k AS (SELECT doc_id, bad, md, length(md) <= 2000 AND {sql_any("l", _NEEDLES)} AS challenge, {_sql_lines(A.PASSWORD_LINES)} AND ({_sql_lines(A.IDENTITY_LINES)} OR {_sql_lines(A.ACTION_LINES)} OR {_sql_lines(A.HEADING_LINES)}) AND length(md) < 600 AS blocked FROM s)
SELECT doc_id, CASE WHEN trim(md) = '' THEN NULL WHEN challenge THEN 'captcha_or_challenge' WHEN blocked AND doc_id % 4 <> 0 THEN 'requires_login' WHEN bad THEN 'thin_extract' END AS failure FROM k
""")
def outcome_chain(spark, sf_dir):
    """What is wrong with the text of each document, in order of what weighs most; a session opens every fourth."""
    url = F.lit("http://h.net/a")
    return A.outcome_chain(markdown(spark, sf_dir), "md", url, url, F.lit(0), F.col("doc_id") % 4 == 0).select("doc_id", "failure")


@query("recipe_verify", f"""
WITH a AS (SELECT doc_id, md, least(1.0, greatest(0, {_HITS} - 1) / 6.0::DOUBLE) AS noise, least(1.0, len(list_filter(string_split(md, chr(10)), lambda x: starts_with(x, '#'))) / 3.0::DOUBLE) AS s,
  CASE WHEN length(md) >= 4000 THEN 0.95 WHEN length(md) >= 1500 THEN 0.85 WHEN length(md) >= 600 THEN 0.75 WHEN length(md) >= 200 THEN 0.65 ELSE 0.35 END::DOUBLE AS k
  FROM (SELECT doc_id, md || CASE WHEN doc_id % 5 = 0 THEN ' cookie subscribe' ELSE '' END AS md FROM {_MD})),
b AS (SELECT doc_id, md, CAST(round_even(k * 30 + (1 - noise) * 25 + s * 20 + k * 15 + 8.5, 0) AS INTEGER) AS score, round(noise, 4) AS n FROM a)
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'playbook_schema_invalid' WHEN doc_id % 11 = 0 OR length(md) < 100 THEN 'playbook_verify_failed' WHEN score >= 70 AND n <= 0.12 THEN NULL WHEN score < 70 THEN 'playbook_verify_low_score' ELSE 'playbook_verify_high_noise' END AS verdict FROM b
""")
def recipe_verify(spark, sf_dir):
    """Recipes tried on documents: every seventh is for another host, every eleventh trial failed."""
    i = F.col("doc_id")
    df = markdown(spark, sf_dir).withColumn("md", F.concat("md", F.when(i % 5 == 0, " cookie subscribe").otherwise("")))
    host = F.when(i % 7 == 0, "other.net").otherwise("WWW.docs.example.org")
    hosts = F.array(F.lit("x.net"), F.lit("www.example.ORG"))
    return A.verify_recipe(df, "md", host, hosts, F.when(i % 11 == 0, "timeout")).select("doc_id", "verdict")


#: Events as reads and as what was found of access: a signup opens, an error shuts with its value's digit, all else reads.
_ASSESSED = "(SELECT user_id, ts, event_id, CASE WHEN event_type = 'signup' THEN 'open' ELSE 'restricted' END AS disposition, value / 100 AS confidence FROM events WHERE event_type IN ('signup', 'error'))"


@query("read_outcome", f"""
WITH r AS (SELECT event_id, user_id, ts, event_type, value FROM events WHERE event_type NOT IN ('signup', 'error')),
a AS (SELECT user_id, ts, arg_max(disposition, event_id) AS disposition, arg_max(confidence, event_id) AS confidence FROM {_ASSESSED} GROUP BY user_id, ts)
SELECT r.event_id, a.disposition, round_even(a.confidence, 2) AS confidence, CASE a.disposition WHEN 'open' THEN 'continue' WHEN 'restricted' THEN 'use_session' END AS action,
  CASE WHEN event_type = 'view' THEN 'not_requested' WHEN value > 20 THEN 'hit' WHEN value > 10 THEN 'weak' ELSE 'miss' END AS focus,
  CASE WHEN value > 30 THEN 'complete' WHEN value > 5 THEN 'partial' ELSE 'incomplete' END AS completeness
FROM r ASOF LEFT JOIN a ON r.user_id = a.user_id AND r.ts >= a.ts
""")
def read_outcome(spark, sf_dir):
    """Each read with what was last known of the user's access at that time, and how focus and completeness are told."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    kind, value = F.col("event_type"), F.col("value")
    opened = kind == "signup"
    found = F.struct(
        F.when(opened, "Open").otherwise("Restricted").alias("disposition"), (value / 100).alias("confidence"), F.array(kind).alias("codes"),
        F.when(opened, "continue").otherwise("use_session").alias("action"),
    )
    assessments = events.filter(kind.isin("signup", "error")).select("user_id", "ts", "event_id", found.alias("assessment"))
    reads = X.reads_with_access(events.filter(~kind.isin("signup", "error")), assessments, "user_id", ["ts", "event_id"])
    focus = F.when(value > 20, "Hit").when(value > 10, "Weak").otherwise("None")
    asked = F.when(kind != "view", kind)
    done = F.when(value > 30, "Complete").when(value > 5, "Partial").otherwise("Truncated")
    return reads.select(
        "event_id", "access.disposition", "access.confidence", F.col("access.recommended_action").alias("action"),
        X.focus_outcome(focus, asked, F.lit(None).cast("string")).alias("focus"), X.completeness_outcome(done).alias("completeness"),
    )


_ATTEMPTS = """(SELECT user_id AS key, ts, event_id, CASE WHEN event_type = 'error' THEN CASE WHEN value > 15 THEN 'http_403' ELSE 'timeout' END END AS failure, event_type AS fp FROM events WHERE user_id IS NOT NULL)"""


@query("crosscheck", f"""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY key ORDER BY ts, event_id) >= INTERVAL 8 HOURS THEN 1 ELSE 0 END AS cut FROM {_ATTEMPTS}),
r AS (SELECT *, sum(cut) OVER (PARTITION BY key ORDER BY ts, event_id) AS run FROM g),
s AS (SELECT key, run, min(ts) AS start, count(*) AS attempts, count(*) FILTER (WHERE failure IS NULL) AS ok, count(*) FILTER (WHERE failure = 'http_403') AS walls, count(DISTINCT fp) FILTER (WHERE failure IS NULL) AS kinds FROM r GROUP BY key, run)
SELECT key, epoch_us(start) AS start_us, attempts, ok, walls, CASE WHEN ok = 0 AND walls > 0 THEN 'walled' WHEN ok = 0 THEN 'failed' WHEN ok = 1 THEN 'single' WHEN kinds = 1 THEN 'agree' ELSE 'diverge' END AS verdict FROM s
""")
def crosscheck(spark, sf_dir):
    """Each user's events in runs that eight quiet hours part, and whether what was read in a run agrees."""
    kind = F.col("event_type")
    failure = F.when(kind == "error", F.when(F.col("value") > 15, "http_403").otherwise("timeout"))
    attempts = table(spark, sf_dir, "events").filter("user_id is not null").select(
        F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), failure.alias("failure"), kind.alias("fingerprint")
    )
    return X.crosscheck(attempts, "8 hours").select("key", F.unix_micros("start").alias("start_us"), "attempts", "ok", "walls", "verdict")
