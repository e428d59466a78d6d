"""Who may read a page: evidence out of its markup or text, the disposition it leads to, and what to try next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import classify as C

# Needles and limits that results depend on.
USABLE = 600
PASSWORD = ('type="password"', "type='password'")
IDENTITY = ('type="email"', "type='email'", 'autocomplete="username"', "autocomplete='username'", 'name="username"', "name='username'")
LOGIN_ACTION = (
    'action="/login', "action='/login", 'action="/signin', "action='/signin", 'action="/sign-in', "action='/sign-in",
    'action="/session', "action='/session",
)
LOGIN_BUTTON = (">log in", ">sign in", ">login")
LOGIN_HEADING = ("<h1>sign in", "<h1>log in", "<h1>login", "<h2>sign in", "<h2>log in", "<h2>login")
TERMS = ("authentication", "authorization", "openid", "oauth", "bearer token", "basic auth", "password", "sign in", "log in", "login")
PASSWORD_LINES = ("password", "password:", "password: ______")
IDENTITY_LINES = ("email", "email:", "username", "username:")
HEADING_LINES = ("# sign in", "# log in", "# login", "## sign in", "## log in", "## login")
ACTION_LINES = ("please log in to continue.", "please sign in to continue.", "log in", "sign in")
#: Failures that no changed recipe can mend, and those that one may.
TERMINAL = (
    "captcha_or_challenge", "private_url_blocked", "workers_unavailable", "timeout", "invalid_arguments", "invalid_policy",
    "invalid_url", "invalid_failure_reason",
)
HEALABLE = (
    "thin_extract", "extraction_failed", "content_extraction_failed", "content_selectors_miss", "playbook_verify_failed",
    "playbook_verify_low_score", "playbook_verify_high_noise",
)
#: Extracted text over so many characters is content, whatever it mentions.
CHALLENGE_TEXT = 2000
LEAST_VERIFIED, LEAST_SCORE = 100, 70
SPA_MARKERS = ('id="app"', "id='app'", 'id="root"', 'id="__next"', "__next_data__", "__nuxt__", "data-reactroot")
CHALLENGE_HOSTS = ("captcha", "hcaptcha", "challenges.cloudflare")
CHALLENGE_QUERIES = ("__cf_chl", "challenge=")


def login_redirect(requested: Column, final: Column) -> Column:
    moved = (F.trim(F.coalesce(final, F.lit(""))) != "") & (F.lower(requested) != F.lower(final))
    return F.coalesce(moved & C.is_login_path(final), F.lit(False))


def page_evidence(html: Column, requested: Column, final: Column, status: Column, challenged: Column) -> Column:
    """Evidence of a fetched page, null markup being empty."""
    low = F.lower(F.coalesce(html, F.lit("")))
    button = low.contains("<button") & T.contains_any(low, LOGIN_BUTTON)
    return F.struct(
        status.alias("status"), challenged.alias("challenged"), login_redirect(requested, final).alias("redirected"),
        T.contains_any(low, PASSWORD).alias("password"), T.contains_any(low, IDENTITY).alias("identity"),
        (T.contains_any(low, LOGIN_ACTION) | button).alias("action"), T.contains_any(low, LOGIN_HEADING).alias("heading"),
        (C.visible_length(html) >= USABLE).alias("usable"), T.contains_any(low, TERMS).alias("terms"),
    )


def text_evidence(markdown: Column, requested: Column, final: Column, status: Column) -> Column:
    """Evidence of extracted text: whole lines that stand for a form's labels."""
    low = F.lower(F.coalesce(markdown, F.lit("")))
    lines = F.transform(F.split(low, "\n"), lambda x: F.trim(x))

    def has(names):
        return F.arrays_overlap(lines, F.array(*[F.lit(n) for n in names]))

    return F.struct(
        status.alias("status"), F.lit(False).alias("challenged"), login_redirect(requested, final).alias("redirected"),
        has(PASSWORD_LINES).alias("password"), has(IDENTITY_LINES).alias("identity"), has(ACTION_LINES).alias("action"),
        has(HEADING_LINES).alias("heading"), (F.length(low) >= USABLE).alias("usable"), T.contains_any(low, TERMS).alias("terms"),
    )


def disposition(e: Column) -> Column:
    """(disposition, confidence, codes, action) of evidence: restricted, open or unknown."""
    blocking = e["password"] & (e["identity"] | e["action"] | e["heading"]) & ~e["usable"]
    shut = F.array_compact(F.array(
        F.when(e["status"] == 401, "http_401"), F.when(e["challenged"], "authentication_challenge"),
        F.when(e["redirected"], "redirected_to_login"), F.when(blocking, "blocking_identity_ui"),
    ))
    read = F.array_compact(F.array(F.lit("usable_public_content"), F.when(e["terms"], "authentication_terminology_non_decisive")))
    unsure = F.array_compact(F.array(
        F.when(e["terms"], "authentication_terminology_only"), F.when(e["password"], "password_field_without_blocking_context"),
    ))

    def told(name, confidence, codes, action):
        return F.struct(F.lit(name).alias("disposition"), F.lit(confidence).alias("confidence"), codes.alias("codes"), F.lit(action).alias("action"))

    none = F.array(F.lit("insufficient_access_evidence"))
    return (
        F.when(F.size(shut) > 0, told("restricted", 0.95, shut, "use_session"))
        .when(e["usable"], told("open", 0.85, read, "continue"))
        .otherwise(told("unknown", 0.25, F.when(F.size(unsure) > 0, unsure).otherwise(none), "retry_or_inspect"))
    )


def spa_stub(html: Column) -> Column:
    """A page without an article that a script would fill: little text and a mount point."""
    return (C.visible_length(html) < C.STUB_TEXT) & T.contains_any(F.lower(F.coalesce(html, F.lit(""))), SPA_MARKERS)


def challenge_url(url: Column) -> Column:
    """Whether an address is that of a challenge; a page whose name mentions one is not."""
    host, path = T.url_host(url), F.lower(T.url_path(url))
    query = F.lower(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1))
    segment = F.arrays_overlap(F.split(path, "/"), F.array(F.lit("challenge"), F.lit("js_challenge")))
    hit = T.contains_any(host, CHALLENGE_HOSTS) | path.contains("/cdn-cgi/challenge-platform") | T.contains_any(query, CHALLENGE_QUERIES) | segment
    return F.coalesce((host != "") & hit, F.lit(False))


def terminal_failure(code: Column) -> Column:
    return code.isin(*TERMINAL) | code.startswith("http_4") | code.startswith("http_5")


def offers_heal(code: Column, warnings: Column, session: Column, final: Column, requested: Column) -> Column:
    """Whether a failure may be mended by another recipe. ``warnings``: array of strings; ``session``: one was used."""
    c = F.lower(F.trim(F.coalesce(code, F.lit(""))))
    c = F.when(c == "anti_bot", "captcha_or_challenge").otherwise(c)
    low = F.transform(F.coalesce(warnings, F.array().cast("array<string>")), F.lower)
    challenged = F.exists(low, lambda w: T.contains_any(w, ("anti_bot", "likely_challenge", "js_challenge")) | w.startswith("challenge_kind:"))
    poor = F.exists(low, lambda w: w.startswith("content_selectors_miss") | T.contains_any(w, ("degraded_quality", "noise_only")))
    return (
        F.when(challenge_url(final) | challenge_url(requested) | challenged, False).when(c == "", poor)
        .when(c.isin("requires_login", "http_401", "http_403"), session).when(terminal_failure(c), False)
        .when(c.isin(*HEALABLE), True).otherwise(poor)
    )


def cascade(df: DataFrame, attempts: str, reference: Column) -> DataFrame:
    """``df`` with the attempt that a reader would have been given, and how many were needed.

    ``attempts``: array of (backend, usable, code, rank), in order: plain, browser, managed. The first usable one ends it;
    a resource that is gone, or a public reference page, is not tried again; where none is usable, the more
    telling of the first two stands, the browser's if they tell as much.
    """
    a = F.col(attempts)
    first, second = a[0], F.try_element_at(a, F.lit(2))
    gone = first["code"].isin("http_404", "http_410") | reference
    used = F.when(first["usable"] | gone | second.isNull(), F.slice(a, 1, 1)).when(second["usable"], F.slice(a, 1, 2)).otherwise(a)
    usable = F.filter(used, lambda x: x["usable"])
    fallback = F.when((F.size(used) > 1) & (second["rank"] >= first["rank"]), second).otherwise(first)
    chosen = F.when(F.size(usable) > 0, usable[0]).otherwise(fallback)
    return df.withColumns({
        "backend": chosen["backend"], "ok": F.size(usable) > 0, "failure": F.when(F.size(usable) == 0, chosen["code"]), "tries": F.size(used),
    })


def challenge_text(markdown: Column) -> Column:
    """Whether extracted text is that of a challenge page."""
    low = F.lower(markdown)
    needles = [n for _, _, names in C.CHALLENGE_KINDS for n in names]
    return (F.length(markdown) <= CHALLENGE_TEXT) & T.contains_any(low, needles)


def outcome_chain(df: DataFrame, markdown: str, url: Column, final: Column, status: Column, session: Column) -> DataFrame:
    """``df`` with ``failure`` of extracted text: a challenge, then a login that no session opened, then too little content.

    The first that fits decides; null is a success. Blank text is left to the failure that it came with.
    """
    md = F.coalesce(F.col(markdown), F.lit(""))
    login = ~session & (disposition(text_evidence(md, url, final, status))["disposition"] == "restricted")
    judged = C.quality_report(df.withColumn("__md", md), "__md")  # drops what starts with two underscores
    out = judged.withColumn("failure", F.when(challenge_text(md), "captcha_or_challenge").when(login, "requires_login").when(F.col("bad"), "thin_extract"))
    out = out.withColumn("failure", F.when(F.trim(md) != "", F.col("failure")))
    return out.select(*df.columns, "failure")


def verify_recipe(df: DataFrame, markdown: str, host: Column, hosts: Column, failure: Column) -> DataFrame:
    """``df`` with ``verdict`` of a recipe tried on a page: null if it passes, else why it does not.

    ``hosts``: array of the recipe's hosts, each of which stands for its subdomains too; ``failure``: of the trial.
    """

    def bare(h):
        return F.regexp_replace(F.lower(h), r"^www\.", "")

    fits = F.exists(hosts, lambda h: (bare(host) == bare(h)) | bare(host).endswith(F.concat(F.lit("."), bare(h))))
    judged = C.quality_gate(df, markdown)
    short = F.length(F.coalesce(F.col(markdown), F.lit(""))) < LEAST_VERIFIED
    verdict = (
        F.when(~F.coalesce(fits, F.lit(False)), "playbook_schema_invalid").when(failure.isNotNull() | short, "playbook_verify_failed")
        .when(F.col("passes"), F.lit(None).cast("string")).when(F.col("gate_score") < LEAST_SCORE, "playbook_verify_low_score")
        .otherwise("playbook_verify_high_noise")
    )
    return judged.withColumn("verdict", verdict).drop("gate_score", "gate_noise", "passes")
