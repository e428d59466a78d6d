"""Page and text classifiers: everything is a projection of one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Needles, thresholds and tables that results depend on.
STUB_MARKERS = (
    'id="app"', "id='app'", 'id="root"', "id='root'", 'id="__next"', "__next_data__", "__nuxt__", "data-reactroot",
    'ng-version="',
)
STUB_TEXT = 500
CONSENT = ("cookie consent", "accept all", "onetrust", "gdpr", "privacy settings", "we use cookies", "consent banner")
CHALLENGE = (
    "captcha-delivery.com", "geo.captcha-delivery.com", "cf-challenge", "hcaptcha", "turnstile", "just a moment",
    "checking your browser", "performance & security by cloudflare", "ray id:", "verify you are human",
    "attention required", "why have i been blocked",
)
LOGIN_TEXT = ("sign in to continue", "log in to continue", "authentication required")
LOGIN_UI = (
    "sign in", "log in", "login-form", 'id="login', 'class="login', "please log in", "please sign in", "member login",
)
LOGIN_SEGMENTS = ("login", "log-in", "log_in", "signin", "sign-in", "sign_in")
PAYWALL = ("subscribe to read", "paywall", "premium subscriber", "unlock this article")
#: (kind, action, needles) in order of precedence, after the rate limit.
CHALLENGE_KINDS = (
    ("turnstile", "skip_url", ("turnstile", "challenges.cloudflare.com/turnstile")),
    ("hcaptcha", "stop", ("hcaptcha.com", "hcaptcha", "newassets.hcaptcha.com")),
    ("datadome", "stop", ("captcha-delivery.com", "geo.captcha-delivery.com", "datadome")),
    ("js_challenge", "session_cookies", (
        "cf-challenge", "challenges.cloudflare.com", "challenge-platform", "checking your browser", "just a moment",
        "performance & security by cloudflare", "ray id:", "enable javascript and cookies",
    )),
    ("generic_challenge", "stop", (
        "captcha", "verify you are human", "attention required", "why have i been blocked",
        "sorry, you have been blocked",
    )),
)
RATE_LIMIT = ("rate limit", "too many requests", "slow down", "retry-after")
#: (tier, http only, page class, quality mode, hosts) in order; the first that fits wins.
TIERS = (
    ("tier_a_docs", True, "documentation", "fast", ("developer.mozilla.org", "nginx.org", "kubernetes.io", "rfc-editor.org", "wikipedia.org")),
    ("spa_docs", False, "documentation", "balanced", ("nuxt.com", "docs.docker.com")),
    ("news_consent", False, "news", "balanced", ("bbc.com", "reddit.com")),
    ("marketplace", False, "marketplace", "balanced", ("ebay.com", "amazon.com")),
    ("anti_bot_blogs", False, "article", "balanced", ("medium.com", "netflixtechblog.com")),
)
NOISE_TERMS = (
    "cookie", "subscribe", "sign in", "accept all", "advertisement", "privacy policy", "table of contents",
    "related posts", "share this article", "sign up for free",
)
SHELL_PHRASES = (
    "continue shopping", "click the button below", "accept cookies", "accept cookie", "cookie consent",
    "consent to continue", "enable javascript", "enable js", "please enable", "are you a robot", "verify you are human",
)
PROMO_PHRASES = (
    "start here", "migration?", "sign up", "subscribe", "buy now", "planning your", "click here", "learn more and buy",
)
NONSENSE_PATHS = (
    "/_next/static", "/webpack", "/chunk", "/hot-update", "/__webpack", "/assets/", "/static/js/", "/static/css/",
    "/node_modules/", "/undefined", "/null",
)
NONSENSE_ENDS = (
    ".js", ".mjs", ".css", ".map", ".woff", ".woff2", ".ttf", ".eot", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico",
    ".webp", ".avif", ".pdf", ".zip", ".gz", ".xml.gz",
)
SOFT_404_TITLES = ("404", "not found", "page not found", "error", "oops")
SOFT_404_PATHS = ("/404", "/not-found", "/error")
DIRECTIVE = (
    r"\b(ignore|disregard|forget)\b[^.\n]{0,40}\b(previous|above|prior|earlier|all)\b[^.\n]{0,20}\b(instruction|prompt|rule|context|message)s?\b"
    r"|\byou\s+are\s+(now|a|an)\b[^.\n]{0,40}\b(assistant|ai|model|system|dan)\b"
    r"|\b(system|assistant|developer)\s*:\s"
    r"|\bnew\s+(instruction|rule|task)s?\b\s*:"
    r"|\bas\s+an\s+ai\b"
    r"|\boverride\b[^.\n]{0,20}\b(previous|prior|system|safety)\b"
)
REGION = (
    r"(^|[ >._#\-\[])(nav|navbar|footer|aside|sidebar|comment|comments|menu|related|promo|advert|advertisement|banner"
    r"|cookie|newsletter|social|share)([ >._#\-\]:]|$)"
)
#: Raw failure codes and what they are folded into.
FAILURES = {
    "networkerror": "network_error", "contentextractionfailed": "content_extraction_failed",
    "invalidarguments": "invalid_arguments", "backendunavailable": "workers_unavailable",
    "backend_unavailable": "workers_unavailable", "aborterror": "timeout", "taskcanceled": "timeout",
    "httpnotfound": "http_404", "not_found": "http_404", "httpforbidden": "http_403", "httpunauthorized": "http_401",
    "enotfound": "dns_error", "eai_again": "dns_error", "eai_noname": "dns_error", "dns_resolution_failed": "dns_error",
    "private_ip_blocked": "private_url_blocked", "cert_has_expired": "tls_error", "depth_zero_self_signed_cert": "tls_error",
    "self_signed_cert_in_chain": "tls_error", "unable_to_verify_leaf_signature": "tls_error",
    "err_tls_cert_altname_invalid": "tls_error", "cert_untrusted": "tls_error", "econnreset": "network_error",
    "etimedout": "network_error", "econnrefused": "network_error", "typeerror": "extraction_failed",
    "referenceerror": "extraction_failed", "rangeerror": "extraction_failed", "syntaxerror": "extraction_failed",
    "evalerror": "extraction_failed", "urierror": "extraction_failed", "error": "extraction_failed",
}
CLOSURES = ("captcha_or_challenge", "requires_login", "http_401", "http_403", "http_404", "http_410")


def visible_text(html: Column) -> Column:
    """Text outside tags, scripts and styles, white space collapsed."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), r"\s+", " "))


def visible_length(html: Column) -> Column:
    return F.length(visible_text(html))


def is_login_path(url: Column) -> Column:
    names = F.transform(F.split(F.lower(T.url_path(url)), "/"), lambda s: F.regexp_replace(s, r"(?<=.)\..*$", ""))
    return F.exists(names, lambda s: s.isin(*LOGIN_SEGMENTS))


def tier_of(host: Column) -> Column:
    """The tier of a host: five short lists, so a projection and not a join."""
    out = None
    for tier, http_only, page_class, mode, hosts in TIERS:
        fits = F.regexp_replace(host, r"^www\.", "").rlike("(^|\\.)(" + "|".join(h.replace(".", "\\.") for h in hosts) + ")$")
        row = F.struct(
            F.lit(tier).alias("tier"), F.lit(http_only).alias("http_only"), F.lit(page_class).alias("page_class"), F.lit(mode).alias("mode")
        )
        out = F.when(fits, row) if out is None else out.when(fits, row)
    return out


def is_reference_page(url: Column) -> Column:
    host, path = T.host_key(url), F.lower(T.url_path(url))
    docs = (tier_of(host)["tier"] == "tier_a_docs") & path.contains("/docs/")
    known = ((host == "rfc-editor.org") & path.contains("/rfc/")) | (host.endswith("wikipedia.org") & path.contains("/wiki/"))
    return ~is_login_path(url) & (F.coalesce(docs, F.lit(False)) | known)


def challenge_kind(lower: Column, status: Column, url: Column, ratio: Column, chars: Column) -> Column:
    """(kind, action) of a bot challenge in a page in lower case; null without one."""
    docs = (status != 429) & (chars >= 500) & (lower.contains("<main") | lower.contains("<article")) & lower.contains("<h2")
    limited = (status == 429) | (T.contains_any(lower, RATE_LIMIT) & (ratio < 0.1) & (chars < 500))

    def hint(kind, action):
        return F.struct(F.lit(kind).alias("kind"), F.lit(action).alias("action"))

    out = F.when(~docs & limited, hint("rate_limit", "retry_later"))
    for kind, action, needles in CHALLENGE_KINDS:
        if kind == "generic_challenge":
            out = out.when(F.lower(url).contains("__cf_chl"), hint("js_challenge", "session_cookies"))
        out = out.when(T.contains_any(lower, needles), hint(kind, action))
    cloud = F.lower(url).contains("cloudflare") | lower.contains("cloudflare")
    return out.when(status.isin(403, 503) & cloud, hint("js_challenge", "skip_url"))


def probe(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``pages`` with the signals of a page: what it is, what stands in the way, how to read it.

    Needles are searched in the raw page in lower case; a null page is an empty one.
    """
    df = pages.withColumns({"visible_chars": visible_length(F.col(html)), "__lower": F.lower(F.coalesce(F.col(html), F.lit("")))})
    lower = F.col("__lower")
    df = df.withColumns({
        "visible_ratio": F.least(F.lit(1.0), F.col("visible_chars") / F.greatest(F.length(lower), F.lit(1))),
        "script_density": F.least(F.lit(1.0), F.regexp_count(lower, F.lit("<script")) / 40.0),
        "has_tables": lower.contains("<table"),
        "consent": T.contains_any(lower, CONSENT),
        "paywall": T.contains_any(lower, PAYWALL),
    })
    ratio, chars = F.col("visible_ratio"), F.col("visible_chars")
    password = T.contains_any(lower, ('type="password"', "type='password'"))
    wall = password & (T.contains_any(lower, LOGIN_UI) | (ratio < 0.04))
    kind = challenge_kind(lower, F.lit(200), F.col(url), ratio, chars)
    spa = ((chars < STUB_TEXT) & T.contains_any(lower, STUB_MARKERS)) | ((ratio < 0.02) & (F.col("script_density") > 0.15))
    shut = T.contains_any(lower, CHALLENGE) | (
        T.contains_any(lower, ("captcha", "please enable js and disable any ad blocker")) & (ratio < 0.05)
    )
    df = df.withColumns({
        "login": is_login_path(F.col(url)) | T.contains_any(lower, LOGIN_TEXT) | (~is_reference_page(F.col(url)) & wall),
        "challenge_kind": kind["kind"],
        "spa_shell": spa,
    })
    exempt = is_reference_page(F.col(url)) & (chars >= 500)
    df = df.withColumn("challenge", (shut | F.col("challenge_kind").isNotNull()) & ~exempt)
    df = df.withColumn("challenge_kind", F.when(F.col("challenge"), F.col("challenge_kind")))
    host = T.url_host(F.col(url))
    news = F.col("consent") | F.coalesce(tier_of(host)["tier"] == "news_consent", F.lit(False)) | host.contains("bbc.") | host.contains("reuters.")
    page_class = (
        F.when(F.col("login"), "login").when(F.col("challenge"), "challenge").when(news, "news")
        .when(host.contains("docs.") | host.contains("learn.microsoft"), "documentation")
        .when(lower.contains("<article") | lower.contains("blog-post"), "article").otherwise("static_article")
    )
    js = F.col("spa_shell") | ((chars < STUB_TEXT) & ((F.col("script_density") > 0.25) | lower.contains("noscript")))
    df = df.withColumns({"page_class": page_class, "needs_javascript": js})
    flags = F.array_compact(F.array(
        F.when(F.col("consent"), "cookie_consent"), F.when(F.col("challenge"), "anti_bot_challenge"),
        F.when(F.col("challenge_kind").isNotNull(), F.concat(F.lit("challenge_kind:"), F.col("challenge_kind"))),
        F.when(F.col("login"), "login_required"), F.when(F.col("paywall"), "paywall"),
        F.when(F.col("spa_shell"), "spa_shell"), F.when(ratio < 0.03, "low_visible_text"),
    ))
    return df.withColumn("risks", flags).drop("__lower")


def recommend(df: DataFrame, url: str = "url") -> DataFrame:
    """A probed page with the way to read it, its expected latency and how well it can be extracted."""
    tier = tier_of(T.url_host(F.col(url)))
    none = F.col("login") | (F.coalesce(tier["tier"] == "anti_bot_blogs", F.lit(False)) & F.col("challenge"))
    plain = F.coalesce(tier["http_only"], F.lit(False)) & ~F.col("challenge")
    browser = F.col("consent") | F.col("spa_shell") | F.col("needs_javascript") | (F.col("visible_ratio") < 0.03)
    backend = F.when(none, "none").when(plain, "http").when(browser, "http_then_browser").otherwise("http")
    latency = F.when(none, 0).when(plain, 800).when(browser, 5000).otherwise(1200)
    df = df.withColumns({"backend": backend, "latency_ms": latency})
    heavy = (F.col("visible_ratio") > 0) & (F.col("visible_ratio") < 0.08) & (F.col("script_density") > 0.5)
    score = (
        F.when(F.col("challenge_kind").isNotNull(), 0.05).when(F.col("login"), 0.15).when(F.col("backend") == "none", 0.3)
        .when(heavy, 0.45).when(F.col("page_class").isin("docs", "article", "reference", "blog"), 0.9).otherwise(0.7)
    )
    return df.withColumn("extractability", score)


def login_wall(markdown: Column, url: Column) -> Column:
    lower = F.lower(markdown)
    phrase = T.contains_any(lower, (*LOGIN_TEXT, "please log in", "please sign in"))
    word = lower.rlike(r"(?<![\p{L}\p{Nd}_-])password(?![\p{L}\p{Nd}_-])") & T.contains_any(lower, ("sign in", "log in"))
    return is_login_path(url) | (~is_reference_page(url) & (phrase | word))


def _clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def _round4(x: Column) -> Column:
    """Half away from zero, on the scaled value."""
    return F.floor(x * 10000 + 0.5) / 10000


def quality_report(df: DataFrame, markdown: str) -> DataFrame:
    """``df`` with score, noise, density, richness, length_prior, bad and verdict of extracted markdown."""
    md = F.trim(F.coalesce(F.col(markdown), F.lit("")))
    df = df.withColumn("__md", md).withColumn("__low", F.lower("__md"))
    md = F.col("__md")
    prose = F.regexp_replace(F.regexp_replace(md, r"!\[[^\]]*\]\([^)]+\)", " "), T.LINK, "$1")
    prose = F.regexp_replace(F.regexp_replace(prose, r"(?m)^#{1,6}\s", " "), r"(?m)^\s*[-*+]\s", " ")
    df = df.withColumns({
        "__prose": F.trim(F.regexp_replace(prose, r"\s+", " ")),
        "__total": F.length(md),
        "__headings": F.regexp_count(md, F.lit(r"(?m)^#{1,6}\s")),
        "__items": F.regexp_count(md, F.lit(r"(?m)^\s*[-*+]\s")),
        "__links": F.regexp_count(md, F.lit(r"\[[^\]]+\]\([^)]+\)")),
        "__bare": F.aggregate(
            F.filter(F.transform(F.split(md, "\n"), lambda x: F.trim(x)), lambda x: ~x.startswith("#")), F.lit(0), lambda a, x: a + F.length(x)
        ),
    })
    prose, total, headings, items, links = (F.col(c) for c in ("__prose", "__total", "__headings", "__items", "__links"))
    df = df.withColumns({
        "__chars": F.length(prose),
        "__ends": F.regexp_count(prose, F.lit(r"[.!?](\s|$)")),
        "__words": F.regexp_extract_all(prose, F.lit(r"([\p{L}\p{N}]{3,})"), 1),
    })
    chars = F.col("__chars")
    df = df.withColumn("__unique", F.size(F.array_distinct(F.transform("__words", F.lower))))
    unique = F.col("__unique")
    shell = (total < 400) & (headings >= 2) & (items == 0) & (links == 0) & (F.col("__bare") < 40)
    definition = (unique >= 12) & (F.col("__ends") >= 1) & (chars >= 80)
    sparse = (total <= 280) & (items == 0) & (headings <= 1) & (links <= 1)
    lower = F.col("__low")

    def hit(condition, weight):
        return F.when(condition, weight).otherwise(0.0)

    promo = sparse & T.contains_any(lower, PROMO_PHRASES)
    thin = (total < 400) & (items < 3) & (links < 3) & (headings < 2) & (chars < 160) & ~definition
    noise = _clamp(
        hit(T.contains_any(lower, SHELL_PHRASES), 0.55)
        + F.when(promo, 0.45).when(sparse & ~definition, 0.35).otherwise(0.0)
        + hit(thin, 0.25) + hit(shell, 0.55)
        + hit((total > 0) & (links * 200.0 / total > 0.4) & (chars < 200), 0.30)
    )
    long_line = F.when((chars >= 40) & ~prose.startswith("#"), 1).otherwise(0)
    sentences = F.least(F.col("__ends") + long_line, F.lit(12))
    variety = F.when(F.size("__words") == 0, 0.0).otherwise(unique / F.size("__words"))
    richness = _clamp(0.45 * _clamp(sentences / 3.0) + 0.35 * variety + 0.20 * _clamp(unique / 40.0))
    short = (chars >= 80) & (chars < 280) & (unique >= 12) & (sentences >= 2)
    richness = F.when(prose == "", 0.0).when(short, F.greatest(richness, F.lit(0.55))).otherwise(richness)
    df = df.withColumns({
        "noise": noise, "density": _clamp(chars / F.greatest(total, F.lit(1))), "richness": richness,
        "length_prior": _clamp(chars / (chars + 120)), "__shell": shell,
    })
    noise, density, richness = F.col("noise"), F.col("density"), F.col("richness")
    df = df.withColumn("score", _clamp(0.35 * (1.0 - noise) + 0.25 * density + 0.25 * richness + 0.15 * F.col("length_prior")))
    score = F.col("score")
    bad = (
        F.when(chars < 40, True).when(noise >= 0.7, True).when(F.col("__shell"), True).when(score >= 0.55, False)
        .when((score >= 0.4) & (density >= 0.45) & (noise < 0.35), False).otherwise(score < 0.4)
    )
    df = df.withColumn("bad", bad)
    verdict = (
        F.when(F.col("bad"), F.when(noise >= 0.55, "noisy").otherwise("thin"))
        .when((total < 500) & (chars < 280), "short_quality").when(score >= 0.7, "rich")
        .otherwise(F.when(noise >= 0.35, "noisy").otherwise("rich"))
    )
    empty = md == ""
    df = df.withColumns({
        "verdict": F.when(empty, "thin").otherwise(verdict), "bad": F.col("bad") | empty,
        **{c: F.when(empty, v).otherwise(_round4(F.col(c))) for c, v in (("score", 0.0), ("noise", 1.0), ("density", 0.0), ("richness", 0.0), ("length_prior", 0.0))},
    })
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def confidence(score: Column, bad: Column, backend: Column, truncated: Column) -> Column:
    lift = F.when(backend == "browser", 0.05).otherwise(0.0) - F.when(truncated, 0.05).otherwise(0.0)
    return F.when(bad, F.least(score, F.lit(0.25))).otherwise(_clamp(_round4(score + lift)))


def quality_gate(df: DataFrame, markdown: str) -> DataFrame:
    """``df`` with gate_score, gate_noise and passes of a recipe's extraction."""
    md = F.coalesce(F.col(markdown), F.lit(""))
    hits = sum((F.when(F.lower(md).contains(t), 1).otherwise(0) for t in NOISE_TERMS), F.lit(0))
    noise = F.least(F.lit(1.0), F.greatest(F.lit(0), hits - 1) / 6.0)
    headings = F.size(F.filter(F.split(md, "\n"), lambda x: x.startswith("#")))
    n = F.length(md)
    kept = F.when(n >= 4000, 0.95).when(n >= 1500, 0.85).when(n >= 600, 0.75).when(n >= 200, 0.65).otherwise(0.35)
    score = F.bround(kept * 30 + (1 - noise) * 25 + F.least(F.lit(1.0), headings / 3.0) * 20 + kept * 15 + 0.85 * 10).cast("int")
    df = df.withColumns({"gate_score": F.when(F.trim(md) == "", 0).otherwise(score), "gate_noise": F.when(F.trim(md) == "", 1.0).otherwise(F.round(noise, 4))})
    return df.withColumn("passes", (F.col("gate_score") >= 70) & (F.col("gate_noise") <= 0.12))


def normal_failure(code: Column) -> Column:
    c = F.replace(F.lower(F.trim(F.coalesce(code, F.lit("")))), F.lit("-"), F.lit("_"))
    table = F.create_map(*[F.lit(x) for kv in FAILURES.items() for x in kv])
    return (
        F.when(c == "", "content_extraction_failed")
        .when(c.startswith("err_ssl") | (c.contains("tls") & c.contains("alert")), "tls_error")
        .when(c.contains("timeout") & c.startswith("und_err"), "timeout")
        .when(c.contains("socket"), "network_error")
        .otherwise(F.coalesce(F.try_element_at(table, c), c))
    )


def status_failure(status: Column) -> Column:
    return (
        F.when((status <= 0) | status.between(200, 299), F.lit(None).cast("string"))
        .when(status.between(400, 599), F.concat(F.lit("http_"), status.cast("string")))
        .otherwise("http_error")
    )


def resolve_failure(code: Column, status: Column) -> Column:
    """The one failure code of an attempt: the status decides, then the worker's own code."""
    own = normal_failure(code)
    own = F.when(own == "content_extraction_failed", "extraction_failed").otherwise(own)
    return F.coalesce(status_failure(status), F.when(F.trim(code) != "", own), F.lit("extraction_failed"))


def is_retryable(code: Column) -> Column:
    return code.isin("timeout", "network_error", "dns_error", "thin_extract", "http_429") | (code.startswith("http_5") & (F.length(code) >= 6))


def informativeness(code: Column) -> Column:
    return (
        F.when(code.isin("http_401", "http_403", "requires_login"), 100).when(code.isin("captcha_or_challenge", "anti_bot_blocked"), 90)
        .when(code == "tls_error", 85).when(code.startswith("http_4"), 80).when(code.startswith("http_5"), 70)
        .when(code == "thin_extract", 60).when(code.isin("timeout", "network_error", "dns_error"), 50)
        .when(code == "content_selectors_miss", 40).otherwise(10)
    )


def trust_tag(text: Column, selector: Column) -> Column:
    """``suspicious`` for text that gives a reader instructions, ``boilerplate`` for page regions, else null."""
    return F.when(text.rlike("(?i)" + DIRECTIVE), "suspicious").when(selector.rlike("(?i)" + REGION), "boilerplate")


def nonsense_link(url: Column, path: Column, title: Column) -> Column:
    """Assets, soft 404 pages and the like, which no reader follows."""
    p, u, t = F.lower(path), F.lower(url), F.lower(F.trim(title))
    ends = "(" + "|".join(e.replace(".", "\\.") for e in NONSENSE_ENDS) + ")"
    soft = F.coalesce(T.contains_any(t, SOFT_404_TITLES), F.lit(False)) | (~p.isin("/", "") & T.contains_any(p, SOFT_404_PATHS))
    return (
        ~T.url_scheme(url).isin("http", "https") | T.contains_any(p, NONSENSE_PATHS) | p.rlike(ends + "$")
        | u.rlike(ends + r"\?") | soft
    )


def output_budget(context: Column) -> Column:
    """A fifth of a client's context, within bounds."""
    return F.least(F.lit(16384), F.greatest(F.lit(512), F.bround(context * 0.2))).cast("int")
