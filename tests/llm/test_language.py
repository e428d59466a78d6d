import random

from pyspark.sql import functions as F

from pagemill.llm import language

SYLLABLES = {"en": ["th", "ing", "er", "on"], "de": ["sch", "ung", "ein", "ü"], "fr": ["eau", "é", "oi", "que"], "es": ["ción", "ado", "ñ", "os"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        lang = rng.choice(list(SYLLABLES))
        declared = lang if rng.random() < 0.9 else rng.choice(["en", "de", None, "", "x-y", "zh"])
        rows.append((i, text(rng, lang, rng.randint(1, 40)), declared, rng.choice(["a.example.com", "src0", None]), lang))
    edges = [(1000, None, "en", "src0", ""), (1001, "", "de", None, ""), (1002, "123 %% ##", "fr", "src0", ""), (None, text(rng, "de", 30), None, None, "de")]
    df = spark.createDataFrame(rows + edges, "doc_id bigint, text string, lang string, source string, language string").repartition(4)
    out = {r["doc_id"]: r for r in language.identify_documents(df).select("__row.doc_id", "language", "posterior", "accepted").collect()}
    assert len(out) == 404
    assert sum(out[i].language == lang for i, *_, lang in rows) >= 396
    assert all(out[i].language is None and not out[i].accepted for i in (1000, 1001, 1002))
    assert out[None].language == "de" and out[None].accepted
    kept = language.keep_identified(df)
    assert kept.columns == df.columns and kept.count() >= 400
    assert language.identify_documents(df.limit(0)).count() == 0


def test_floor_acts_alike_at_every_size(spark):
    """Text in none of the languages is rejected, and no other, whether few or many rows were fitted."""
    rng = random.Random(5)
    foreign = "rząd ogłosił wczoraj nowe środki wsparcia dla rodzin oraz przedsiębiorstw"
    for n in (40, 800):
        rows = [(i, text(rng, lang, rng.randint(3, 40)), lang, "s") for i, lang in enumerate(rng.choice(list(SYLLABLES)) for _ in range(n))]
        df = spark.createDataFrame([*rows, (9999, foreign, None, "s")], "doc_id bigint, text string, lang string, source string").repartition(2)
        kept = {r.doc_id for r in language.keep_identified(df).select("doc_id").collect()}
        assert kept == set(range(n))


def test_pieces_lose_no_trigram(monkeypatch):
    words = " ".join("abcdefghij"[k % 10] * (1 + k % 7) + "x" for k in range(300))
    whole = [int(g) for p in language._pieces(words) for g in p]
    monkeypatch.setattr(language, "PIECE", 50)
    parts = list(language._pieces(words))
    assert len(parts) > 10 and [int(g) for p in parts for g in p] == whole


def test_host_priors_shrink_towards_domain_and_all(spark):
    counts = spark.createDataFrame(
        [("a.x.org", None, None, 0, 1), ("b.x.org", None, None, 0, 999), ("c.y.org", None, None, 1, 1000), (None, None, None, 1, 5)],
        "host string, declared string, suffix string, language int, n long",
    )
    got = {r.host: r.prior for r in language.host_priors(counts, ["de", "en"]).collect()}
    assert got["a.x.org"][0] > 0.85 and got["c.y.org"][1] > 0.95
    assert all(abs(sum(p) - 1) < 1e-9 for p in got.values())


def test_query_equals_plain_fusion(spark, tmp_path):
    """op9 over a small table against the same evidence fused in plain Python."""
    from math import exp, log

    rng = random.Random(7)
    rows = []
    for i in range(120):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, text(rng, lang, rng.randint(1, 12)), rng.choice([lang, lang, "en", "pt-BR", None]), rng.choice(["a.x.org", "b.x.org", "y.net", None])))
    rows += [(200, None, "en", "y.net"), (201, "12 34", None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    folder = f"file://{tmp_path}"
    df = spark.read.parquet(f"{folder}/documents.parquet")
    log_p, floors = language.fit_trigrams(df, F.col("text"), F.col("lang"), language.LANGUAGES)
    n, facts = len(language.LANGUAGES), {}
    for i, t, declared, host in rows:
        grams = [int(g) for p in language._pieces(t) for g in p]
        means = [float(sum(float(log_p[k][g]) for g in grams)) / max(1, len(grams)) for k in range(n)]
        facts[i] = (len(grams), means, (declared or "").split("-")[0] or None, host)
    spoken = [(m.index(max(m)), d, h) for g, m, d, h in facts.values() if g]
    kinds = {d for _, d, _ in spoken if d}
    total = [sum(k == x and d is not None for x, d, _ in spoken) for k in range(n)]
    shares = {d: [log((sum(x == k and e == d for x, e, _ in spoken) + 1) / (total[k] + len(kinds) + 1)) for k in range(n)] for d in kinds}
    every = [sum(x == k for x, _, _ in spoken) for k in range(n)]
    prior = [(v + 1) / (sum(every) + n) for v in every]
    priors = {}
    for host in {h for _, _, h in spoken if h}:
        domain = ".".join(host.split(".")[-2:])
        wide = [sum(x == k and h is not None and h.endswith(domain) for x, _, h in spoken) for k in range(n)]
        own = [sum(x == k and h == host for x, _, h in spoken) for k in range(n)]
        up = [(w + language.DOMAIN_ROWS * p) / (sum(wide) + language.DOMAIN_ROWS) for w, p in zip(wide, prior, strict=True)]
        priors[host] = [(o + language.HOST_ROWS * u) / (sum(own) + language.HOST_ROWS) for o, u in zip(own, up, strict=True)]
    got = {r.doc_id: r for r in language.op9_evidence_language_id(spark, folder).collect()}
    assert len(got) == len(rows)
    for i, (g, means, d, h) in facts.items():
        score = [m * min(g, language.EFFECTIVE_TRIGRAMS) + (shares[d][k] if d in shares else 0) + log(priors[h][k] if h in priors else 1 / n) for k, m in enumerate(means)]
        k = score.index(max(score))
        posterior = 1 / sum(exp(s - score[k]) for s in score) if g else 0.0
        accepted = bool(g) and posterior >= language.MIN_POSTERIOR and means[k] >= floors[k]
        assert (got[i].language, got[i].accepted) == (language.LANGUAGES[k] if g else None, accepted)
        assert abs(got[i].posterior - posterior) < 1e-4


def test_pages(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, f"http://h{i % 3}.example.net/fr/{i}", f'<html lang="fr"><script>x</script><p>{text(rng, "fr", 20)}</p>') for i in range(20)]
    rows += [(20, None, None), (21, "http://x.de/a", f"<p>{text(rng, 'fr', 20)}")]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = {r.page_id: r for r in language.page_languages(spark, f"file://{tmp_path}").collect()}
    assert all(out[i].language == "fr" and out[i].suffix == "fr" for i in range(20))
    assert out[20].language is None and out[21].suffix == "de" and len(out) == 22
