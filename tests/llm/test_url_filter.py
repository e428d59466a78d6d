import fnmatch
import random

import numpy as np
from pyspark.sql import Row

from pagemill.llm import url_filter as uf


def codes(text):
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


def test_automaton_equals_fnmatch():
    rng = random.Random(1)
    globs = ["".join(rng.choice("ab*?/") for _ in range(rng.randint(0, 12))) for _ in range(60)]
    texts = ["".join(rng.choice("ab/é") for _ in range(rng.randint(0, 20))) for _ in range(400)] + ["a" * 5000 + "b"]
    fits = uf.WildcardAutomaton([uf.glob_tokens(g) for g in globs]).run([codes(t) for t in texts])
    for t, row in zip(texts, fits, strict=True):
        assert row.tolist() == [fnmatch.fnmatchcase(t, g) for g in globs]


def plain(url):
    after = url.split("://", 1)[1] if url and "://" in url else ""
    host = after[: min([after.find(c) for c in "/?#" if c in after] or [len(after)])]
    path = after[len(host) :]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [r for r in uf.RULES if ("." + host).endswith("." + r[1]) and path.startswith(r[2])]
    best = max(fit, key=lambda r: len(r[1] + r[2]), default=None)
    if best:
        return host, path, best[1] + best[2], best[0]
    bad = any(x + "." in host for x in ("spam-farm", "casino-win", "cheap-pills", "ads-track", "free-bets", "adult-x"))
    return host, path, None, "block" if bad or path.startswith("/ads/") or path.endswith(".exe") else "allow"


def test_judgements(spark):
    urls = [
        "http://A.Example.COM/en/7?x#y", "https://x.com/en/1", "http://com/en/", "http://notcom/en/", "http://example.net/de/81",
        "http://b.example.net/de/9", "ftp://x.org/es/", "http://x.org/ES/", "http://www.spam-farm.example.org/", None, "", "nothing",
        "://", "http://h?/en/", "http://h#://com/en/", "http://x.de/ads/1", "http://ÄX.com/ünï/setup.exe", "http://" + "a" * 3000 + ".com/en/",
        "http://x.net/.com/en/", "a://b://c.com/en/", "http://x.com/en/1", "http://q.org\n/es/1",
    ]
    df = spark.createDataFrame([Row(page_id=i, url=u, host="x", verdict=1) for i, u in enumerate(urls)], "page_id bigint, url string, host string, verdict int")
    got = {r.page_id: tuple(r)[1:] for r in uf.judge_urls(df.repartition(2), "page_id", "url").collect()}
    assert got == {i: plain(u) for i, u in enumerate(urls)}
    assert uf.judge_urls(df.limit(0), "page_id", "url").count() == 0


def test_thousands_of_rules_and_globs(spark):
    """Rules and globs are parameters: three thousand and five hundred of them against plain Python."""
    rng = random.Random(3)
    names = ["".join(rng.choice("abcde") for _ in range(4)) for _ in range(120)]
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h, p in (
        (rng.choice(names) + rng.choice(["", ".net", ".org"]), "/" + "".join(rng.choice("xyz/") for _ in range(rng.randint(0, 5)))) for _ in range(3600)
    )}.values())[:3000]
    globs = [f"*{rng.choice(names)}.*^*{rng.choice('pqr')}{rng.choice('pqr')}*" for _ in range(500)]
    urls = [f"http://{rng.choice(['', 'a.', 'b.c.'])}{rng.choice(names)}{rng.choice(['', '.net', '.org'])}/{''.join(rng.choice('xyzpqr/') for _ in range(8))}" for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in uf.judge_urls(df, "page_id", "url", rules, globs).collect()}
    for i, u in enumerate(urls):
        host, _, path = u.removeprefix("http://").partition("/")
        path = "/" + path
        fit = [r for r in rules if ("." + host).endswith("." + r[1]) and path.startswith(r[2])]
        if fit:
            longest = max(len(r[1] + r[2]) for r in fit)
            assert got[i] in {(r[1] + r[2], r[0]) for r in fit if len(r[1] + r[2]) == longest}
        else:
            hit = any(fnmatch.fnmatchcase("." + host + "\x01" + path, g.replace("^", "\x01")) for g in globs)
            assert got[i] == (None, "block" if hit else "allow")
