import hashlib
import re

from pagemill.llm import pii

BASE = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain(text):
    out = []
    for kind, pattern in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                kind == 0
                or (kind == 1 and all(int(p) <= 255 for p in m[0].split(".")))
                or (kind == 2 and 13 <= len(digits) <= 19 and pii.luhn(digits))
                or (kind == 3 and 9 <= len(digits) <= 15)
            ):
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_plain_patterns():
    import random

    rng = random.Random(5)
    for _ in range(20_000):
        text = "".join(rng.choice("ab.@@-+%_ 0123456789.()é") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == plain(text)
    assert pii.base_spans("a" * 200_000 + "@" + "1" * 200_000) == []


def test_patterns_find_unseen_identifiers(spark):
    seeds = [f"please mail user{i}@site{i}.example.com today, thanks {i}" for i in range(12)]
    texts = [*seeds, "please mail bob (at) hidden (dot) example (dot) com today", "saw eve (at) other (dot) com nearby", "", None]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, base string")
    got = {r.doc_id: r for r in pii.find_personal_data(df.repartition(3)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert [tuple(s) for s in got[i].base] == plain(t or "")
    assert [texts[12][s.start : s.end] for s in got[12].added] == ["bob (at) hidden (dot) example (dot) com"]
    assert not got[13].added and not got[14].added and not got[15].added
    assert pii.find_personal_data(df.limit(0)).count() == 0
    one_each = pii.find_personal_data(df, block_patterns=1, min_instances=13).collect()
    assert not any(r.added for r in one_each)


def brute_added(texts):
    """The method over a list of texts in plain Python: text number -> added spans."""
    seeds, contexts = set(), {}
    for t in texts:
        for k, s, e in pii.seed_spans(t):
            seeds.add((k, pii._instance(k, t[s:e])))
            lefts, right = pii.context(t, s, e)
            for left in lefts:
                if right:
                    contexts.setdefault((k, left, right), set()).add(pii._instance(k, t[s:e]))
    edges, places = {}, []
    for (k, left, right), who in contexts.items():
        if len(who) < pii.MIN_INSTANCES:
            continue
        for n, t in enumerate(texts):
            tokens = list(re.finditer(r"\w+|[^\w\s]", t.lower()))
            words, size = [m[0] for m in tokens], len(left.split())
            for i in range(size, len(words)):
                if words[i - size : i] != left.split() or right not in words[i + 1 :]:
                    continue
                end = words.index(right, i + 1)
                s, e = tokens[i].start(), tokens[end - 1].end()
                if end - i <= pii.SLOT and "\n" not in t[tokens[i - 1].end() : tokens[end].start()]:
                    edges.setdefault((k, left, right), set()).add((k, pii._instance(k, t[s:e])))
                    places.append((n, k, s, e))
    held = set()
    for _ in range(pii.ROUNDS):
        miss = {}
        for who in edges.values():
            good = len([x for x in who if x in seeds or x in held])
            if good >= pii.MIN_INSTANCES and good >= pii.MIN_SHARE * len(who):
                for x in who:
                    miss[x] = miss.get(x, 1) * (1 - good / (len(who) + 1))
        held = {x for x, m in miss.items() if 1 - m >= pii.MIN_SCORE}
    out = {}
    for n, k, s, e in sorted(set(places), key=lambda p: (p[0], p[2], -p[3], p[1])):
        taken = out.setdefault(n, [])
        free = not any(b[1] < e and s < b[2] for b in pii.base_spans(texts[n])) and (not taken or taken[-1][2] <= s)
        if free and (k, pii._instance(k, texts[n][s:e])) in held:
            taken.append((k, s, e))
    return {n: sorted(x) for n, x in out.items() if x}


def test_graph_equals_brute_force_and_is_precise(spark):
    """Labelled texts: contexts of identifiers in odd shapes, contexts of common words, key-like strings, prose."""
    import random

    rng = random.Random(8)
    word = ["river", "stone", "lamp", "green", "walk", "paper", "north", "glass"]

    def prose(n):
        return " ".join(rng.choice(word) for _ in range(n))

    texts, labels = [], {}
    for i in range(500):
        kind, truth = rng.choice([0, 0, 0, 1, 2, 2, 3, 4, 4, 4, 5, 6, 7]), None
        if kind == 0:
            texts.append(f"{prose(4)} Contact me at: u{i}@h{i}.org for more {prose(3)}")
        elif kind == 1:
            truth = rng.choice([f"u{i} [at] h{i} [dot] org", f"u{i} at h{i}"])
            texts.append(f"{prose(4)} contact me at: {truth} for more {prose(3)}")
        elif kind == 2:
            truth = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([12, 38, 38, 38]))) + "a1"
            texts.append(f'{prose(3)}\nsecret_key = "{truth}"\n{prose(3)}')
        elif kind == 3:  # as common words as numbers
            texts.append(f"{prose(2)} the number {rng.choice([f'+1 555 010 {i:04d}', prose(1) + str(i)])} is {prose(2)}")
        elif kind == 4:
            texts.append(f"{prose(2)} server 10.0.{i % 250}.7 answered {prose(2)}")
        elif kind == 5:
            truth = f"10[.]0[.]{i}[.]9"
            texts.append(f"{prose(2)} server {truth} answered {prose(2)}")
        elif kind == 6:
            texts.append(prose(20) + f" {i} contact me {prose(4)}")
        else:
            texts.append("")
        if truth:
            labels[i] = truth
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: [tuple(s) for s in r.added] for r in pii.find_personal_data(df, block_patterns=3).collect() if r.added}
    assert got == brute_added(texts)
    found = {(i, texts[i][s:e]) for i, spans in got.items() for _, s, e in spans}
    right = found & set(labels.items())
    assert len(right) >= 0.95 * len(found) and len(right) >= 0.6 * len(labels), (len(right), len(found), len(labels))


def test_query_columns(spark, tmp_path):
    text = "call +1 (988) 555-2485 or é 10.0.0.255 and 4041894974608795, x.y@z.org"
    spark.createDataFrame([(None, text), (1, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in pii.op4_bootstrapped_pii(spark, f"file://{tmp_path}").collect()}
    want = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in plain(text))
    r = rows[None]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_added, r.n_all) == (1, 1, 1, 1, 0, 4)
    assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and r.spans == want
    assert rows[1].spans == "" and rows[1].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_hidden_seeds_are_recovered_by_the_others_patterns(spark):
    import random

    rng = random.Random(3)
    texts = [f"lamp river contact me at: u{i}@h{i}.org for more walk" for i in range(60)]
    texts += [f'x\nsecret_key = "{"".join(rng.choice("0123456789abcdef") for _ in range(38))}a1"\ny' for _ in range(60)]
    texts += ["card 4000 none", *(f"a{i} b{i} c{i} +1 555 010 {1000 + i} d{i}" for i in range(20))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    out = {r.kind: r for r in pii.held_out_recovery(df).collect()}
    for kind in ("email", "secret"):
        assert out[kind].recovered == out[kind].hidden > 7 and out[kind].wrong == 0 and out[kind].added == out[kind].recovered
    assert out["phone"].recovered == 0 and out["phone"].hidden > 0
    assert pii.held_out_recovery(df.limit(0)).count() == 0
    assert [r.recovered for r in pii.held_out_recovery(df.filter("doc_id = 0")).collect() if r.hidden] in ([], [0])


def test_hidden_keys_of_the_tables_are_recovered(spark):
    out = {r.kind: r for r in pii.pii_held_out(spark, "/root/testdata/sf0.01").collect()}
    print(out)
    assert out["secret"].recovered >= 0.9 * out["secret"].hidden > 0 and out["secret"].wrong == 0


def test_instances_leave_a_task_in_small_batches(spark):
    texts = [f"say key {k:032x}f now and key {k + 1:032x}f now " * 20 for k in range(6)]
    rows = spark.createDataFrame(list(enumerate(texts)), "__uid bigint, __text string").coalesce(1)
    patterns = spark.createDataFrame([(7, pii.SECRET, "say key", "now"), (8, pii.SECRET, "and key", "now")], "pattern bigint, kind int, `left` string, `right` string")
    found = [sorted(map(tuple, pii.extract(rows, patterns, size, n).collect())) for size, n in ((9, pii.FOUND_ROWS), (9, 7), (1, 1))]
    assert found[0] == found[1] == found[2] and len(found[0]) == 6 * 40
    assert all(texts[u][s:e].endswith("f") and e - s == 33 for u, _, _, s, e, _ in found[0])


def test_contexts_of_common_words_are_dropped_early(spark, monkeypatch):
    """What a context extracts is not written when it outnumbers the seeds; the results stay those of all edges."""
    texts = [f"the lamp u{i}@h{i}.org of paper" for i in range(12)] + [f"the lamp w{i} of paper" for i in range(3000)]
    texts += [f"x\ncontact me at: {x} for more" for x in [*(f"a{i}@b{i}.org" for i in range(12)), *(f"a{i} at b{i}" for i in range(4))]]
    # five seeds of ten instances: trusted in the second round only, by what the first one holds
    texts += [f"y\nwrite to us {x} please" for x in [*(f"a{i}@b{i}.org" for i in range(5)), *(f"a{i} at b{i}" for i in range(4)), "zed one"]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    written, plain_materialize = [], pii.materialize

    def counted(df, tag):
        out = plain_materialize(df, tag)
        written.append((tag, out.count()))
        return out

    monkeypatch.setattr(pii, "materialize", counted)
    want = brute_added(texts)
    for slack in (pii.SLACK, 0):
        monkeypatch.setattr(pii.held_instances, "__defaults__", (pii.BLOCK_PATTERNS, slack))
        written.clear()
        assert {r.doc_id: [tuple(s) for s in r.added] for r in pii.find_personal_data(df).collect() if r.added} == want
        assert max(n for tag, n in written if tag != "pii") < 500
        assert len([tag for tag, _ in written if tag == "pii-more"]) == (1 if slack else 2)
    assert want[len(texts) - 1] and not want.get(500)


def test_words_and_marks_are_found_at_once():
    import random

    rng = random.Random(3)
    parts = ["a", "the", ",", ".", "@", "é", "x1", "+", "12", "\n", "ß", "日", "_q", "²", "é", "\x85", " ", "'", "\ud800"]
    for _ in range(300):
        low = "".join(rng.choice(parts) + rng.choice(["", " ", "\t"]) for _ in range(rng.randrange(40)))
        starts, ends, numbers = pii.words_and_marks(low)
        tokens = [(m.start(), m.end()) for m in pii._TOKEN.finditer(low)]
        assert tokens == list(zip(starts.tolist(), ends.tolist()))
        words = [low[s:e] for s, e in tokens]
        assert len(set(zip(words, numbers.tolist()))) == len(set(words)) == len(set(numbers.tolist()))
