import random

import re

from pagemill.llm.line_dedup import cut_out, op3_sentence_hash_dedup, repeated_units, units, without_repeats


def words(text):
    return tuple(re.findall(r"\w+", text.lower()))


def plain_units(text, paragraphs=False):
    """(start, end, words) of lines with a word and of sentences of four words, each span once, by plain scanning."""
    out, at = set(), 0
    for line in (text or "").split("\n"):
        spans, start = [(0, len(line))], 0
        for k in range(1, len(line) + 1):
            if k == len(line) or (line[k - 1] in ".!?" and line[k].isspace()):
                if len(words(line[start:k])) >= 4:
                    spans.append((start, k))
                start = k
        sizes = [len(words(line[s:e])) for s, e in spans]
        for k, ((s, e), n) in enumerate(zip(spans, sizes, strict=True)):
            piece = line[s:e]
            # a line with the words of one of its sentences is that sentence
            if n and (k or n != max(sizes[1:], default=0)):
                out.add((at + s + len(piece) - len(piece.lstrip()), at + s + len(piece.rstrip()), words(piece)))
        at += len(line) + 1
    if paragraphs:
        for m in re.finditer(r"[^\n]+(\n[^\n]+)+", text or ""):
            if sum(bool(words(x)) for x in m[0].split("\n")) > 1:
                out.add((m.start() + len(m[0]) - len(m[0].lstrip()), m.start() + len(m[0].rstrip()), words(m[0])))
    return sorted(out)


def plain_repeats(rows, paragraphs=False):
    first, want = {}, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for s, e, seq in plain_units(text, paragraphs):
            if first.setdefault(seq, (doc, s)) != (doc, s):
                want.append((doc, s, e, len(seq), *first[seq]))
    return sorted(want, key=str)


def test_units_and_offsets():
    text = "One two three four. Five six, seven eight!\n  short one\nnine ten 11 twelve thirteen"
    got = [(text[s:e], n) for s, e, n, _ in units(text, 4)]
    assert got == [("One two three four.", 4), ("Five six, seven eight!", 4), ("nine ten 11 twelve thirteen", 5)]
    assert cut_out("a b. c d.\nkeep\ngone", [(0, 4), (15, 19)]) == "c d.\nkeep"


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]

    def sentence():
        return " ".join(rng.choice(vocab) for _ in range(rng.randint(2, 9))).capitalize() + rng.choice(".!?")

    pool = [sentence() for _ in range(30)]
    passage = " ".join(sentence() for _ in range(9))
    rows = []
    for i in range(60):
        parts = [sentence() for _ in range(4)] + rng.sample(pool, 2)
        rng.shuffle(parts)
        rows.append((100 - i, rng.choice(["\n", " "]).join(parts[:3]) + " and " + (passage if i % 7 == 0 else "") + " " + "\n".join(parts[3:])))
    rows += [(None, rows[7][1]), (300, rows[7][1]), (301, ""), (302, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, uid string").repartition(3)
    for least in (1, 25):
        ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
        first, want = {}, []
        for doc, text in ordered:
            run = []
            for s, e, n, d in [*units(text, 4), (0, 0, 0, None)]:
                if d is None or first.setdefault(d, (doc, s)) == (doc, s):
                    total = sum(x[3] for x in run)
                    want += [(*x, total) for x in run if total >= least]
                    run = []
                else:
                    run.append((doc, s, e, n, *first[d]))
        got = [tuple(r) for r in repeated_units(df, min_passage=least, lines=False).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want)) and want
    assert repeated_units(df.limit(0)).count() == 0


def test_query_removes_every_later_unit(spark, tmp_path):
    rows = [
        (1, "Sign up for our daily news.\nSomething of its own stands here."),
        (2, "Another text with words of its own.\nSign up for our daily news."),
        (3, "Ask us. Call now. Go on.\nA third text, not like the others."),
        (4, "Ask us. Call now! Go on.\n!! Hello there my old friend."),
        (5, "Glued onto it that starts elsewhere. A short one in between. It ends in"),
        (6, "Prose before that starts elsewhere. A short one in between. It ends otherwise"),
        (7, None),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    texts = dict(rows)
    got = sorted((r.doc_id, texts[r.doc_id][r.start : r.end], r.keep_doc_id, r.passage_words) for r in op3_sentence_hash_dedup(spark, str(tmp_path)).collect())
    assert got == [
        (2, "Sign up for our daily news.", 1, 6), (4, "Ask us. Call now! Go on.", 3, 6), (6, "A short one in between.", 5, 5),
    ]
    clean = {r.doc_id: r.text for r in without_repeats(df).collect()}
    assert clean == texts | {
        2: "Another text with words of its own.", 4: "!! Hello there my old friend.", 6: "Prose before that starts elsewhere.  It ends otherwise",
    }
    twice = [r.text for r in without_repeats(df.filter("doc_id = 1").unionAll(df.filter("doc_id = 1"))).collect()]
    assert sorted(twice) == ["", texts[1]]


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    short = ["Home", "Read more", "ok.", "Go on. Now", "A b c", "!! --", ""]
    long = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(4, 9))) + rng.choice([".", "!", " x"]) for _ in range(40)]
    rows = []
    for i in range(80):
        lines = [rng.choice([rng.choice(short), rng.choice(long), " ".join(rng.sample(long, 2)), f"own {i} {rng.random()}"]) for _ in range(rng.randint(0, 8))]
        rows.append((i, "\n".join(rng.choice(["", " "]) + x for x in lines)))
    rows += [(200, "Home\n" + "word " * 200_000 + "\nHome"), (201, "Home\n" + "word " * 200_000), (202, None), (203, "")]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, uid string").write.parquet(f"{tmp_path}/documents.parquet")
    fields = ("doc_id", "start", "end", "words", "keep_doc_id", "keep_start")
    got = [tuple(r[f] for f in fields) for r in op3_sentence_hash_dedup(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == plain_repeats(rows) and any(r[3] == 1 for r in got)
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    whole = [tuple(r[f] for f in fields) for r in repeated_units(df, paragraphs=True).collect()]
    assert sorted(whole, key=str) == plain_repeats(rows, paragraphs=True)
    left = {r.doc_id: r.text for r in without_repeats(df).collect()}
    seen = set()
    for doc, text in rows:
        for line in (left[doc] or "").split("\n"):
            if words(line) and text and line in text.split("\n"):
                assert words(line) not in seen, "a later whole line stays"
                seen.add(words(line))
