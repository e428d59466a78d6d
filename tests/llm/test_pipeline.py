"""The stages against brute force, each on what the one before kept."""

import random
import re

import corpus_pipeline
from pagemill.llm.decontaminate import words
from tests.llm.test_near_dedup import brute_classes


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    vocab = ["".join(rng.choice(["th", "er", "on", "an", "re", "he"]) for _ in range(rng.randint(1, 4))) for _ in range(600)]

    def text(n):
        return " ".join(rng.choice(vocab) for _ in range(n))

    item = text(40)
    docs = [text(rng.randint(5, 200)) for _ in range(60)]
    docs += [docs[3], docs[3] + "  ", "\t" + docs[4], "", None, "12 %% 34", docs[7] + " " + text(3), text(30) + " " + item + " " + text(20), item[: len(item) // 3]]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(docs)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    folder = f"file://{tmp_path}/in"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")

    kept = {i: t for i, t, *_ in rows}
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, frame, folder).write.parquet(f"file://{tmp_path}/{k}")
        frame = spark.read.parquet(f"file://{tmp_path}/{k}")
        assert [f.name for f in frame.schema] == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "language_id":
            kept = {i: t for i, t in kept.items() if t and re.search(r"[^\W\d_]", t)}
        elif name == "exact_dedup":
            first = {}
            for i, t in sorted(kept.items()):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
            kept = {i: kept[i] for i in first.values()}
        elif name == "near_dedup":
            classes = brute_classes(kept)
            kept = {i: t for i, t in kept.items() if classes[i] == i}
        else:
            kept = {i: t for i, t in kept.items() if " ".join(words(item)) not in " ".join(words(t))}
        assert sorted(r.doc_id for r in frame.collect()) == sorted(kept), name
    packed = corpus_pipeline.run(spark, folder).collect()
    assert sorted({r.doc_id for r in packed}) == sorted(kept)
    for s in {r.sequence_id for r in packed}:
        at = 0
        for r in sorted((r for r in packed if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
