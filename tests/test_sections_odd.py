"""The section query against its SQL on lines that the tables do not have."""

import random

import duckdb

from pagemill import queries

PARTS = ["ab", "Th", "é", "|", "###", "a%%%", "&&&", "#", "##", "token", "=", '"x"', ".", "-", "_", "x.y", "+1", "ﬁ", "²", "…", " ", " ", "é", "№", "{#x}", "　"]


def test_sections_of_odd_lines_equal_sql(spark, tmp_path):
    rng = random.Random(5)
    texts = ["", "\n\n\n\n", *("\n".join(" ".join(rng.choice(PARTS) for _ in range(rng.randrange(5))) for _ in range(rng.randrange(1, 10))) for _ in range(1500))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["sections"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(queries.SQL["sections"])
    assert want.columns == got.columns
    a, b = sorted(map(tuple, got.collect())), sorted(want.fetchall())
    odd = [(x, [r for r in b if r[:2] == x[:2]], texts[x[0]]) for x in a if x not in set(b)]
    assert not odd and a == b, odd[:4]
