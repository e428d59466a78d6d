"""Arrow tasks hold the results of a bounded number of rows, whatever Spark's batches hold."""

import pyarrow as pa

from pagemill.operators import compile as C
from pagemill.operators import sections as S


def test_results_leave_in_small_batches(spark):
    df = spark.range(1000).selectExpr("id", "concat('## h', id, '\n', 'body ', id) as md").coalesce(1)
    for out in (C.per_text(df, "md", "n", len, pa.int64(), "bigint"), S.with_sections(df, "md")):
        assert out.count() == 1000 and out.select("id").distinct().count() == 1000
    seen = []

    class Frame:
        schema = df.schema
        columns = df.columns

        def mapInArrow(self, apply, schema):
            batch = pa.RecordBatch.from_pydict({"id": list(range(1000)), "md": ["## h\nb"] * 1000})
            seen.append([b.num_rows for b in apply(iter([batch]))])

    C.per_text(Frame(), "md", "n", len, pa.int64(), "bigint")
    S.with_sections(Frame(), "md")
    assert all(sum(s) == 1000 and max(s) <= S.ROWS_AT_ONCE for s in seen)
