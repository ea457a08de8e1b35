"""Dataset preparation."""

from lanternqa.catalog.registry import EXCHANGES_SQL, documents, exchanges, query, table
from lanternqa.functions.hashing import mix_sql
from lanternqa.operators import datasets as ds


@query(
    f"SELECT doc_id, CASE WHEN {mix_sql('doc_id', 7)} % 100 < 65 THEN 'train' ELSE 'eval' END AS split FROM documents"
)
def random_split(spark, sf):
    return ds.random_split(table(spark, sf, "documents").select("doc_id"), "doc_id", 65, 7)


@query(
    """SELECT position - 800 AS index, event_id, props
FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS position FROM events) WHERE position >= 800"""
)
def tail_split(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "props")
    return ds.tail_split(rows, "event_id", 800).select("index", "event_id", "props")


@query(f"WITH {EXCHANGES_SQL} SELECT *, '' AS llm_response, 0 AS similarity_score FROM exchanges")
def add_result_columns(spark, sf):
    return ds.add_result_columns(exchanges(spark, sf))


@query(
    rf"""WITH t AS (
  SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\f\x0B]+') AS tk FROM documents),
b AS (SELECT doc_id, len(tk) AS n_tokens, array_to_string(tk, ' ') AS text, len(tk) // 64 AS bucket FROM t)
SELECT doc_id, n_tokens, text, bucket,
  (row_number() OVER (PARTITION BY bucket ORDER BY doc_id) - 1) // 4 AS batch_no FROM b""",
    ints=('n_tokens',),
)
def length_buckets(spark, sf):
    return ds.length_buckets(documents(spark, sf).select("doc_id", "text"), "text", "doc_id")
