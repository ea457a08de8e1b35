"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternqa.llm.byte_pairs import encoding_report
from lanternqa.llm.decontamination import contamination_report, find_contamination
from lanternqa.llm.embeddings import near_vectors
from lanternqa.llm.hard_negatives import hard_negatives
from lanternqa.llm.language import fit_languages, identify
from lanternqa.llm.language_model import score_texts
from lanternqa.llm.lines import line_bitmaps, line_report
from lanternqa.llm.near_dups import near_duplicates
from lanternqa.llm.packing import pack
from lanternqa.llm.personal_data import find_personal_data, personal_data_report
from lanternqa.llm.prefix_trie import conversation_paths, conversation_turns, prefix_trie, with_heads
from lanternqa.llm.secret_scan import find_secrets, fit_ratio, secret_report
from lanternqa.llm.substrings import repeated_spans, span_report

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# From `links` (a, b) and `ids` (id): the smallest id that each one reaches.
_REACH = """both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (
  SELECT id, id FROM ids UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
component AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def vocabulary() -> tuple[str, str]:
    """The path of the byte-level vocabulary as ranks, and its pre-split."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query
def op1_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    return span_report(docs, repeated_spans(docs))


# Windows as lists of words; the earliest by document and start is the one that stays.
ORACLES["op1_substring_dedup"] = r"""WITH cut AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM cut),
windows AS (
  SELECT doc_id, i, list_slice(ws, i + 1, i + 20) AS run
  FROM (SELECT doc_id, ws, unnest(range(greatest(len(ws) - 19, 0))) AS i FROM cut)),
judged AS (SELECT doc_id, i, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) > 1 AS again FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM judged WHERE again),
kept AS (
  SELECT word.doc_id, count(*) AS n_words, count(gone.pos) AS n_removed,
    coalesce(string_agg(w, ' ' ORDER BY word.pos) FILTER (gone.pos IS NULL), '') AS text
  FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.pos = word.pos GROUP BY word.doc_id)
SELECT documents.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)"""


@query
def op2_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    return secret_report(find_secrets(docs, fit_ratio(docs)))


@query
def op3_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    return line_report(docs, line_bitmaps(docs))


ORACLES["op3_line_dedup"] = r"""WITH cut AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM cut),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (key IN (SELECT key FROM common)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (key NOT IN (SELECT key FROM common)), ''))
    AS kept_sha256
FROM keyed GROUP BY doc_id"""


@query
def op4_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = find_contamination(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))
    return contamination_report(found)


_WINDOWS = """SELECT {key}, n, i, list_slice(ws, i + 1, i + n) AS run
  FROM (SELECT *, unnest(range(len(ws) - n + 1)) AS i FROM (SELECT *, unnest({sizes}) AS n FROM {table}) WHERE n BETWEEN 1 AND len(ws))"""
ORACLES["op4_benchmark_decontamination"] = f"""WITH
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM benchmark),
items AS ({_WINDOWS.format(key='item_id', table='b', sizes='[least(len(ws), 13)]')}),
sizes AS (SELECT list(DISTINCT n) AS all_sizes FROM items),
runs AS ({_WINDOWS.format(key='doc_id', table='d', sizes='(SELECT all_sizes FROM sizes)')}),
hits AS (SELECT doc_id, item_id, runs.n, runs.i FROM runs JOIN items USING (run)),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(ws), false) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)"""


@query
def op5_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack(documents(spark, sf), *vocabulary()).drop("ids")


@query
def op6_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    scores = score_texts(documents(spark, sf), "crc32(cast(doc_id AS string)) % 5 <> 1")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    return scores.select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query
def op7_embedding_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"))


ORACLES["op7_embedding_near_dedup"] = f"""WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
valid AS (SELECT * FROM v WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0
  AND list_max(list_transform(x, lambda c: abs(c))) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM valid p JOIN valid q
  ON p.label = q.label AND p.vec_id < q.vec_id AND len(p.x) = len(q.x) AND list_cosine_similarity(p.x, q.x) >= 0.93e0),
ids AS (SELECT vec_id AS id FROM v), {_REACH},
n AS (SELECT a AS id, count(*) AS n_links FROM both_ways GROUP BY a)
SELECT c.id AS vec_id, coalesce(n_links, 0) AS n_links, component_id, c.id = component_id AS kept
FROM component c LEFT JOIN n USING (id)"""


@query
def op8_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = fit_languages(docs.filter(~held))
    flags = identify(docs, model)
    return flags.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op9_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(documents(spark, sf))


ORACLES["op9_minhash_near_dedup"] = f"""WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(ws) > 1
  THEN list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) ELSE ws END AS s FROM cut),
one AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
shared AS (SELECT p.doc_id AS a, q.doc_id AS b, p.n + q.n AS total, count(*) AS shared FROM one p JOIN one q
  ON p.shingle = q.shingle AND p.doc_id < q.doc_id AND 100 * least(p.n, q.n) >= 80 * greatest(p.n, q.n) GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * shared >= 80 * (total - shared)),
ids AS (SELECT doc_id AS id FROM sets), {_REACH}
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN component ON component.id = sets.doc_id"""


@query
def op10_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    return personal_data_report(find_personal_data(documents(spark, sf)))


@query
def op11_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    turns = conversation_turns(spark.read.parquet(f"{sf}/conversations.parquet"))
    conv = F.col("conv_id")
    rebuilt = with_heads(turns, conv - conv % 100, (F.crc32(conv.cast("string")) % 6).cast("int"), 5)
    return prefix_trie(conversation_paths(rebuilt))


# The checksum goes bit by bit: each character is followed by eight shifts.
_CRC32 = """xor(list_reduce(flatten(list_transform(string_split({x}, ''), lambda ch: [ascii(ch), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda crc, step: CASE WHEN step >= 0 THEN xor(crc, step) WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END,
    CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"""
ORACLES["op11_prefix_trie"] = f"""WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, coalesce(role, ''),
      sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base,
    {_CRC32.format(x="CAST(conv_id AS VARCHAR)")} % 6 AS h FROM turns),
parts AS (
  SELECT ids.conv_id, pos, role, text FROM ids JOIN turns ON turns.conv_id = base AND pos <= h
  UNION ALL SELECT conv_id, pos, role, text FROM ids JOIN turns USING (conv_id) WHERE pos > h),
whole AS (SELECT ids.conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY pos) FILTER (pos IS NOT NULL), []) AS path
  FROM ids LEFT JOIN parts USING (conv_id) GROUP BY ids.conv_id),
prefix AS (SELECT conv_id, d AS depth, list_slice(path, 1, d) AS node, d = len(path) AS ended
  FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM whole)),
nodes AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256
  FROM prefix GROUP BY node, depth),
edges AS (SELECT list_slice(node, 1, depth - 1) AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
valued AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children,
    CASE WHEN depth > 0 THEN (n_convs - 1) * length(node[depth].text) ELSE 0 END AS own FROM nodes LEFT JOIN edges USING (node)),
above AS (SELECT list_slice(node, 1, k) AS node, own, n_children FROM (SELECT *, unnest(range(depth + 1)) AS k FROM valued)),
below AS (SELECT node, count(*) FILTER (n_children = 0) AS n_leaves, sum(own) AS saved FROM above GROUP BY node)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, v.ends_sha256
FROM valued v JOIN below USING (node) LEFT JOIN nodes p ON v.depth > 0 AND p.node = list_slice(v.node, 1, v.depth - 1)"""


@query
def op12_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = rows.filter(F.col("label").isNotNull() & finite).select(
        F.col("vec_id").alias("id"), label.alias("label"),
        F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("vector"),
    )
    return hard_negatives(vectors, F.col("id") % 100 == 0)


ORACLES["op12_hard_negatives"] = """WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM (
  SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM scored WHERE same)
  WHERE place <= 5),
ranked AS (SELECT p.anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
    AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 10"""


@query
def op13_byte_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return encoding_report(documents(spark, sf), *vocabulary())
