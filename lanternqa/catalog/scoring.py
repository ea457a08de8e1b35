"""Scores over part names (short, so that SQL can check them) and over exchanges."""

from pyspark.sql import functions as F

from lanternqa.catalog.registry import exchanges, query, table
from lanternqa.functions import similarity as sm
from lanternqa.operators import readers
from lanternqa.operators import scoring as sc
from lanternqa.plans import evaluate as ev
from lanternqa.session import fan_out, scratch_path

_PARTS = "parts AS (SELECT p_partkey, p_brand, p_name || ' ' || p_type AS a, p_brand || ' ' || p_name AS b FROM part)"


def _parts(spark, sf):
    name = F.col("p_name")
    return fan_out(table(spark, sf, "part"), "p_partkey").select(
        "p_partkey", "p_brand", "p_name", "p_type",
        F.concat(name, F.lit(" "), "p_type").alias("a"), F.concat("p_brand", F.lit(" "), name).alias("b"),
    )


def lcs_sql(pairs: str) -> str:
    """Longest common subsequence of every distinct (a, b) in `pairs`: one step per character of a."""
    return f"""steps(a, b, i, row) AS (
  SELECT a, b, 0, list_transform(range(length(b) + 1), lambda x: 0) FROM (SELECT DISTINCT a, b FROM {pairs})
  UNION ALL
  SELECT a, b, i + 1, list_transform(range(1, length(b) + 2), lambda j: list_max(
    list_transform(range(1, j + 1), lambda m: greatest(row[m],
      CASE WHEN m > 1 AND substr(b, m - 1, 1) = substr(a, i + 1, 1) THEN row[m - 1] + 1 ELSE 0 END))))
  FROM steps WHERE i < length(a)),
lcs AS (SELECT a, b, row[-1] AS n FROM steps WHERE i = length(a)),
ratio AS (SELECT a, b, CASE WHEN a = b THEN 100 WHEN a = '' OR b = '' THEN 0 ELSE
  CAST(round_even(100e0 * (1e0 - (length(a) + length(b) - 2 * n)::DOUBLE / (length(a) + length(b))), 0) AS INTEGER) END AS score
  FROM lcs)"""


def _norm(x: str) -> str:
    return (
        rf"list_filter(string_split(trim(lower(regexp_replace(regexp_replace({x}, '[\x{{80}}-\x{{FF}}]', '', 'g'), "
        rf"'[^\p{{L}}\p{{N}}_]', ' ', 'g'))), ' '), lambda w: w <> '')"
    )


_SORTED = (
    f"sorted AS (SELECT p_partkey, p_brand, array_to_string(list_sort({_norm('a')}), ' ') AS a, "
    f"array_to_string(list_sort({_norm('b')}), ' ') AS b FROM parts)"
)


def _set_sql(source: str, key: str) -> str:
    """Three candidate pairs of each row of `source`(key, a, b)."""
    return f"""sets AS (SELECT {key}, list_distinct({_norm('a')}) AS x, list_distinct({_norm('b')}) AS y FROM {source}),
bits AS (SELECT {key}, array_to_string(list_sort(list_filter(x, lambda w: list_contains(y, w))), ' ') AS sect,
  array_to_string(list_sort(list_filter(x, lambda w: NOT list_contains(y, w))), ' ') AS dx,
  array_to_string(list_sort(list_filter(y, lambda w: NOT list_contains(x, w))), ' ') AS dy
  FROM sets WHERE len(x) > 0 AND len(y) > 0),
three AS (
  SELECT {key}, sect AS a, trim(sect || ' ' || dx) AS b FROM bits
  UNION ALL SELECT {key}, sect, trim(sect || ' ' || dy) FROM bits
  UNION ALL SELECT {key}, trim(sect || ' ' || dx), trim(sect || ' ' || dy) FROM bits)"""


@query(
    f"WITH RECURSIVE {_PARTS}, {lcs_sql('parts')} SELECT p_partkey, score AS similarity FROM parts JOIN ratio USING (a, b)"
)
def similarity_ratio(spark, sf):
    return _parts(spark, sf).select("p_partkey", sm.similarity_ratio(F.col("a"), F.col("b")).alias("similarity"))


@query(
    f"""WITH RECURSIVE {_PARTS}, {_SORTED}, {lcs_sql('sorted')}
SELECT p_partkey, score AS token_sort FROM sorted JOIN ratio USING (a, b)"""
)
def token_sort_ratio(spark, sf):
    return _parts(spark, sf).select("p_partkey", sm.token_sort_ratio(F.col("a"), F.col("b")).alias("token_sort"))


@query(
    f"""WITH RECURSIVE {_PARTS}, {_set_sql('parts', 'p_partkey')}, {lcs_sql('three')}
SELECT p_partkey, max(score) AS token_set FROM three JOIN ratio USING (a, b) GROUP BY p_partkey"""
)
def token_set_ratio(spark, sf):
    return _parts(spark, sf).select("p_partkey", sm.token_set_ratio(F.col("a"), F.col("b")).alias("token_set"))


_OPTIONS = """options AS (SELECT p_partkey, p_name AS a, unnest([
  p_brand || ' ' || p_type || ' ' || p_name, p_brand, p_type || ' ' || p_name]) AS b FROM part)"""


@query(
    f"""WITH RECURSIVE {_OPTIONS}, {_set_sql('options', 'p_partkey')}, {lcs_sql('three')}
SELECT p_partkey, max(score) AS token_set_ratio FROM three JOIN ratio USING (a, b) GROUP BY p_partkey"""
)
def best_option_score(spark, sf):
    gold = F.array("p_brand", F.concat("p_type", F.lit(" "), "p_name"))
    rows = _parts(spark, sf).select("p_partkey", F.col("p_name").alias("answer"), gold.alias("answers"))
    return sc.best_option_score(rows, ["p_partkey"], "answer", "answers")


@query(
    f"""WITH RECURSIVE {_PARTS}, {_SORTED}, {lcs_sql('sorted')}
SELECT p_brand, avg(score) AS mean_score FROM sorted JOIN ratio USING (a, b) GROUP BY p_brand"""
)
def mean_score(spark, sf):
    scored = _parts(spark, sf).select("p_brand", sm.token_sort_ratio(F.col("a"), F.col("b")).alias("score"))
    return sc.mean_score(scored, "score", ["p_brand"])


@query(
    f"""WITH RECURSIVE {_PARTS}, {_SORTED},
sides AS (SELECT a, b FROM parts UNION ALL SELECT a, b FROM sorted), {lcs_sql('sides')},
base AS (SELECT p_partkey, score FROM parts JOIN ratio USING (a, b)),
tuned AS (SELECT p_partkey, score FROM sorted JOIN ratio USING (a, b))
SELECT count(*) AS n, avg(base.score) AS mean_base, avg(tuned.score) AS mean_tuned FROM base JOIN tuned USING (p_partkey)"""
)
def compare_models(spark, sf):
    a, b = F.col("a"), F.col("b")
    base = _parts(spark, sf).select("p_partkey", sm.similarity_ratio(a, b).alias("similarity_score"))
    tuned = _parts(spark, sf).select("p_partkey", sm.token_sort_ratio(a, b).alias("similarity_score_tuned"))
    return sc.compare_models(base, tuned, ["p_partkey"])


@query(
    f"""WITH RECURSIVE {_PARTS}, {_SORTED}, {lcs_sql('sorted')}
SELECT p.p_partkey, p.a AS llm_response, score AS similarity_score
FROM parts p JOIN sorted s USING (p_partkey) JOIN ratio r ON r.a = s.a AND r.b = s.b"""
)
def evaluate_model(spark, sf):
    rows = _parts(spark, sf).select("p_partkey", F.col("a").alias("prompt"), F.col("b").alias("response"))
    scored = ev.evaluate_model(rows, ["p_partkey"], readers.echo_turn)
    return scored.select("p_partkey", "llm_response", "similarity_score")


@query(
    f"""WITH RECURSIVE {_OPTIONS}, {_set_sql('options', 'p_partkey')}, {lcs_sql('three')},
best AS (SELECT p_partkey, max(score) AS token_set_ratio FROM three JOIN ratio USING (a, b) GROUP BY p_partkey)
SELECT p_partkey, p_brand AS question, p_name AS answer, p_brand || ' ' || p_type || ' ' || p_name AS dataset_answers,
  token_set_ratio FROM part JOIN best USING (p_partkey)"""
)
def evaluate_answers(spark, sf):
    parts = _parts(spark, sf)
    gold = F.array("p_brand", F.concat("p_type", F.lit(" "), "p_name"))
    qa = parts.select("p_partkey", F.col("p_brand").alias("question"), gold.alias("answers"))
    return ev.evaluate_answers(qa, parts.select("p_partkey", F.col("p_name").alias("answer")), "p_partkey")


@query(
    f"""WITH RECURSIVE {_OPTIONS}, {_set_sql('options', 'p_partkey')}, {lcs_sql('three')},
best AS (SELECT p_partkey, max(score) AS token_set_ratio FROM three JOIN ratio USING (a, b) GROUP BY p_partkey)
SELECT p_partkey, p_brand AS question, p_name AS answer, p_brand || ' ' || p_type || ' ' || p_name AS dataset_answers,
  token_set_ratio FROM part JOIN best USING (p_partkey)"""
)
def evaluate_questions(spark, sf):
    """A run over every third question, then one over all that goes on from it."""
    parts = _parts(spark, sf)
    gold = F.array("p_brand", F.concat("p_type", F.lit(" "), "p_name"))
    qa = parts.select("p_partkey", F.col("p_brand").alias("question"), gold.alias("answers"))
    done = scratch_path(spark, "scores")

    def work(todo):
        return todo.join(parts.select("p_partkey", F.col("p_name").alias("answer")), "p_partkey")

    ev.evaluate_questions(qa.filter("p_partkey % 3 = 0"), done, work, "p_partkey")
    return ev.evaluate_questions(qa, done, work, "p_partkey")


@query(
    f"""WITH RECURSIVE {_PARTS}, {_SORTED}, {lcs_sql('sorted')}
SELECT count(*) AS n, avg(score) AS mean_base, avg(score) AS mean_tuned
FROM sorted s JOIN ratio r ON r.a = s.a AND r.b = s.b"""
)
def compare_replies(spark, sf):
    """Base and tuned model asked on the same rows; the stand-ins say the same in two ways."""
    rows = _parts(spark, sf).select("p_partkey", F.col("a").alias("prompt"), F.col("b").alias("response"))
    return ev.compare_replies(rows, ["p_partkey"], readers.echo_turn, readers.echo_turns)[1]


@query()
def exchange_scores(spark, sf):
    """Both token scores of every prompt and response at full length; SQL is too slow for these."""
    a, b = F.col("prompt"), F.col("response")
    return sc.spread_rows(exchanges(spark, sf)).select(
        "conv_id", "turn", sm.token_sort_ratio(a, b).alias("token_sort"), sm.token_set_ratio(a, b).alias("token_set")
    )
