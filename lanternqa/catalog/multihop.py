"""Multi-hop questions."""

from pyspark.sql import functions as F

from lanternqa.catalog.registry import QUESTIONS_SQL, TEXTS_SQL, best_piece_sql, query, questions, table, texts
from lanternqa.catalog.retrieval import evidence_sql, gather_sql, relevance_sql
from lanternqa.functions import prompts as pr
from lanternqa.operators import hops, readers
from lanternqa.plans import answer
from lanternqa.plans.gather import MODEL_LIMIT

_BASE = f"{QUESTIONS_SQL}, {TEXTS_SQL}"


@query(
    """WITH RECURSIVE edges AS (
  SELECT DISTINCT a.text AS question, b.text AS followup
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
walk AS (
  SELECT DISTINCT text AS root, text AS question, 0 AS depth FROM conversations WHERE turn = 0
  UNION
  SELECT root, followup, depth + 1 FROM walk JOIN edges USING (question) WHERE depth < 40)
SELECT root, question, min(depth) AS depth FROM walk GROUP BY root, question"""
)
def decompose_questions(spark, sf):
    turns = table(spark, sf, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("followup"))
    edges = turns.join(after, ["conv_id", "turn"]).select(F.col("text").alias("question"), "followup")
    seeds = turns.filter("turn = 0").select(F.col("text").alias("root"), F.col("text").alias("question"))
    return hops.decompose_questions(seeds, hops.table_followups(edges))


_SENTENCES = r"list_filter(list_transform(regexp_split_to_array(question, '[.\n]'), lambda s: trim(s, E' \n.')), lambda s: s <> '')"


@query(
    rf"""WITH {_BASE},
last AS (SELECT q_id, regexp_replace({_SENTENCES}[-1] || '?', '^.*:', '') AS question FROM questions),
asked AS (SELECT DISTINCT question AS q_id, question FROM last),
{gather_sql('asked', 'info')}
SELECT last.q_id, chr(10) || coalesce(info.information, '') AS answer, 2 AS hops, false AS forced
FROM last LEFT JOIN info ON info.q_id = last.question"""
)
def multi_hop_answer(spark, sf):
    return answer.multi_hop_answer(questions(spark, sf), texts(spark, sf), readers.sentence_hops(2))


_ROOM = MODEL_LIMIT - len(pr.RELEVANCE.replace("{1}", "").replace("{2}", ""))
_ANSWER_BARE = len(pr.ANSWER.replace("{1}", "").replace("{2}", ""))


def answers_sql(known: str, rounds: int, name: str) -> str:
    """Answers from (q_id, question, information): in pieces, then from the pieces' answers, for up to `rounds` rounds."""
    steps, done = [f"round_0 AS (SELECT *, CAST(NULL AS BIGINT) AS before FROM {known})"], []
    for r in range(rounds):
        steps.append(f"""sized_{r} AS (SELECT *, greatest({MODEL_LIMIT} - {_ANSWER_BARE} - length(question), 1) AS room FROM round_{r}),
counted_{r} AS (SELECT *, greatest(CAST(ceil(length(information) / room) AS BIGINT), 1) AS pieces FROM sized_{r}),
told_{r} AS (SELECT q_id, question, pieces, no, {best_piece_sql('question', 'part', '. ')} AS answer
  FROM (SELECT *, substr(information, CAST(no * room + 1 AS BIGINT), room) AS part
    FROM (SELECT *, unnest(range(pieces)) AS no FROM counted_{r} WHERE before IS NULL OR before <= 1 OR pieces < before))),
round_{r + 1} AS (SELECT q_id, question, coalesce(string_agg(answer, '. ' ORDER BY no), '') AS information, pieces AS before
  FROM told_{r} WHERE pieces > 1 GROUP BY q_id, question, pieces)""")
        done.append(f"SELECT q_id, answer FROM told_{r} WHERE pieces = 1")
        done.append(f"SELECT q_id, information FROM counted_{r} WHERE before > 1 AND pieces >= before")
    return ",\n".join(steps) + f",\n{name} AS ({' UNION ALL '.join(done)})"


@query(
    f"""WITH {_BASE},
parts AS (
  SELECT DISTINCT root, question FROM (
    SELECT question AS root, question FROM questions
    UNION ALL
    SELECT question, unnest(CASE WHEN len({_SENTENCES}) > 1 THEN {_SENTENCES} ELSE [] END) FROM questions)),
asked AS (SELECT DISTINCT question AS q_id, question FROM parts),
{evidence_sql('asked', 25, ' ', 'w')},
evidence AS (
  SELECT root, string_agg(question, ' ' ORDER BY question) AS question,
    string_agg(coalesce(windows, ''), '' ORDER BY question) AS text
  FROM parts LEFT JOIN w ON w.q_id = parts.question GROUP BY root),
{relevance_sql('evidence', 'root', str(_ROOM), '---', 'info', in_order=True)},
known AS (SELECT q_id, question, coalesce(information, '') AS information
  FROM questions LEFT JOIN info ON info.root = questions.question),
{answers_sql('known', 5, 'told')}
SELECT q_id, answer FROM told"""
)
def answer_question(spark, sf):
    return answer.answer_question(questions(spark, sf), texts(spark, sf))
