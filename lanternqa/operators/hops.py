"""Expanding a question into the follow-up questions below it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternqa.functions.hashing import text_key
from lanternqa.operators.spread import grid_join
from lanternqa.session import materialize


def table_followups(edges: DataFrame) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Follow-ups of a level of questions, from a table (question, followup).

    Questions meet by digests, so what is told about frequent ones is small however long they are.
    """
    links = edges.select(text_key("question").alias("_key"), "followup").filter(F.col("followup").isNotNull()).distinct()
    links = materialize(links, "links")

    def expand(level: DataFrame, reached: DataFrame) -> DataFrame:
        asked = level.select("root", text_key("question").alias("_key"))
        return grid_join(asked, links, ["_key"], ["root"], ["followup"]).select("root", "followup")

    return expand


def decompose_questions(
    seeds: DataFrame, expand: Callable[[DataFrame, DataFrame], DataFrame],
    max_depth: int | None = None,
) -> DataFrame:
    """Questions reachable from each root: root, question, depth (the least one).

    `seeds` is (root, question); `expand(level, reached)` gives (root, followup) for a
    level of questions. Each level is expanded once for all roots; pairs seen
    before are dropped, so shared and circular follow-ups are expanded once.
    Levels are written out to cut the lineage. The expansion ends by itself
    when it gives nothing new. An expansion that may not, as a model's, can be
    given a `max_depth`: then a column `open` marks the questions at that depth,
    which were not expanded.
    """
    level = seeds.select("root", "question", F.lit(0).alias("depth")).distinct()
    level = materialize(level, "level-0")
    reached = level
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = expand(level, reached).select("root", F.col("followup").alias("question")).distinct()
        fresh = step.join(reached.select("root", "question"), ["root", "question"], "left_anti")
        level = materialize(fresh.withColumn("depth", F.lit(depth)), f"level-{depth}")
        if level.isEmpty():
            break
        reached = reached.unionByName(level)
    return reached if max_depth is None else reached.withColumn("open", F.col("depth") == max_depth)
