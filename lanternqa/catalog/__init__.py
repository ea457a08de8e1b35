"""Every operator as a query over the given tables, beside SQL that must agree."""

from lanternqa.catalog import datasets, events, inference, multihop, prompts, retrieval, scoring, sources, text  # noqa: F401
from lanternqa.catalog.registry import ORACLES, QUERIES  # noqa: F401
