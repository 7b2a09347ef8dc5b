"""All queries over the engine's own relations; importing this module registers them."""

from scriptorium.plans import analysis_queries, change_queries, correction_queries, dictionary_queries, event_queries, fuzzy_queries, prompt_queries, streaming_queries  # noqa: F401
from scriptorium.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
