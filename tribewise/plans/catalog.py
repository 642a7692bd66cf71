"""Imports every query module so the registry is complete."""

from tribewise.plans import q_activity, q_annotate, q_compare, q_embed, q_models, q_sources, q_tables, q_text  # noqa: F401
from tribewise.plans.registry import ORACLES, QUERIES  # noqa: F401
