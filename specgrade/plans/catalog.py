"""Imports every plan module so the registry is complete."""

from specgrade.plans import corpus_plans, list_plans, score_plans, quality_plans, pairing_plans, inference_plans, usage_plans, extra_plans, stage_plans, rule_plans, contract_plans  # noqa: F401
from specgrade.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
