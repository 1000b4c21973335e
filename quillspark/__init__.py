"""Prose signals on Spark: stylometric features, an additive score, a combiner, and their evaluation."""

from .api import lint
from .operators.features import features, features_long
from .operators.gate import gate
from .operators.heuristic import Weights, lint_flat, score, top_issues, verdict
from .operators.parse import parse

__all__ = ["Weights", "features", "features_long", "gate", "lint", "lint_flat", "parse", "score", "top_issues", "verdict"]
