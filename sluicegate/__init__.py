"""Prompt-risk scoring over tables and streams of prompts, on Spark.

The five layers and the two jobs that combine them, each from DataFrame to DataFrame.
"""

from sluicegate.operators.classifier import analyze_classifier as classifier
from sluicegate.operators.lexicon import lexicon_score as lexicon
from sluicegate.operators.mutation import mutation_report as mutation
from sluicegate.operators.nearest import add_similarity as similarity
from sluicegate.operators.sanitize import sanitize
from sluicegate.plans.gateway import Detectors, analyze, gateway, rejected
from sluicegate.session import build_session

__all__ = [
    "Detectors",
    "analyze",
    "build_session",
    "classifier",
    "gateway",
    "lexicon",
    "mutation",
    "rejected",
    "sanitize",
    "similarity",
]
