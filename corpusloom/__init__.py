"""Code corpora to instruction-tuning datasets, as Spark jobs."""

from corpusloom.operators.registry import DEFAULT_REGISTRY, ExtractorRegistry, PatternKind
from corpusloom.plans.dataset import (
    DatasetConfig, Extraction, build_dataset, build_style_profile, extract, select_examples, training_text,
)

__all__ = [
    "DEFAULT_REGISTRY", "DatasetConfig", "Extraction", "ExtractorRegistry", "PatternKind",
    "build_dataset", "build_style_profile", "extract", "select_examples", "training_text",
]
