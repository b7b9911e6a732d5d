"""Imports every query module so that their ``@register`` calls run."""

from tabflow.plans import (q_clean, q_features, q_infer, q_metrics, q_models, q_quality,  # noqa: F401
                           q_resample, q_runs, q_sources, q_split)
