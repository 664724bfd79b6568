"""Multi-step jobs: features, models, evaluation, registry and forecast flows."""
