"""Frame quality, selection and triage scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgewatch.functions.exact import exact_round


def _unit(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def brightness_score(mean: Column) -> Column:
    return exact_round(F.greatest(F.lit(0.0), 1 - F.abs(mean - 128.0) / 128.0), 4)


def contrast_score(deviation: Column) -> Column:
    return exact_round(F.least(F.lit(1.0), deviation / 64.0), 4)


def motion_score(changed_share: Column, mean_difference: Column) -> Column:
    """From the share of changed pixels and the mean difference; without a frame before (null) it is 1."""
    raw = F.least(F.lit(1.0), 0.7 * (changed_share * 5) + 0.3 * (mean_difference / 255.0 * 3))
    return exact_round(F.coalesce(raw, F.lit(1.0)), 4)


def similarity_score(histogram_correlation: Column, mean_difference: Column) -> Column:
    """From the histogram correlation and mean difference to the reference; without one (null) it is 0."""
    near = F.greatest(F.lit(0.0), 1 - mean_difference / 128.0)
    raw = _unit(0.6 * F.greatest(F.lit(0.0), histogram_correlation) + 0.4 * near)
    return exact_round(F.coalesce(raw, F.lit(0.0)), 4)


def quality_score(sharpness: Column, brightness: Column, contrast: Column, blur: float = 100.0) -> Column:
    """From sharpness and the brightness and contrast scores."""
    return 0.5 * F.least(F.lit(1.0), sharpness / max(3 * blur, 1.0)) + 0.25 * brightness + 0.25 * contrast


def selection_score(quality: Column, similarity: Column, motion: Column) -> Column:
    return 0.4 * quality + 0.35 * (1 - similarity) + 0.25 * motion


# Triage weights (confidence, stationary, thermal, persistence), cuts, names and colours.
WEIGHTS = (0.30, 0.35, 0.20, 0.15)
URGENCIES = ((0.75, "CRITICAL_RESCUE", "#e63946"), (0.50, "MODERATE_SEARCH", "#f4a261"), (None, "LOW_PRIORITY", "#e9c46a"))
GUARDRAIL = "ENFORCED (Recommender Only - Zero Auto-Clearing Permitted)"


def triage_score(confidence: Column, stationary: Column, thermal: Column, hits: Column) -> Column:
    warm = F.when(thermal > 0, F.least(F.lit(1.0), thermal / 10.0)).otherwise(0.0)
    seen = F.least(F.lit(1.0), F.greatest(F.lit(0.1), hits / 10.0))
    still = F.when(stationary, 1.0).otherwise(0.0)
    a, b, c, d = WEIGHTS
    return exact_round(_unit(a * confidence + b * still + c * warm + d * seen), 3)


def _by_score(score: Column, place: int) -> Column:
    out = F.when(score >= URGENCIES[0][0], URGENCIES[0][place])
    return out.when(score >= URGENCIES[1][0], URGENCIES[1][place]).otherwise(URGENCIES[2][place])


def urgency_level(score: Column) -> Column:
    return _by_score(score, 1)


def urgency_color(score: Column) -> Column:
    return _by_score(score, 2)


def movement_status(stationary: Column) -> Column:
    return F.when(stationary, "STATIONARY").otherwise("MOBILE")
