"""Column expressions shared by every job. All are native, so they stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from holdfast.config import DEFAULT, RECENCY_BINS, RISK_TIERS, Settings


def clip(value: Column, low: float, high: float) -> Column:
    """Bound a value; null stays null (plain greatest/least would skip it)."""
    bounded = F.greatest(F.lit(low), F.least(F.lit(high), value))
    return F.when(value.isNotNull(), bounded)


def flag(condition: Column) -> Column:
    """1 when the condition holds, 0 when it does not or is unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def stable(value: Column) -> Column:
    """Drop float noise, so thresholds and ranks do not depend on summation order."""
    return F.round(value, 9)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null on a zero or null divisor."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


# --- recency, adoption, flags ---------------------------------------------------


def recency_score(days: Column) -> Column:
    return 1 - clip(days / F.lit(60.0), 0.0, 1.0)


def recency_category(days: Column) -> Column:
    """Right-closed bins: exactly 0 and anything past the last edge have no label."""
    label = F.lit(None).cast("string")
    for low, high, name in reversed(RECENCY_BINS):
        label = F.when((days > low) & (days <= high), name).otherwise(label)
    return label


def adoption_rate(features_used: Column, cfg: Settings = DEFAULT) -> Column:
    return features_used / F.lit(float(cfg.features_available))


def health_score(
    recency: Column, adoption: Column, decay: Column, tickets: Column, corrected: bool = False
) -> Column:
    """0-100 composite.

    The default keeps the established formula, in which a falling engagement
    *adds* to the third term and the support term is ``1 - 5 * tickets``.
    ``corrected=True`` gives every term a 0-25 range with the intended sign.
    """
    change = clip(decay, -100.0, 100.0)
    if corrected:
        stability = (100 + clip(decay, -100.0, 0.0)) / 100 * 25
        support = (1 - clip(tickets / F.lit(5.0), 0.0, 1.0)) * 25
    else:
        stability = (100 - change) / 100 * 25
        support = 1 - tickets / F.lit(5.0) * 25
    return clip(recency * 25 + adoption * 25 + stability + support, 0.0, 100.0)


# --- probability to decision ------------------------------------------------------


def risk_tier_model(p: Column, cfg: Settings = DEFAULT) -> Column:
    """Right-closed bins on (0, 1]; 0 and out-of-range values have no tier."""
    low, high = cfg.model_tier_cuts
    return (
        F.when((p > 0) & (p <= low), RISK_TIERS[0])
        .when((p > low) & (p <= high), RISK_TIERS[1])
        .when((p > high) & (p <= 1), RISK_TIERS[2])
    )


def risk_tier_business(p: Column, cfg: Settings = DEFAULT) -> Column:
    """Left-closed cuts; an unknown probability counts as high risk."""
    low, high = cfg.business_tier_cuts
    return F.when(p < low, RISK_TIERS[0]).when(p < high, RISK_TIERS[1]).otherwise(RISK_TIERS[2])


def recommendation(p: Column, health: Column) -> Column:
    # Cuts and wording of the five recommendations.
    return (
        F.when((p > 0.6) & (health < 40), "Urgent Account Review")
        .when((p > 0.6) & (health < 50), "Onboarding Support")
        .when(p > 0.5, "Engagement Campaign")
        .when(p > 0.3, "Executive Check-in")
        .otherwise("Monitor")
    )


def predicted_churn(p: Column, cfg: Settings = DEFAULT) -> Column:
    return flag(p > cfg.predicted_above)


def revenue_at_risk(revenue: Column, p: Column, months: int) -> Column:
    return revenue * p * months


def risk_segment(flag_count: Column) -> Column:
    """(-1,0] low, (0,2] medium, (2,5] high."""
    return (
        F.when((flag_count > -1) & (flag_count <= 0), RISK_TIERS[0])
        .when((flag_count > 0) & (flag_count <= 2), RISK_TIERS[1])
        .when((flag_count > 2) & (flag_count <= 5), RISK_TIERS[2])
    )


# --- journey ------------------------------------------------------------------------


def journey_phase(logins: Column, days: Column, engagement: Column, features: Column) -> Column:
    """struct<phase, health> of one customer-period."""

    def state(phase: str, health: str) -> Column:
        return F.struct(F.lit(phase).alias("phase"), F.lit(health).alias("health"))

    # Cuts and names of the five phases.
    return (
        F.when((logins < 0.5) & (days > 30), state("Disengaged", "Critical"))
        .when((logins < 1.0) & (engagement < 40), state("Declining", "Warning"))
        .when(features < 3, state("Low Adoption", "At Risk"))
        .when(engagement < 50, state("Moderate", "Monitor"))
        .otherwise(state("Healthy", "Good"))
    )


def journey_risk(churned: Column, logins: Column, features: Column, engagement: Column) -> Column:
    # Cuts and names of the five risk levels.
    return (
        F.when(churned == 1, "CHURNED")
        .when(logins < 0.5, "Critical")
        .when((logins < 1.0) | (features < 3), "High")
        .when(engagement < 50, "Medium")
        .otherwise("Low")
    )


# --- text ----------------------------------------------------------------------------


def decimals(value: Column, places: int) -> Column:
    """Fixed-point text, half-even on the binary value, without thousands marks."""
    pattern = "0" if places == 0 else "0." + "0" * places
    return F.call_function("format_number", value, F.lit(pattern))


def percent(share: Column, places: int = 1) -> Column:
    return F.concat(decimals(share * 100, places), F.lit("%"))


def money(amount: Column, places: int = 0) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount, places))


def fill_template(template: str, *values: Column) -> Column:
    """Concatenate a text with one column per ``{}`` slot."""
    pieces = template.split("{}")
    if len(pieces) != len(values) + 1:
        raise ValueError(f"template has {len(pieces) - 1} slots, got {len(values)} values")
    parts = [F.lit(pieces[0])]
    for value, text in zip(values, pieces[1:]):
        parts += [value.cast("string"), F.lit(text)]
    return F.concat(*parts)
