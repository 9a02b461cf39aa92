"""Business settings: prices, rates, thresholds and rule tables, in one place."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values: results depend on these exact numbers and texts -----------

TIER_PRICES = {
    "Starter": 500.0,
    "Professional": 2500.0,
    "Enterprise": 10000.0,
}

MONTHLY_CHURN_RATES = {
    ("small", "Starter"): 0.20,
    ("small", "Professional"): 0.12,
    ("small", "Enterprise"): 0.05,
    ("medium", "Starter"): 0.15,
    ("medium", "Professional"): 0.08,
    ("medium", "Enterprise"): 0.03,
    ("large", "Starter"): 0.10,
    ("large", "Professional"): 0.05,
    ("large", "Enterprise"): 0.01,
}

INDUSTRY_MULTIPLIERS = {
    "SaaS": 1.0,
    "Finance": 0.7,
    "Healthcare": 0.8,
    "Retail": 1.3,
    "Other": 1.1,
}

COMPANY_SIZES = ("small", "medium", "large")
RISK_TIERS = ("Low Risk", "Medium Risk", "High Risk")

RECENCY_BINS = (
    (0, 7, "0-7 days"),
    (7, 14, "7-14 days"),
    (14, 30, "14-30 days"),
    (30, 60, "30-60 days"),
    (60, 365, "60+ days"),
)

MODEL_FEATURES = (
    "logins_per_day",
    "api_calls",
    "features_used_count",
    "days_inactive",
    "support_tickets",
    "engagement_score",
    "logins_3m_avg",
    "api_calls_3m_avg",
    "features_3m_avg",
    "logins_trend_3m",
    "engagement_decay",
    "recency_score",
    "feature_adoption_rate",
    "is_high_adoption",
    "is_low_adoption",
    "flag_no_login_30days",
    "flag_no_login_60days",
    "flag_low_feature_adoption",
    "flag_high_support_tickets",
    "flag_declining_engagement",
    "risk_flag_count",
    "health_score",
)

SEGMENT_COLUMNS = ("company_size", "subscription_tier", "industry", "monthly_revenue")


@dataclass(frozen=True)
class Playbook:
    """One retention action and the customers it is meant for."""

    recommendation: str | None
    above_probability: float | None
    below_health: float | None
    above_revenue: float | None
    action: str
    action_type: str
    discount_percent: int
    fixed_cost: float
    revenue_cost_share: float
    retained_months: int
    confidence: float
    timing: str
    rationale: str
    success_probability: float


PLAYBOOKS = (
    Playbook("Urgent Account Review", 0.6, 40.0, None,
             "Urgent Discount + Personal Outreach", "discount_and_outreach",
             20, 0.0, 0.20, 12, 0.85, "Within 24 hours",
             "Critical churn risk. Immediate intervention needed.", 0.50),
    Playbook("Onboarding Support", 0.5, None, None,
             "Guided Feature Adoption Program", "training",
             10, 500.0, 0.0, 12, 0.72, "This week",
             "Customer not using features. Training can unlock value.", 0.45),
    Playbook("Engagement Campaign", 0.4, None, None,
             "Multi-Channel Re-engagement Campaign", "engagement",
             15, 750.0, 0.0, 12, 0.68, "Next 2 weeks",
             "Engagement declining. Multi-touch campaign to re-activate.", 0.40),
    Playbook("Executive Check-in", 0.3, None, 3000.0,
             "Executive Account Review", "executive_outreach",
             12, 2000.0, 0.0, 24, 0.75, "Next 3 weeks",
             "High-value customer. Executive relationship management.", 0.55),
    Playbook(None, None, None, None,
             "Monitor and Nurture", "monitor",
             0, 0.0, 0.0, 0, 0.95, "Ongoing",
             "Customer is healthy. Standard engagement practices.", 0.90),
)

# Message wording of one alert; {} slots are filled per customer.
ALERT_SUBJECT = "URGENT: Customer {} At Risk of Churn"
ALERT_RECIPIENT = "sales-team+{}@company.com"
ALERT_BODY = """
    CUSTOMER CHURN ALERT
    ============================================================
    
    Customer ID: {}
    Churn Probability: {}%
    Risk Level: HIGH RISK
    Annual Revenue at Risk: ${}
    
    RECOMMENDED ACTION:
    {}
    
    ACTION REQUIRED:
    1. Review customer account immediately
    2. Contact customer within 24 hours
    3. Implement recommended retention strategy
    4. Log outcome in system
    
    Timeline: This alert was triggered by our predictive model.
    Immediate action recommended.
    
    ============================================================
    Sent: {}
    """
FLAG_NOTE = "Flagged for retention team review"

# Weights of the transparent scorecard on the log-odds scale.
SCORECARD_INTERCEPT = 1.2
SCORECARD_WEIGHTS = {
    "health_score": -0.05,
    "support_tickets": 0.9,
    "days_inactive": 0.02,
    "logins_per_day": -0.25,
}

# --- end of fixed values ------------------------------------------------------


@dataclass(frozen=True)
class Settings:
    """Thresholds an analyst may want to change."""

    features_available: int = 10
    inactive_after: int = 30
    severely_inactive_after: int = 60
    high_adoption_above: float = 0.70
    low_adoption_below: float = 0.30
    many_tickets_from: int = 3
    declining_below: float = -0.10
    model_tier_cuts: tuple[float, float] = (0.3, 0.6)
    business_tier_cuts: tuple[float, float] = (0.20, 0.40)
    predicted_above: float = 0.5
    quarter_months: int = 3
    year_months: int = 12
    drift_threshold: float = 0.15
    high_share_alert: float = 0.05
    medium_share_alert: float = 0.15
    prior_cap: float = 0.50
    peak_months: tuple[int, ...] = (1, 4, 10, 12)
    peak_factor: float = 1.15
    off_peak_factor: float = 0.85
    # Rolling window length and trend look-back, in panel rows.
    window_rows: int = 3
    retention_rates: tuple[float, ...] = (0.10, 0.20, 0.30, 0.50)
    high_roi_above: float = 10.0
    scorecard_weights: dict[str, float] = field(default_factory=lambda: dict(SCORECARD_WEIGHTS))
    scorecard_intercept: float = SCORECARD_INTERCEPT


DEFAULT = Settings()
