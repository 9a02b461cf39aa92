from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("holdfast-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def workspace(spark):
    """The data folder's tables, kept in memory so that many tests can share them."""
    from functools import cached_property

    from holdfast.plans.workspace import Workspace

    def kept(name):
        @cached_property
        def table(self):
            return getattr(Workspace, name).func(self).persist()

        table.__set_name__(Kept, name)
        return table

    class Kept(Workspace):
        pass

    for name in ("panel", "customers", "features", "predictions", "interventions"):
        setattr(Kept, name, kept(name))
    return Kept(spark, DATA)


def rows(df, *order):
    """Rows as dicts, in the given order."""
    ordered = df.orderBy(*order) if order else df
    return [r.asDict(recursive=True) for r in ordered.collect()]


def panel_row(customer="A", period="2024-01", **values):
    row = {
        "customer_id": customer, "period": period, "active_users": 5, "api_calls": 100,
        "logins_per_day": 2.0, "days_since_last_login": 5, "features_used_count": 5,
        "support_tickets": 0, "engagement_score": 60.0, "churned": 0,
    }
    return {**row, **values}


@pytest.fixture
def make_panel(spark):
    from holdfast import schemas

    def make(*given):
        names = schemas.ENGAGEMENT.fieldNames()
        return spark.createDataFrame([tuple(r[n] for n in names) for r in given], schemas.ENGAGEMENT)

    return make


@pytest.fixture
def make_predictions(spark):
    def make(*given):
        """(customer, date, probability, tier[, revenue, health, recommendation])"""
        filled = [tuple(g) + (1000.0, 50.0, "Monitor")[len(g) - 4:] for g in given]
        schema = ("customer_id string, prediction_date string, churn_probability double, "
                  "risk_tier string, monthly_revenue double, health_score double, "
                  "recommendation string")
        from pyspark.sql import functions as F
        df = spark.createDataFrame(filled, schema)
        at_risk = F.col("monthly_revenue") * F.col("churn_probability")
        return df.withColumn("revenue_at_risk", at_risk * 3).withColumn(
            "annual_revenue_at_risk", at_risk * 12
        )

    return make
