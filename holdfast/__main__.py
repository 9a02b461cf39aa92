"""Command line of the jobs, for spark-submit or ``python -m holdfast``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.operators import eda, features, ml, monitoring, scoring
from holdfast.operators.tree_contributions import explain_trees
from holdfast.plans.pipeline import RetentionJob
from holdfast.plans.training import fit_and_store
from holdfast.session import job_session
from holdfast.sources import tables


def arguments() -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="holdfast", description=__doc__)
    parser.add_argument("--root", required=True, help="folder of the stored tables")
    jobs = parser.add_subparsers(dest="job", required=True)
    ingest = jobs.add_parser("ingest", help="store customers and add new engagement rows")
    ingest.add_argument("--customers", required=True)
    ingest.add_argument("--engagement", required=True)
    ingest.add_argument("--format", default="csv")
    train = jobs.add_parser("train", help="fit the boosted-tree model on all periods")
    train.add_argument("--model", required=True, help="folder for model and training rows")
    daily = jobs.add_parser("daily", help="score, prescribe, explain, alert, monitor")
    daily.add_argument("--as-of", required=True, help="date of the run, YYYY-MM-DD")
    daily.add_argument("--model", help="model folder; the scorecard is used without it")
    daily.add_argument("--tiers", default="business", choices=("business", "model"))
    jobs.add_parser("status", help="the last runs")
    jobs.add_parser("retier", help="business tiers on all stored runs")
    export = jobs.add_parser("export", help="one stored table as CSV")
    export.add_argument("--table", required=True)
    export.add_argument("--out", required=True)
    summary = jobs.add_parser("summary", help="segment summary as CSV")
    summary.add_argument("--out", required=True)
    return parser.parse_args()


def model_choice(folder: str) -> dict:
    """Score and explain with a stored model instead of the scorecard."""
    path = f"{folder}/model"
    model = ml.load_model(path)

    def explainer(rows: DataFrame) -> DataFrame:
        return explain_trees(rows, model, path, ("customer_id", "churn_probability"))

    return {"strategy": scoring.trained(model), "explainer": explainer}


def main() -> None:
    args = arguments()
    spark = job_session(f"holdfast-{args.job}")
    job = RetentionJob(spark, args.root)
    if args.job == "ingest":
        print("customers:", job.ingest_customers(args.customers, args.format))
        print("engagement:", job.ingest(args.engagement, args.format))
    elif args.job == "train":
        matrix = features.feature_matrix(job.engagement(), job.read("customers"))
        model, report = fit_and_store(matrix, args.model)
        tables.export_csv(ml.feature_importance(model, spark), f"{args.model}/feature_importance")
        report.show(truncate=False)
    elif args.job == "daily":
        choice = model_choice(args.model) if args.model else {}
        scored = RetentionJob(spark, args.root, tiers=args.tiers, **choice)
        scored.run(F.lit(args.as_of).cast("timestamp"))
    elif args.job == "status":
        monitoring.status_of(monitoring.history_of(job.ledger())).show(truncate=False)
    elif args.job == "retier":
        job.retier().show(truncate=False)
    elif args.job == "export":
        tables.export_csv(job.read(args.table), args.out)
    else:
        enriched = features.enrich(job.engagement(), job.read("customers"))
        tables.export_csv(eda.segment_summary(enriched, job.read("customers")), args.out)


if __name__ == "__main__":
    main()
