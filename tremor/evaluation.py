"""Evaluation of a data set on disk: report and JSON results, with a command line.

    python -m tremor.evaluation --root PROJECT --method z_score --output-dir OUT
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tremor.config import METHODS, create_detector
from tremor.operators import evaluate, normalize, report
from tremor.sources import sinks
from tremor.sources.loader import DatasetLoader, create_default_loader


def run_evaluation(
    spark: SparkSession, loader: DatasetLoader, method: str = "z_score", z_threshold: float = 3.0, threshold_quantile: float = 0.95, min_baseline_samples: int = 10, output_dir: str = "evaluation/results"
) -> dict:
    """Evaluate all cases of ``loader`` in one plan and write report and results; returns the results.

    Metrics outside of their case's window are left out.  A case whose times
    are missing or out of order is reported as skipped; the others go on.
    """
    config = create_detector(method, z_threshold=z_threshold, threshold_quantile=threshold_quantile, min_baseline_samples=min_baseline_samples)
    truth = loader.load_ground_truth()
    windows = evaluate.case_windows(truth).select("case_id", "time_start_ms", "time_end_ms")
    events = normalize.normalize_metrics(loader.scan_metrics())
    events = events.join(windows, "case_id").where("timestamp_ms between time_start_ms and time_end_ms").drop("time_start_ms", "time_end_ms")
    found = report.results(evaluate.run_evaluation(events, truth, config), config)
    text = report.format_report(found)
    print(text)
    sinks.write_text(spark, text, f"{output_dir}/detection_report.txt")
    sinks.write_json(spark, found, f"{output_dir}/detection_results.json")
    return found


def main(arguments: list[str] | None = None) -> None:
    import argparse

    from tremor import session

    parser = argparse.ArgumentParser(description="Evaluate anomaly detection on the labelled cases")
    parser.add_argument("--root", default=".", help="folder of the data set")
    parser.add_argument("--method", default="z_score", choices=METHODS)
    parser.add_argument("--z-threshold", type=float, default=3.0)
    parser.add_argument("--quantile", type=float, default=0.95)
    parser.add_argument("--min-baseline", type=int, default=10)
    parser.add_argument("--output-dir", default="evaluation/results")
    args = parser.parse_args(arguments)
    spark = session.build("evaluation")
    run_evaluation(spark, create_default_loader(spark, args.root), args.method, args.z_threshold, args.quantile, args.min_baseline, args.output_dir)


if __name__ == "__main__":
    main()
