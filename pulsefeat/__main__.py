"""``python -m pulsefeat INPUT OUTPUT``: load, check, split, fit, transform, audit, report.

Exit codes: 0 done, 1 the table or the arguments are at fault, 2 anything else.
"""

from __future__ import annotations

import argparse
import sys
import time
import traceback

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pulsefeat.functions.names import LABELS, TARGET, find_column, machine_column
from pulsefeat.operators import quality, split, validation
from pulsefeat.operators.engineer import FeatureEngineer, Settings, group_counts
from pulsefeat.operators.families import metadata
from pulsefeat.plans import report
from pulsefeat.session import local_session
from pulsefeat.sources.tables import load_table, normalized, save_json, save_table, save_tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pulsefeat", description=__doc__.splitlines()[0])
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--target", default=TARGET)
    p.add_argument("--id", default="uid", help="column that identifies a row")
    p.add_argument("--mode", default="auto", choices=["auto", "ai4i", "timeseries"])
    p.add_argument("--train", type=float, default=0.70)
    p.add_argument("--validation", type=float, default=0.15)
    p.add_argument("--test", type=float, default=0.15)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--format", default="parquet", choices=["parquet", "csv", "orc", "json"])
    p.add_argument("--skip-quality", action="store_true")
    p.add_argument("--skip-report", action="store_true")
    p.add_argument("--note", action="append", default=[])
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> dict:
    began = time.time()
    split.check_sizes((args.train, args.validation, args.test))
    df = normalized(load_table(spark, args.input))
    target = find_column(df.columns, args.target)
    if target is None:
        raise ValueError(f"no column {args.target}")
    if problems := validation.schema_problems(df, target):
        raise ValueError("; ".join(problems))
    if args.id not in df.columns:
        df = df.withColumn(args.id, F.monotonically_increasing_id())
    mode = validation.data_mode(df, args.mode)
    settings = Settings()
    if mode == "timeseries":
        settings = Settings(timestamp=validation.timestamp_column(df), machine=machine_column(df.columns), tiebreak=(args.id,))
    parts = split.stratified(df, args.id, target, (args.train, args.validation, args.test), args.seed)
    frames = {name: parts.where(F.col("split") == name).drop("split") for name in split.PARTS}
    model = FeatureEngineer(settings).fit(frames["train"])
    leaks = model.leaks()
    if not leaks["passed"]:
        raise ValueError(f"labels leak into features: {leaks}")
    folder = args.output.rstrip("/")
    features = {name: model.transform(frame) for name, frame in frames.items()}
    for name, frame in features.items():
        save_table(frame, f"{folder}/features_{name}", args.format)
        save_table(split.predictive_frame(frame), f"{folder}/predictive_{name}", args.format)
    save_json(spark, model.state(), f"{folder}/state_json")
    lineage = metadata(spark, model.features)
    save_table(lineage, f"{folder}/features_metadata", args.format)
    safety = split.safety_report(split.predictive_frame(features["train"]))
    tables = {}
    if not args.skip_quality:
        trained = load_table(spark, f"{folder}/features_train") if args.format == "parquet" else features["train"]
        tables = quality.audit(trained, target, [args.id], [c for c in LABELS if c != target])
        save_tables(tables, folder, "quality", "parquet")
        tables = {name: spark.read.parquet(f"{folder}/quality_{name}") for name in tables}
    if not args.skip_report:
        made = report.build(validation.profile(df, target), validation.target_histogram(df, target), split.split_summary(parts, target), group_counts(lineage), lineage, tables, safety, args.note)
        report.save(spark, made, folder)
    summary = {"mode": mode, "features": len(model.learned.retained), "constant": model.learned.constant, "duplicate": model.learned.duplicate, "safety": safety, "leaks": leaks, "seconds": round(time.time() - began, 1)}
    save_json(spark, summary, f"{folder}/summary_json")
    return summary


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as stop:
        return 0 if not stop.code else 1
    spark = SparkSession.getActiveSession() or local_session()
    try:
        print(run(spark, args))
        return 0
    except ValueError as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    except Exception:
        traceback.print_exc()
        return 2


if __name__ == "__main__":
    sys.exit(main())
