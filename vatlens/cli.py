"""Command line: ``python -m vatlens <command>``.

    train      --data X.csv --target T --out DIR [--run COL]
    predict    --model DIR --input X.csv --output OUT [--keep-all] [--stats batch|model]
    benchmark  --model DIR --data X.csv [--target T]
               both: [--history RUNS --user NAME] append a run record
    clean      --data X.csv --out OUT [--csv]
    eda        --data X.csv --out DIR --numeric C --category C [--hue C] [--value C] [--key C | --order-by C...]

Paths are anything Spark reads (local, HDFS, object stores); CSV inputs use
pandas' missing-value tokens. The bioprocess preset supplies the derived
features; outputs are Parquet unless ``--csv``.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession


def _read(spark: SparkSession, path: str):
    from vatlens.sources import files
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return files.read_csv(spark, path)


def _read_back(spark: SparkSession, path: str, csv: bool):
    from vatlens.sources import files
    return files.read_csv(spark, path) if csv else files.read_table(spark, path)


def _run_id() -> int:
    """Microseconds since 1970: ascending over the runs of a history."""
    import time
    return time.time_ns() // 1000


def _record(a, run) -> None:
    """Append the run to the history table."""
    from vatlens.operators import history
    history.append_runs(run, a.history)


def cmd_train(spark, a):
    from vatlens.plans import commands
    from vatlens.plans.preprocess import bioprocess_spec
    model = commands.train(spark, _read(spark, a.data), bioprocess_spec(a.run), a.target, a.out)
    print(json.dumps({"model": f"{a.out}/model", "schema": f"{a.out}/schema", "alpha": model.alpha,
                      "trained_rows": model.n, "features": model.features}))


def cmd_predict(spark, a):
    from vatlens.operators import history
    from vatlens.plans import commands
    from vatlens.plans.preprocess import bioprocess_spec
    from vatlens.sources import feature_schema, files
    model = feature_schema.load_linear_model(spark, f"{a.model}/model")
    out = commands.predict(spark, _read(spark, a.input), model, bioprocess_spec(a.run),
                           output="input" if a.keep_all else "processed", stats=a.stats,
                           name="Pred_" + model.target)
    files.write_table(out, a.output, "csv" if a.csv else "parquet")
    if a.history:
        # from what was written: the scores are not computed again
        done = _read_back(spark, a.output, a.csv)
        _record(a, history.prediction_run(done, "Pred_" + model.target, a.user, a.input, a.model, _run_id()))
    print(json.dumps({"predictions": a.output}))


def cmd_benchmark(spark, a):
    from vatlens.operators import history
    from vatlens.plans import commands
    from vatlens.plans.preprocess import bioprocess_spec
    from vatlens.sources import feature_schema
    model = feature_schema.load_linear_model(spark, f"{a.model}/model")
    if a.target and a.target != model.target:
        raise SystemExit(f"model was trained for {model.target}, not {a.target}")
    metrics = commands.benchmark(_read(spark, a.data), model, bioprocess_spec(a.run), a.stats)
    m = metrics.first()
    if a.history:
        one = spark.createDataFrame([m], metrics.schema)
        _record(a, history.benchmark_run(one, a.user, a.data, a.model, _run_id()))
    print(json.dumps({"r2": m["r2"], "mae": m["mae"], "rmse": m["rmse"], "n": m["n"]}))


def cmd_clean(spark, a):
    from vatlens.plans.preprocess import bioprocess_spec, preprocess
    from vatlens.sources import files
    files.write_table(preprocess(_read(spark, a.data), bioprocess_spec(a.run), strict=True),
                      a.out, "csv" if a.csv else "parquet")
    print(json.dumps({"cleaned": a.out}))


def cmd_eda(spark, a):
    from vatlens.plans.eda import eda_report
    rep = eda_report(_read(spark, a.data), a.numeric, a.category, a.hue, a.value,
                     fill_median=a.fill_median or (), fill_mode=a.fill_mode or (), out=a.out,
                     key=a.key, order_by=a.order_by)
    print(json.dumps({"tables": sorted(rep), "out": a.out}))


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vatlens", description="train / predict / benchmark / clean / eda")
    sub = p.add_subparsers(dest="cmd", required=True)
    t = sub.add_parser("train")
    t.add_argument("--data", required=True)
    t.add_argument("--target", required=True)
    t.add_argument("--out", required=True)
    t.add_argument("--run", default=None, help="run id column (default: the file is one run)")
    t.set_defaults(func=cmd_train)
    for name, fn in (("predict", cmd_predict), ("benchmark", cmd_benchmark)):
        s = sub.add_parser(name)
        s.add_argument("--model", required=True, help="training output folder")
        s.add_argument("--run", default=None)
        s.add_argument("--history", default=None, help="append a run record to this history table")
        s.add_argument("--user", default="cli", help="user named in the run record")
        s.add_argument("--stats", choices=["batch", "model"], default="batch",
                       help="z-score statistics of this batch (reference) or of the training set")
        if name == "predict":
            s.add_argument("--input", required=True)
            s.add_argument("--output", required=True)
            s.add_argument("--keep-all", action="store_true", help="every input row, NULL score if dropped")
            s.add_argument("--csv", action="store_true")
        else:
            s.add_argument("--data", required=True)
            s.add_argument("--target", default=None)
        s.set_defaults(func=fn)
    c = sub.add_parser("clean")
    c.add_argument("--data", required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--run", default=None)
    c.add_argument("--csv", action="store_true")
    c.set_defaults(func=cmd_clean)
    e = sub.add_parser("eda")
    e.add_argument("--data", required=True)
    e.add_argument("--out", required=True)
    e.add_argument("--numeric", required=True)
    e.add_argument("--category", required=True)
    e.add_argument("--hue", default=None)
    e.add_argument("--value", default=None)
    e.add_argument("--key", default=None, help="column that identifies a row (bootstrap intervals)")
    e.add_argument("--order-by", nargs="*", default=None, help="row order, if there is no key")
    e.add_argument("--fill-median", nargs="*")
    e.add_argument("--fill-mode", nargs="*")
    e.set_defaults(func=cmd_eda)
    return p


def main(argv=None) -> int:
    args = build_parser().parse_args(argv)
    from pyspark import SparkConf

    from vatlens.session import get_session
    # under spark-submit the master comes from the submit conf; a plain
    # ``python -m vatlens`` runs locally
    spark = get_session(None if SparkConf().contains("spark.master") else "local[*]")
    args.func(spark, args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
