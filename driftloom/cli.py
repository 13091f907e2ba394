"""Command line: manifest, analyse, compare and plan."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from driftloom import __version__
from driftloom.operators import groups
from driftloom.plans import report
from driftloom.plans.analysis import AnalysisConfig, analyse
from driftloom.sources import annotations, datasets, files, manifest


def _fail(message: str) -> int:
    print(f"error: {message}", file=sys.stderr)
    return 2


def _manifest(spark: SparkSession, a: argparse.Namespace) -> int:
    made, unmatched = manifest.build_manifest(spark, a.root, a.pattern, a.timestamp_format, a.audio_suffix, a.annot_suffix, a.out)
    n, birds = made.agg(F.count(F.lit(1)), F.count_distinct("bird")).first()
    print(f"wrote {a.out}: {n} recordings of {birds} individuals")
    left_out = unmatched.count()
    if left_out:
        print(f"warning: {left_out} file names did not match and were left out, such as")
        for (name,) in unmatched.orderBy("name").limit(20).collect():
            print(f"    {name}")
    return 0


def _analyse(spark: SparkSession, a: argparse.Namespace) -> int:
    if not files.exists(a.manifest, spark):
        return _fail(f"no manifest at {a.manifest}")
    config = AnalysisConfig(
        n_pca=a.n_pca, n_freq_bins=a.n_freq_bins, max_per_day=a.max_per_day, exclude_labels=tuple(a.exclude_labels),
        min_renditions=a.min_renditions, min_bouts=a.min_bouts, n_boot=a.n_boot, n_null=a.n_null, seed=a.seed,
    )
    try:
        listed = manifest.load_manifest(spark, a.manifest)
        root = os.path.commonpath([r[0] for r in listed.agg(F.min("annot_path")).union(listed.agg(F.max("annot_path"))).collect()])
        root = root if files.is_folder(root, spark) else os.path.dirname(root)
        table, counts = annotations.load_from_manifest(spark, listed, root, a.annot_format, on_missing="skip")
        missing = counts.first()["n_missing"]
        if missing:
            print(f"warning: {missing} recordings have no annotation file and are left out")
        if table.isEmpty():
            return _fail("no annotated syllables")
        audio = os.path.commonpath([os.path.dirname(r[0]) for r in table.agg(F.min("audio_path")).union(table.agg(F.max("audio_path"))).collect()])
        found = analyse(table, datasets.wav_files(spark, audio), config)
        result = report.collected(found, config)
    except ValueError as problem:
        return _fail(str(problem))
    print(report.summary(result))
    print("\nDrift is evidence of change only over the individual's own noise floor.")
    report.write_json(result, a.out, spark)
    print(f"wrote {a.out}")
    if a.drift_out:
        report.write_drift(found, a.drift_out, spark)
        print(f"wrote {a.drift_out}: one value per individual")
    return 0


def _compare(spark: SparkSession, a: argparse.Namespace) -> int:
    if not files.exists(a.drift, spark):
        return _fail(f"no drift table at {a.drift}")
    rows = spark.read.csv(a.drift, header=True)
    lacking = [c for c in ("group", a.value_column) if c not in rows.columns]
    if lacking:
        return _fail(f"the drift table has no column {lacking[0]!r}, only {rows.columns}")
    there = sorted(str(r[0]) for r in rows.select("group").distinct().limit(50).collect())
    if set(there) != {a.treated, a.control}:
        return _fail(f"expected the groups {a.treated!r} and {a.control!r}, found {there}")
    values = rows.withColumn("_key", F.monotonically_increasing_id()).withColumn("_x", F.col(a.value_column).cast("double"))
    try:
        found = groups.compare_groups(values, "_key", "group", "_x", a.treated, a.control, a.alternative, within_sd=a.within_bird_sd, seed=a.seed)
    except ValueError as problem:
        return _fail(str(problem))
    result = found.first().asDict()
    print(report.comparison_text(result))
    print("\nOne value per individual: renditions of one individual are not replicates.")
    report.write_json(result, a.out, spark)
    print(f"wrote {a.out}")
    return 0


def _plan(spark: SparkSession, a: argparse.Namespace) -> int:
    curve = groups.power_by_size(
        spark, a.effect, a.between_bird_sd, a.alpha, max_n=a.max_n, n_simulations=a.n_simulations, n_permutations=a.n_permutations, seed=a.seed
    )
    n = groups.birds_needed(curve, a.power).first()["n_needed"]
    print(f"effect {a.effect}, spread {a.between_bird_sd}, power {a.power:.0%}, alpha {a.alpha}")
    print(f"-> more than {a.max_n} individuals per group" if n is None else f"-> {n:.0f} individuals per group")
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="driftloom", description="Did this individual change between two days?")
    top.add_argument("--version", action="version", version=f"driftloom {__version__}")
    commands = top.add_subparsers()

    def command(name: str, run, **options) -> None:  # noqa: ANN001
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        for flag, settings in options.items():
            p.add_argument("--" + flag.replace("_", "-"), **settings)

    need, number, whole = {"required": True}, (lambda x: {"type": float, "default": x}), (lambda x: {"type": int, "default": x})
    command(
        "manifest", _manifest, root=need, out=need, pattern=need, timestamp_format=need, audio_suffix={"default": ".wav"}, annot_suffix={"default": ".wav.csv"}
    )
    command(
        "analyse", _analyse, manifest=need, out=need, drift_out={}, annot_format={"default": "simple-seq"}, n_pca=whole(64), n_freq_bins=whole(32),
        max_per_day=whole(2000), exclude_labels={"nargs": "*", "default": []}, min_renditions=whole(20), min_bouts=whole(4), n_boot=whole(400),
        n_null=whole(300), seed=whole(0),
    )
    command(
        "compare", _compare, drift=need, out=need, value_column={"default": "drift"}, treated={"default": "treated"}, control={"default": "control"},
        alternative={"choices": groups.ALTERNATIVES, "default": "two-sided"}, within_bird_sd={"type": float}, seed=whole(0),
    )
    command(
        "plan", _plan, effect={"type": float, **need}, between_bird_sd={"type": float, **need}, alpha=number(0.05), power=number(0.8), max_n=whole(40),
        n_simulations=whole(400), n_permutations=whole(2000), seed=whole(0),
    )
    return top


def main(arguments: list[str] | None = None) -> int:
    top = parser()
    a = top.parse_args(arguments)
    if not hasattr(a, "run"):
        top.print_help()
        return 1
    return a.run(SparkSession.builder.appName("driftloom").getOrCreate(), a)


if __name__ == "__main__":
    sys.exit(main())
