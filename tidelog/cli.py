"""Command line: each stage reads and writes Parquet or JSON, so that stages can be run apart.

    python -m tidelog parse --input LOG --output parsed.parquet --year 2024
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.masking import MaskConfig
from .operators import baseline, batch, comparative, evaluate, parse, reconstruction, samples, synth, temporal
from .operators import sequence as seq
from .operators import windows as win
from .sources import logs

COMMANDS: dict[str, tuple[Callable, list[tuple[str, dict]]]] = {}


def option(name: str, **kw: object) -> tuple[str, dict]:
    return f"--{name}", kw


def command(name: str, *options: tuple[str, dict]) -> Callable:
    def register(f: Callable) -> Callable:
        COMMANDS[name] = (f, list(options))
        return f

    return register


IN, OUT = option("input", required=True), option("output", required=True)
PARSED = option("parsed", required=True)
_mask = [option(f"no-{m}", action="store_true") for m in ("path", "hex", "ipv4", "ipv6", "mac", "uuid", "pid", "device", "number")]


def save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def preview(df: DataFrame, path: str, n: int, *order: str) -> None:
    """The first rows as JSON lines beside the table."""
    logs.preview(df, n, *order).coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}.preview")


@command("parse", IN, OUT, option("year", type=int, required=True), option("mining", default="exact", choices=("exact", "distinct", "none")), option("state"), *_mask)
def parse_command(spark: SparkSession, a: argparse.Namespace) -> None:
    mask = MaskConfig(**{m: not getattr(a, f"no_{m}") for m in ("path", "hex", "ipv4", "ipv6", "mac", "uuid", "pid", "device", "number")})
    lines = logs.concatenated(logs.read_lines(spark, *a.input.split(",")))
    state = spark.read.parquet(a.state) if a.state else None
    parsed = parse.parse_log(lines, parse.ParseConfig(a.year, mask, a.mining), state)
    save(parsed, a.output)
    preview(spark.read.parquet(a.output), a.output, 10, "line_no")


_params = [option("window-size", type=int, default=50), option("stride", type=int, default=25), option("alpha", type=float, default=0.3), option("quantile", type=float, default=0.95)]


@command("detect", PARSED, OUT, *_params)
def detect_command(spark: SparkSession, a: argparse.Namespace) -> None:
    save(baseline.detect(spark.read.parquet(a.parsed), baseline.BaselineParams(a.window_size, a.stride, a.alpha, a.quantile)), a.output)
    preview(spark.read.parquet(a.output), a.output, 20, "window_start_line")


@command("build-deeplog", PARSED, OUT, option("vocab", required=True), option("template-col", default="template"), option("reuse-vocab", action="store_true"))
def build_sequences(spark: SparkSession, a: argparse.Namespace) -> None:
    log = spark.read.parquet(a.parsed)
    if not a.reuse_vocab:
        logs.dictionary_json(win.vocabulary(log, a.template_col), "template", "index").coalesce(1).write.mode("overwrite").text(a.vocab)
    save(win.encode(log, logs.dictionary_table(spark.read.text(a.vocab)), a.template_col), a.output)


@command("deeplog-train", option("sequences", required=True), OUT, option("seq-len", type=int, default=50))
def train_sequences(spark: SparkSession, a: argparse.Namespace) -> None:
    save(seq.train(win.contexts(spark.read.parquet(a.sequences), a.seq_len, keep=2)), a.output)


@command("deeplog-infer", option("sequences", required=True), option("model", required=True), OUT, option("k", type=int, default=3), option("seq-len", type=int, default=50))
def infer_sequences(spark: SparkSession, a: argparse.Namespace) -> None:
    save(seq.infer_top_k(win.contexts(spark.read.parquet(a.sequences), a.seq_len, keep=2), spark.read.parquet(a.model), a.k), a.output)


@command("deeplog-infer-enhanced", PARSED, option("vocab", required=True), option("model", required=True), OUT, option("top-k", type=int, default=3), option("top-p", type=float), option("k-of-n", default="7,10"), option("cooldown-seq", type=float, default=60.0), option("cooldown-novelty", type=float, default=60.0), option("session-timeout", type=float, default=300.0), option("entity", default="host"))
def infer_enhanced(spark: SparkSession, a: argparse.Namespace) -> None:
    k, n = map(int, a.k_of_n.split(","))
    config = seq.AlertConfig(a.top_k, a.top_p, k, n, a.cooldown_seq, a.cooldown_novelty, a.session_timeout, a.entity)
    detail, alerts, summary = seq.infer_enhanced(spark.read.parquet(a.parsed), logs.dictionary_table(spark.read.text(a.vocab)), spark.read.parquet(a.model), config)
    for name, df in (("detail", detail), ("alerts", alerts), ("summary", summary)):
        save(df, f"{a.output}/{name}")


@command("build-mscred", PARSED, OUT, option("window-size", type=int, default=50), option("stride", type=int, default=25), option("mapping"))
def build_windows(spark: SparkSession, a: argparse.Namespace) -> None:
    log = spark.read.parquet(a.parsed)
    mapping = spark.read.parquet(a.mapping) if a.mapping else win.vocabulary(log, "template_id")
    coded = log.join(mapping.select(F.col("template").alias("__t"), F.col("index").alias("code")), F.col("template_id") == F.col("__t"), "left").drop("__t").withColumn("code", F.coalesce("code", F.lit(-1)))
    rows = win.in_windows(win.with_position(coded), a.window_size, a.stride)
    save(win.window_counts(rows).join(win.window_starts(rows), "window_idx"), a.output)
    if not a.mapping:
        save(mapping, f"{a.output.rstrip('/')}.mapping")


def _vectors(counts: DataFrame, width: int) -> DataFrame:
    """(window_idx, v): dense counts of codes 0 .. width - 1, standardised over this table."""
    cells = counts.where(f"code between 0 and {width - 1}").groupBy("window_idx").agg(F.map_from_entries(F.collect_list(F.struct(F.col("code").cast("int"), F.col("cnt").cast("double")))).alias("m"))
    every = counts.select("window_idx").distinct().join(cells, "window_idx", "left")
    value = lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))
    dense = every.select("window_idx", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), value).alias("v"))
    stats = dense.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).agg(F.sort_array(F.collect_list(F.struct("i", "m", "s"))).alias("t"))
    return dense.crossJoin(F.broadcast(stats)).select("window_idx", F.zip_with("v", "t", lambda x, t: (x - t["m"]) / (t["s"] + 1e-8)).alias("v"))


def _sequences(counts: DataFrame, width: int) -> DataFrame:
    return win.window_sequences(_vectors(counts, width), 20).select("window_idx", F.flatten("steps").alias("v"))


@command("mscred-train", option("counts", required=True), OUT, option("components", type=int, default=8))
def train_windows(spark: SparkSession, a: argparse.Namespace) -> None:
    counts = spark.read.parquet(a.counts)
    width = counts.agg(F.max("code") + 1).first()[0]
    train, held = reconstruction.split(_sequences(counts, width))
    model = reconstruction.fit_pca(train, a.components)
    model.write().overwrite().save(f"{a.output}/model")
    stats = reconstruction.threshold_stats(reconstruction.pca_errors(held, model))
    save(stats.withColumn("width", F.lit(width)), f"{a.output}/thresholds")


@command("mscred-infer", option("counts", required=True), option("model", required=True), OUT, option("threshold", type=float), option("method", default="99percentile", choices=tuple(reconstruction.METHODS)))
def infer_windows(spark: SparkSession, a: argparse.Namespace) -> None:
    counts, stats = spark.read.parquet(a.counts), spark.read.parquet(f"{a.model}/thresholds")
    errors = reconstruction.pca_errors(_sequences(counts, stats.first()["width"]), reconstruction.PCAModel.load(f"{a.model}/model"))
    save(reconstruction.detect(errors, counts.select("window_idx", "start_index").distinct(), stats, a.method, a.threshold), a.output)


@command("report", option("scores", required=True), option("sequences"), option("windows"), OUT)
def report_command(spark: SparkSession, a: argparse.Namespace) -> None:
    scores = spark.read.parquet(a.scores)
    summary = samples.report_summary(scores, spark.read.parquet(a.sequences) if a.sequences else None, spark.read.parquet(a.windows) if a.windows else None)
    with open(a.output, "w") as file:
        file.write(samples.markdown_report(summary, samples.top_anomalies(scores, 5)))


def _generator(name: str, make: Callable[[SparkSession, argparse.Namespace], DataFrame], lines: int) -> None:
    @command(name, OUT, option("labels"), option("lines", type=int, default=lines), option("rate", type=float, default=0.02), option("seed", type=int, default=42))
    def run(spark: SparkSession, a: argparse.Namespace) -> None:
        made = make(spark, a)
        made.orderBy("line_no").select("value").write.mode("overwrite").text(a.output)
        if a.labels:
            save(made.drop("value"), a.labels)


_generator("gen-synth", lambda s, a: synth.generate(s, a.lines, a.rate, a.seed), 2000)
_generator("gen-training-data", lambda s, a: synth.training(s, a.lines, a.seed), 10_000)
_generator("gen-inference-normal", lambda s, a: synth.inference_normal(s, a.lines, a.seed), 1000)
_generator("gen-inference-anomaly", lambda s, a: synth.inference_anomaly(s, a.lines, a.rate, a.seed), 1500)


@command("eval", option("scores", required=True), option("sequences"), option("labels", required=True), OUT)
def eval_command(spark: SparkSession, a: argparse.Namespace) -> None:
    labels = spark.read.parquet(a.labels)
    out = evaluate.evaluate_baseline(spark.read.parquet(a.scores), labels).withColumn("method", F.lit("baseline"))
    if a.sequences:
        out = out.unionByName(evaluate.evaluate_sequences(spark.read.parquet(a.sequences), labels).withColumn("method", F.lit("sequence")))
    save(out, a.output)


@command("analyze-samples", PARSED, option("scores", required=True), OUT, option("max-samples", type=int, default=20), option("context-lines", type=int, default=3))
def samples_command(spark: SparkSession, a: argparse.Namespace) -> None:
    log, chosen = spark.read.parquet(a.parsed), samples.top_anomalies(spark.read.parquet(a.scores), a.max_samples)
    lines = samples.window_lines(log, chosen, context=a.context_lines)
    inside = lines.where("is_anchor")
    save(lines, f"{a.output}/lines")
    save(samples.window_patterns(inside, chosen.select(F.col("window_start_line").alias("anchor"), "unseen_rate", "freq_z")), f"{a.output}/patterns")
    save(samples.representatives(inside), f"{a.output}/representatives")


@command("convert-onnx", option("vocab", required=True), OUT)
def convert_command(spark: SparkSession, a: argparse.Namespace) -> None:
    """The vocabulary by index, checked for gaps.  Models are Parquet tables here and need no other format."""
    words = logs.dictionary_table(spark.read.text(a.vocab))
    row = words.agg(F.count("*").alias("n"), F.min("index").alias("low"), F.max("index").alias("high")).first()
    if row.n and (row.low != 0 or row.high != row.n - 1):
        raise ValueError("the vocabulary's indices have gaps")
    save(words.orderBy("index"), a.output)


@command("hybrid-pipeline", IN, OUT, option("year", type=int, required=True))
def pipeline_command(spark: SparkSession, a: argparse.Namespace) -> None:
    """Parse, score and train in one go, into one folder."""
    at = lambda name: f"{a.output}/{name}"
    main(["parse", "--input", a.input, "--output", at("parsed"), "--year", str(a.year)], spark)
    main(["detect", "--parsed", at("parsed"), "--output", at("scores")], spark)
    main(["build-deeplog", "--parsed", at("parsed"), "--output", at("sequences"), "--vocab", at("vocab")], spark)
    main(["deeplog-train", "--sequences", at("sequences"), "--output", at("sequence_model")], spark)
    main(["build-mscred", "--parsed", at("parsed"), "--output", at("counts")], spark)
    main(["mscred-train", "--counts", at("counts"), "--output", at("window_model")], spark)
    main(["convert-onnx", "--vocab", at("vocab"), "--output", at("vocab_by_index")], spark)


@command("analyze-temporal", PARSED, OUT, option("profile"))
def temporal_command(spark: SparkSession, a: argparse.Namespace) -> None:
    save(temporal.analyze(spark.read.parquet(a.parsed), spark.read.parquet(a.profile) if a.profile else None), a.output)


def _sources(spark: SparkSession, parsed: str) -> DataFrame:
    return logs.merged({p: spark.read.parquet(p) for p in parsed.split(",")})


@command("analyze-comparative", PARSED, OUT, option("target"))
def comparative_command(spark: SparkSession, a: argparse.Namespace) -> None:
    """``--parsed``: paths of parsed logs, separated by commas."""
    save(batch.analyze(_sources(spark, a.parsed), a.target), a.output)


@command("analyze-mscred", option("windows", required=True), option("counts", required=True), option("scores"), OUT)
def mscred_command(spark: SparkSession, a: argparse.Namespace) -> None:
    found = spark.read.parquet(a.windows)
    save(samples.error_stats(found), f"{a.output}/stats")
    save(samples.anomaly_patterns(found, spark.read.parquet(a.counts)), f"{a.output}/patterns")
    save(samples.histogram(found, "reconstruction_error"), f"{a.output}/histogram")
    if a.scores:
        save(samples.method_overlap(found, spark.read.parquet(a.scores)), f"{a.output}/overlap")


@command("validate-baseline", PARSED, OUT, option("score-threshold", type=float, default=0.7))
def validate_command(spark: SparkSession, a: argparse.Namespace) -> None:
    checked = comparative.quality(_sources(spark, a.parsed), comparative.QualityThresholds(min_score=a.score_threshold))
    save(checked, f"{a.output}/files")
    save(comparative.mutual_consistency(checked.where("valid")), f"{a.output}/consistency")
    save(comparative.quality_summary(checked), f"{a.output}/summary")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidelog")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (f, options) in COMMANDS.items():
        sub = commands.add_parser(name, help=(f.__doc__ or name).strip().splitlines()[0])
        for flag, kw in options:
            sub.add_argument(flag, **kw)
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("tidelog").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    COMMANDS[args.command][0](spark, args)


def describe() -> str:
    return json.dumps({name: [flag for flag, _ in options] for name, (_, options) in COMMANDS.items()})
