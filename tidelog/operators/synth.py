"""Synthetic logs with labels, the same for the same seed: each line is a function of its number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NORMAL = (
    "session opened for user u{a} by uid={b}", "connection from 10.0.{a}.{b} port {c} accepted", "job {c} finished in {a} ms", "disk sd{a} usage at {b} percent",
    "lease renewed for 10.1.{a}.{b}", "cache hit ratio {b} for shard {a}", "service worker{a} heartbeat ok",
)
UNSEEN = ("quantum flux drift of {a} units in cell {b}", "orphaned lock {c} reclaimed by reaper {a}")
ERRORS = ("I/O error on device sd{a} sector {c}", "request {c} failed with status {b}", "unhandled exception in worker{a} at 0x{c}", "fatal: out of memory, process {c} killed", "write failure on /var/data/{a}/{c}")
ATTACKS = ("invalid user admin{a} from 203.0.113.{b}", "possible break-in attempt from 198.51.100.{b} port {c}", "sudo denied for u{a} command /bin/sh", "port scan detected from 203.0.113.{b}")
CRASHES = ("kernel panic in module m{a} at 0x{c}", "segfault at 0x{c} in libx{a}.so", "watchdog reset of core {a} after {b} s", "service worker{a} crashed with signal {b}")
MILLION = 1_000_000
KINDS = {"unseen": UNSEEN, "error": ERRORS, "attack": ATTACKS, "crash": CRASHES}


def _digits(key: Column, first: int = 1) -> Column:
    """A number from eight hex digits of the key's MD5: any engine can restate it."""
    return F.conv(F.substring(F.md5(key), first, 8), 16, 10).cast("long")


def _pick(seed: int, salt: str, n: int) -> Column:
    return _digits(F.concat(F.col("line_no").cast("string"), F.lit(f":{seed}:{salt}"))) % n


def _message(seed: int, pool: tuple[str, ...], salt: str) -> Column:
    choice = F.element_at(F.array(*[F.lit(t) for t in pool]), (_pick(seed, salt, len(pool)) + 1).cast("int"))
    for name, n in (("a", 16), ("b", 100), ("c", 65536)):
        choice = F.replace(choice, F.lit("{" + name + "}"), _pick(seed, salt + name, n).cast("string"))
    return choice


def generate(spark: SparkSession, lines: int, rate: float = 0.02, seed: int = 42, start: str = "2024-01-01 00:00:00", kinds: tuple[str, ...] = ("unseen", "error"), bursts: bool = False) -> DataFrame:
    """(line_no, value, is_anomaly, anomaly_type): syslog lines a second apart.

    A line is anomalous at random with probability ``rate``.  With ``bursts``, one anomaly in ten makes the next 10 to 30
    lines anomalous too: a line asks the 30 before it, so no state is carried.
    """
    base = spark.range(lines).select(F.col("id").alias("line_no"))

    def draw(n: Column, first: int) -> Column:
        return _digits(F.concat(n.cast("string"), F.lit(f":{seed}:hit")), first)

    def anomalous(n: Column) -> Column:
        return (n >= 0) & (draw(n, 1) % MILLION < int(rate * MILLION))

    own = anomalous(F.col("line_no"))
    burst = F.lit(False)
    if bursts:
        begins = lambda d: (lambda n: anomalous(n) & (draw(n, 9) % 10 == 0) & (draw(n, 17) % 21 + 10 >= d))(F.col("line_no") - d)
        burst = F.exists(F.array(*[begins(d) for d in range(1, 31)]), lambda x: x)
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (_pick(seed, "kind", len(kinds)) + 1).cast("int"))
    typed = base.withColumn("anomaly_type", F.when(own, kind).when(burst, "burst"))
    text = F.when(F.col("anomaly_type").isNull(), _message(seed, NORMAL, "normal"))
    for name in kinds:
        text = text.when(F.col("anomaly_type") == name, _message(seed, KINDS[name], name))
    text = text.otherwise(_message(seed, ERRORS, "burst"))
    time = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(start)) + F.col("line_no")), "MMM d HH:mm:ss")
    head = F.concat(time, F.lit(" host"), _pick(seed, "host", 4).cast("string"), F.lit(" app"), _pick(seed, "app", 3).cast("string"), F.lit(": "))
    return typed.select("line_no", F.concat(head, text).alias("value"), F.col("anomaly_type").isNotNull().cast("int").alias("is_anomaly"), "anomaly_type")


def training(spark: SparkSession, lines: int = 10_000, seed: int = 42) -> DataFrame:
    """Normal lines only."""
    return generate(spark, lines, 0.0, seed)


def inference_normal(spark: SparkSession, lines: int = 1_000, seed: int = 43) -> DataFrame:
    return generate(spark, lines, 0.0, seed)


def inference_anomaly(spark: SparkSession, lines: int = 1_500, rate: float = 0.15, seed: int = 44) -> DataFrame:
    """All kinds of anomalies, with bursts."""
    return generate(spark, lines, rate, seed, kinds=tuple(KINDS), bursts=True)


def oracle(lines: int, rate: float = 0.02, seed: int = 42, start: str = "2024-01-01 00:00:00", kinds: tuple[str, ...] = ("unseen", "error"), bursts: bool = False) -> str:
    """:func:`generate` as a DuckDB statement: bursts by a join instead of looking back."""
    digits = lambda text, first=1: f"CAST('0x' || substr(md5({text}), {first}, 8) AS BIGINT)"
    pick = lambda salt, n: f"{digits(f'line_no || {chr(39)}:{seed}:{chr(39)} || {salt}')} % {n}"
    array = lambda pool: "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in pool) + "]"
    pools = " ".join(f"WHEN '{k}' THEN {array(KINDS[k])}" for k in kinds)
    text = f"pool[1 + {pick('salt', 'len(pool)')}]"
    for name, n in (("a", 16), ("b", 100), ("c", 65536)):
        field = f"salt || '{name}'"
        text = f"replace({text}, '{{{name}}}', CAST({pick(field, n)} AS VARCHAR))"
    hit = lambda first: digits(f"range || ':{seed}:hit'", first)
    return f"""
    WITH l AS (SELECT range AS line_no, {hit(1)} % {MILLION} < {int(rate * MILLION)} AS own, {hit(9)} % 10 = 0 AS begins, {hit(17)} % 21 + 10 AS size FROM range(0, {lines})),
    burst AS (SELECT DISTINCT l.line_no FROM l JOIN l AS b ON l.line_no > b.line_no AND l.line_no <= b.line_no + b.size WHERE b.own AND b.begins AND {bursts}),
    typed AS (SELECT line_no, CASE WHEN own THEN {array(kinds)}[1 + {pick("'kind'", len(kinds))}] WHEN line_no IN (SELECT line_no FROM burst) THEN 'burst' END AS anomaly_type FROM l),
    salted AS (SELECT *, coalesce(anomaly_type, 'normal') AS salt, CASE coalesce(anomaly_type, 'normal') WHEN 'normal' THEN {array(NORMAL)} {pools} ELSE {array(ERRORS)} END AS pool FROM typed)
    SELECT line_no, strftime(TIMESTAMP '{start}' + to_seconds(line_no), '%b %-d %H:%M:%S') || ' host' || {pick("'host'", 4)} || ' app' || {pick("'app'", 3)} || ': ' || {text} AS value,
           CAST(anomaly_type IS NOT NULL AS INT) AS is_anomaly, anomaly_type FROM salted"""
