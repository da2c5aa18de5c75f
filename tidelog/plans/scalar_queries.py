"""Masking, parsing, predicates, sources and other scalar functions."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import masking, parsing, predicates, similarity
from ..operators import windows as win
from ..sources import logs
from ..sources.adapters import document_lines, events_log, probe_lines
from .registry import LOGS, SCORES, WINDOWED, query

PROBE = """probe AS (SELECT event_id AS line_no, 'open /var/log/u' || user_id || '/x.log at 0x' || lpad(printf('%x', event_id + 4096), 6, '0') || ' from 10.0.' || (k % 256) || '.' || (user_id % 256)
  || ' mac 00:1b:44:11:' || lpad(printf('%x', k % 256), 2, '0') || ':' || lpad(printf('%x', user_id % 256), 2, '0') || ' id 550e8400-e29b-41d4-a716-' || lpad(printf('%x', event_id), 12, '0')
  || ' v6 2001:0db8:85a3:0000:0000:8a2e:0370:' || lpad(printf('%x', k), 4, '0') || ' pid=' || user_id || ' dev eth' || (k % 8) || ' took ' || (k - 50) || ' load ' || k || '.5 end' AS raw, k, user_id
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""
_H = "[0-9a-fA-F]"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
_DUCK = {
    "path": (r"[/~][\w.\-_/]+", "<PATH>"),
    "hex": (f"0x{_H}+", "<HEX>"),
    "ipv4": (rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b", "<IP>"),
    "ipv6": (rf"\b(?:{_H}{{1,4}}:){{7}}{_H}{{1,4}}\b", "<IP6>"),
    "mac": (rf"\b(?:{_H}{{2}}:){{5}}{_H}{{2}}\b", "<MAC>"),
    "uuid": (rf"\b{_H}{{8}}-{_H}{{4}}-[1-5]{_H}{{3}}-[89abAB]{_H}{{3}}-{_H}{{12}}\b", "<UUID>"),
    "pid": (r"\b(pid|tid|uid|gid)=\d+\b", r"\1=<ID>"),
    "device": (r"\b([a-zA-Z]+)(\d+)\b", r"\1<ID>"),
}


def _mask_query(number: int, name: str) -> None:
    pattern, replacement = _DUCK[name]

    @query(f"f{number}_mask_{name}", f"WITH {PROBE} SELECT line_no, regexp_replace(raw, '{pattern}', '{replacement}', 'g') AS masked FROM probe")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return probe_lines(spark, sf).select("line_no", masking.step(name, "raw").alias("masked"))


for _number, _name in enumerate(_DUCK, 1):
    _mask_query(_number, _name)


@query("f9_mask_number", rf"WITH {PROBE} SELECT line_no, array_to_string(list_transform(string_split(regexp_extract(raw, 'dev .*'), ' '), lambda x: CASE WHEN regexp_full_match(x, '-?\d+(\.\d+)?') THEN '<NUM>' ELSE x END), ' ') AS masked FROM probe")
def f9(spark: SparkSession, sf: str) -> DataFrame:
    return probe_lines(spark, sf).select("line_no", masking.step("number", F.regexp_extract("raw", "dev .*", 0)).alias("masked"))


_CHAIN = "raw"
for _pattern, _replacement in _DUCK.values():
    _CHAIN = f"regexp_replace({_CHAIN}, '{_pattern}', '{_replacement}', 'g')"


@query("f10_mask_chain", rf"WITH {PROBE}, m AS (SELECT line_no, {_CHAIN} AS x FROM probe) SELECT line_no, array_to_string(list_transform(string_split(x, ' '), lambda t: CASE WHEN regexp_full_match(t, '-?\d+(\.\d+)?') THEN '<NUM>' ELSE t END), ' ') AS masked FROM m")
def f10(spark: SparkSession, sf: str) -> DataFrame:
    return probe_lines(spark, sf).select("line_no", masking.mask("raw").alias("masked"))


@query("f10_mask_document_lines")
def f10_docs(spark: SparkSession, sf: str) -> DataFrame:
    return document_lines(spark, sf).select("doc_id", "line", masking.mask("raw").alias("masked"))


@query("f10_mask_without_numbers", rf"WITH {PROBE} SELECT line_no, {_CHAIN} AS masked FROM probe")
def f10_flags(spark: SparkSession, sf: str) -> DataFrame:
    return probe_lines(spark, sf).select("line_no", masking.mask("raw", masking.MaskConfig(number=False)).alias("masked"))


@query("f10_mask_compat_c", rf"WITH {PROBE} SELECT line_no, regexp_replace(regexp_replace({_CHAIN.replace(chr(92) + 'b', '').replace(_OCTET, '[0-9]{1,3}')}, '-?[0-9]+(\.[0-9]+)?', '<NUM>', 'g'), 'unused', '') AS masked FROM probe")
def f10_c(spark: SparkSession, sf: str) -> DataFrame:
    return probe_lines(spark, sf).select("line_no", masking.mask("raw", steps=masking.COMPAT_C).alias("masked"))


#: raw lines of three shapes, by line number: syslog, kernel ring buffer, bare
SHAPED = LOGS + """,
shaped AS (SELECT line_no, timestamp, host, process, raw, CASE line_no % 3
  WHEN 0 THEN strftime(timestamp, '%b %-d %H:%M:%S') || ' ' || host || ' ' || process || '[' || k || ']: ' || raw
  WHEN 1 THEN '[  ' || k || '.' || lpad(CAST(user_id AS VARCHAR), 6, '0') || '] ' || raw
  ELSE '  ' || raw || '  ' END AS value FROM logs)"""


def shaped_lines(spark: SparkSession, sf: str) -> DataFrame:
    log = events_log(spark, sf)
    k, user = F.regexp_extract("raw", r"k=(\d+)", 1), F.regexp_extract("raw", r"user=(\d+)", 1)
    syslog = F.concat(F.date_format("timestamp", "MMM d HH:mm:ss"), F.lit(" "), "host", F.lit(" "), "process", F.lit("["), k, F.lit("]: "), "raw")
    dmesg = F.concat(F.lit("[  "), k, F.lit("."), F.lpad(user, 6, "0"), F.lit("] "), "raw")
    value = F.when(F.col("line_no") % 3 == 0, syslog).when(F.col("line_no") % 3 == 1, dmesg).otherwise(F.concat(F.lit("  "), "raw", F.lit("  ")))
    return log.select("line_no", value.alias("value"))


@query("f11_f14_parse_lines", f"WITH {SHAPED} SELECT line_no, CASE WHEN line_no % 3 = 0 THEN date_trunc('second', timestamp) END AS timestamp, CASE WHEN line_no % 3 = 0 THEN host END AS host, CASE WHEN line_no % 3 = 0 THEN process END AS process, raw FROM shaped")
def f11(spark: SparkSession, sf: str) -> DataFrame:
    return parsing.parse(shaped_lines(spark, sf), 2024).select("line_no", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "host", "process", "raw")


@query(
    "f15_f17_severity_words",
    f"""WITH {LOGS} SELECT line_no, regexp_matches(raw, '(?i)error|fail|exception|panic|fatal') AS error_profile, regexp_matches(raw, '(?i)error|fail|exception|panic|fatal|crash') AS error_quality,
    regexp_matches(raw, '(?i)error|fail|exception') AS error_sample, regexp_matches(raw, '(?i)error|fail|exception|warning|critical') AS error_analysis,
    regexp_matches(raw, '(?i)warn') AS warning_profile, regexp_matches(raw, '(?i)warn|deprecated') AS warning_quality, regexp_matches(raw, 'error|ERROR|fail|FAIL') AS error_exact FROM logs""",
)
def f15(spark: SparkSession, sf: str) -> DataFrame:
    errors = [predicates.is_error("raw", v).alias(f"error_{v}") for v in predicates.ERRORS]
    warnings = [predicates.is_warning("raw", v).alias(f"warning_{v}") for v in predicates.WARNINGS]
    return events_log(spark, sf).select("line_no", *errors, *warnings, predicates.is_error_exact_case("raw").alias("error_exact"))


@query("f18_calendar_fields", f"WITH {LOGS} SELECT line_no, CAST(hour(timestamp) AS INT) AS hour, CAST(isodow(timestamp) - 1 AS INT) AS weekday, CAST(timestamp AS DATE) AS day FROM logs")
def f18(spark: SparkSession, sf: str) -> DataFrame:
    return events_log(spark, sf).select("line_no", F.hour("timestamp").alias("hour"), F.weekday("timestamp").alias("weekday"), F.to_date("timestamp").alias("day"))


@query("f19_clip_and_ratio", "SELECT event_id AS line_no, least(greatest(value, 5.0), 30.0) AS clipped, round(value / greatest(user_id - 100, 1), 7) AS ratio FROM events")
def f19(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.adapters import table

    return table(spark, sf, "events").select(F.col("event_id").alias("line_no"), predicates.clip(F.col("value"), 5.0, 30.0).alias("clipped"), F.round(predicates.ratio(F.col("value"), F.col("user_id") - 100), 7).alias("ratio"))


@query("f20_dictionary_map", f"WITH {WINDOWED} SELECT line_no, CASE WHEN code % 2 = 0 THEN code END AS template_index, CASE WHEN code % 2 = 0 THEN code ELSE -1 END AS code FROM coded")
def f20(spark: SparkSession, sf: str) -> DataFrame:
    log = events_log(spark, sf)
    trained = win.vocabulary(log).where("index % 2 = 0")
    return win.encode(log, trained).select("line_no", "template_index", F.coalesce("template_index", F.lit(-1)).alias("code"))


@query(
    "f21_severity_ladders",
    f"""WITH RECURSIVE {SCORES} SELECT window_start_line, CASE WHEN score < 0.05 THEN 'normal' WHEN score < 0.2 THEN 'caution' ELSE 'high' END AS report, CASE WHEN score < 0.2 THEN 'normal' WHEN score < 0.5 THEN 'caution' ELSE 'high' END AS sequence,
    CASE WHEN score / 0.2 >= 3.0 THEN 'high' WHEN score / 0.2 >= 1.5 THEN 'medium' ELSE 'low' END AS reconstruction FROM scores""",
)
def f21(spark: SparkSession, sf: str) -> DataFrame:
    from .baseline_queries import scores

    s = F.col("score")
    return scores(spark, sf).select("window_start_line", predicates.baseline_severity(s).alias("report"), predicates.deeplog_severity(s).alias("sequence"), predicates.reconstruction_severity(s, F.lit(0.2)).alias("reconstruction"))


@query("f22_report_formatting", f"WITH {LOGS} SELECT line_no, printf('%.1f%%', k::DOUBLE) AS share, CASE WHEN len(raw) > 12 THEN raw[1:12] || '...' ELSE raw END AS short FROM logs")
def f22(spark: SparkSession, sf: str) -> DataFrame:
    k = F.regexp_extract("raw", r"k=(\d+)", 1).cast("double")
    return events_log(spark, sf).select("line_no", predicates.percent(k / 100).alias("share"), predicates.shortened(F.col("raw"), 12).alias("short"))


@query("f23_inverse_dictionary", f"WITH {WINDOWED} SELECT line_no, CASE WHEN code % 3 = 0 THEN template_id ELSE '<Unknown:' || code || '>' END AS name FROM coded")
def f23(spark: SparkSession, sf: str) -> DataFrame:
    log = events_log(spark, sf)
    full = win.vocabulary(log)
    known = full.where("index % 3 = 0").select(F.col("index").alias("template_index"), "template")
    return win.encode(log, full).join(known, "template_index", "left").select("line_no", F.coalesce("template", F.concat(F.lit("<Unknown:"), F.col("template_index").cast("string"), F.lit(">"))).alias("name"))


@query("f24_vocabulary_inversion", f"WITH {WINDOWED} SELECT count(*) AS n, min(code) AS low, max(code) AS high, max(code) - min(code) + 1 = count(*) AND min(code) = 0 AS contiguous FROM codes")
def f24(spark: SparkSession, sf: str) -> DataFrame:
    low, high, n = F.min("index"), F.max("index"), F.count("*")
    return win.vocabulary(events_log(spark, sf)).agg(n.alias("n"), low.alias("low"), high.alias("high"), ((high - low + 1 == n) & (low == 0)).alias("contiguous"))


@query("f25_first_template_per_id", f"WITH {LOGS} SELECT template_id, arg_min(raw, line_no) AS template FROM logs GROUP BY template_id")
def f25(spark: SparkSession, sf: str) -> DataFrame:
    return events_log(spark, sf).groupBy("template_id").agg(F.min_by("raw", "line_no").alias("template"))


@query("f26_session_ids", f"WITH {LOGS} SELECT line_no, substr(md5(host || ':' || CAST(hour(timestamp) AS VARCHAR)), 1, 8) AS session_id FROM logs")
def f26(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.sequence import session_id

    return events_log(spark, sf).select("line_no", session_id(F.col("host"), F.hour("timestamp")).alias("session_id"))


_VOCABULARY = "SELECT template_id AS template, row_number() OVER (ORDER BY template_id) - 1 AS i, string_split_regex(template_id, '[_ ]+') AS tt FROM (SELECT DISTINCT template_id FROM logs)"


@query(
    "t4_nearest_template",
    f"""WITH {LOGS}, x AS (SELECT DISTINCT process || ' ' || (k % 4) || ' ' || (k % 7) AS x FROM logs), v AS (SELECT DISTINCT process || ' ' || (k % 4) AS template FROM logs),
    n AS (SELECT template, row_number() OVER (ORDER BY template) - 1 AS i FROM v),
    p AS (SELECT x, i, template, string_split(x, ' ') AS a, string_split(template, ' ') AS b FROM x, n),
    j AS (SELECT *, len(list_filter(a, lambda t: list_contains(b, t))) AS n2 FROM p),
    s AS (SELECT x, i, CAST(floor(100 * CASE WHEN jac < 0.2 THEN jac ELSE 0.7 * jac + 0.3 * (1 - levenshtein(x, template) / greatest(len(x), len(template))) END) AS INT) AS s FROM (SELECT *, n2 / (len(a) + len(b) - n2) AS jac FROM j)),
    best AS (SELECT x, s, i, row_number() OVER (PARTITION BY x ORDER BY s DESC, i) AS r FROM s)
    SELECT x AS masked, s AS similarity, CASE WHEN s >= 50 THEN i ELSE -1 END AS predicted FROM best WHERE r = 1""",
)
def t4(spark: SparkSession, sf: str) -> DataFrame:
    k = F.regexp_extract("raw", r"k=(\d+)", 1).cast("long")
    log = events_log(spark, sf)
    template = F.concat_ws(" ", "process", (k % 4).cast("string"))
    lines = log.select(F.concat_ws(" ", template, (k % 7).cast("string")).alias("masked")).distinct()
    return similarity.nearest_template(lines, win.vocabulary(log.select(template.alias("template")))).select("masked", "similarity", F.col("predicted").cast("long").alias("predicted"))


@query("t5_t6_similarity_parts", "SELECT p_partkey, round(1 - levenshtein(p_name, p_type) / greatest(len(p_name), len(p_type)), 7) AS edit, round(len(list_filter(string_split(p_name, ' '), lambda t: list_contains(string_split(p_type, ' '), t))) / (len(string_split(p_name, ' ')) + len(string_split(p_type, ' ')) - len(list_filter(string_split(p_name, ' '), lambda t: list_contains(string_split(p_type, ' '), t)))), 7) AS jaccard FROM part")
def t5(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.adapters import table

    a, b = F.col("p_name"), F.col("p_type")
    return table(spark, sf, "part").select("p_partkey", F.round(similarity.edit_similarity(a, b), 7).alias("edit"), F.round(similarity.token_jaccard(similarity.tokens(a), similarity.tokens(b)), 7).alias("jaccard"))


def _files(spark: SparkSession, sf: str) -> str:
    """The shaped lines as text files in a temporary folder, a file for each host, lines in order."""
    folder = tempfile.mkdtemp(prefix="tidelog-files-")
    atexit.register(shutil.rmtree, folder, True)
    log = events_log(spark, sf).select("line_no", "host")
    lines = shaped_lines(spark, sf).join(log, "line_no")
    lines.repartition(8, "host").sortWithinPartitions("host", "line_no").select("host", "value").write.mode("overwrite").partitionBy("host").text(folder)
    return folder


_NUMBERED = f"WITH {SHAPED}, n AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY line_no) - 1 AS n FROM shaped)"


def _host(column: str = "path") -> Column:
    return F.regexp_extract(column, "host=(h[0-9]+)", 1).alias("host")


@query("s1_text_scan", f"{_NUMBERED} SELECT host, n AS line_no, value FROM n")
def s1(spark: SparkSession, sf: str) -> DataFrame:
    return logs.read_lines(spark, _files(spark, sf)).select(_host(), "line_no", "value")


@query("s5_log_discovery", f"{_NUMBERED} SELECT host, CAST(sum(strlen(value) + 1) AS BIGINT) AS length FROM n GROUP BY host")
def s5(spark: SparkSession, sf: str) -> DataFrame:
    return logs.discover(spark, _files(spark, sf)).select(_host(), "length")


@query("s6_capped_discovery", f"{_NUMBERED} SELECT host, CAST(sum(strlen(value) + 1) AS BIGINT) AS length FROM n GROUP BY host ORDER BY length DESC, host LIMIT 3")
def s6(spark: SparkSession, sf: str) -> DataFrame:
    return logs.discover(spark, _files(spark, sf), logs.SHELL_GLOBS, limit=3).select(_host(), "length")


@query("s7_concatenated_logs", f"{_NUMBERED} SELECT host, row_number() OVER (ORDER BY host, n) - 1 AS line_no, value FROM n")
def s7(spark: SparkSession, sf: str) -> DataFrame:
    return logs.concatenated(logs.read_lines(spark, _files(spark, sf))).select(_host("source"), "line_no", "value")


@query("s8_merged_sources", f"WITH {LOGS} SELECT CASE WHEN line_no % 2 = 0 THEN 'even' ELSE 'odd' END AS source, line_no, raw FROM logs")
def s8(spark: SparkSession, sf: str) -> DataFrame:
    log = events_log(spark, sf).select("line_no", "raw")
    return logs.merged({"even": log.where("line_no % 2 = 0"), "odd": log.where("line_no % 2 <> 0")})


@query("s9_format_sniff", f"{_NUMBERED} SELECT host, CASE WHEN bool_or(n < 10 AND line_no % 3 = 0) THEN 'syslog' ELSE 'generic' END AS format, count(*) AS total_lines FROM n GROUP BY host")
def s9(spark: SparkSession, sf: str) -> DataFrame:
    return logs.sniff(logs.read_lines(spark, _files(spark, sf))).select(_host(), "format", "total_lines")


@query("s3_json_dictionary", f"WITH {WINDOWED} SELECT template_id AS template, code AS index FROM codes")
def s3(spark: SparkSession, sf: str) -> DataFrame:
    return logs.dictionary_table(logs.dictionary_json(win.vocabulary(events_log(spark, sf)), "template", "index"))


@query("s4_preview", f"WITH {LOGS} SELECT line_no, raw FROM logs ORDER BY line_no LIMIT 10")
def s4(spark: SparkSession, sf: str) -> DataFrame:
    return logs.preview(events_log(spark, sf).select("line_no", "raw"), 10, "line_no")


@query("s11_json_results", f"WITH {LOGS} SELECT '{{\"line_no\":' || line_no || ',\"host\":\"' || host || '\"}}' AS value FROM logs")
def s11(spark: SparkSession, sf: str) -> DataFrame:
    return logs.result_lines(events_log(spark, sf).select("line_no", "host"))


@query("s15_masked_export", rf"WITH {PROBE}, m AS (SELECT line_no, {_CHAIN} AS x FROM probe) SELECT array_to_string(list_transform(string_split(x, ' '), lambda t: CASE WHEN regexp_full_match(t, '-?\d+(\.\d+)?') THEN '<NUM>' ELSE t END), ' ') AS value FROM m")
def s15(spark: SparkSession, sf: str) -> DataFrame:
    return logs.masked_export(probe_lines(spark, sf).select(F.concat(F.lit("  "), "raw", F.lit(" ")).alias("value")))


@query("f27_file_hashes", f"{_NUMBERED}, c AS (SELECT host, string_agg(value || chr(10), '' ORDER BY n) AS content FROM n GROUP BY host) SELECT host, sha256(content) AS sha256 FROM c")
def f27(spark: SparkSession, sf: str) -> DataFrame:
    return logs.file_hashes(spark, _files(spark, sf)).where("path like '%host=%'").select(_host(), "sha256")
