from __future__ import annotations

import csv
import random

import pytest
from pyspark.sql import functions as F

from emberlog.operators.features import clean
from emberlog.sources import csv_logs, logs as log_files, sinks, text_logs, time_shapes
from emberlog.sources.split_csv import read_split_csv

LINES = [
    "Jun  9 06:06:20 combo sshd(pam_unix)[123]: authentication failure; ruser= rhost=1.2.3.4 user=root",
    "Jun 9 06:06:20 combo syslogd 1.4.1: restart.",
    "Jun  9 06:06:21 combo su(pam_unix)[5]: session opened for user root by (uid=0)",
    "Jun  9 06:06:22 combo su(pam_unix)[5]: session closed for user root",
    "Jun  9 06:06:23 combo kernel: I/O error on hda",
    "Feb 29 01:00:00 combo cron: x",
    "",
    "   \t",
    "junk without structure",
]
ISO = "2026-09-10 00:07:00 h1 sshd[9]: Failed password for invalid user bob from 10.0.0.1 port 22"


@pytest.fixture(scope="module")
def text_file(tmp_path_factory):
    path = tmp_path_factory.mktemp("text") / "messages.log"
    path.write_bytes("\n".join(LINES).encode() + b"\n")
    return str(path)


def rows_of(spark, text_file):
    return text_logs.resolve_timestamps(text_logs.parse_lines(text_logs.read_text_lines(spark, text_file)))


def test_classic_lines(spark, text_file):
    logs = text_logs.read_text_logs(spark, text_file)
    got = [tuple(r) for r in clean(logs).orderBy("line_no").select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), "service", "service_raw", "pid", "event_class", "src_host", "target_user"
    ).collect()]
    assert got == [
        ("1900-06-09 06:06:20", "sshd", "sshd(pam_unix)", "123", "AUTH_FAIL", "1.2.3.4", "root"),
        ("1900-06-09 06:06:20", "syslogd", "syslogd", None, "RESTART", None, None),
        ("1900-06-09 06:06:21", "su", "su(pam_unix)", "5", "PRIVILEGE_EVENT", None, "root"),
        ("1900-06-09 06:06:22", "su", "su(pam_unix)", "5", "SESSION_CLOSE", None, "root"),
        ("1900-06-09 06:06:23", "kernel", "kernel", None, "KERNEL_EVENT", None, None),
    ]


def test_iso_line(spark, tmp_path):
    path = tmp_path / "iso.txt"
    path.write_text(ISO + "\n")
    row = clean(text_logs.read_text_logs(spark, str(path))).first()
    assert (row["event_class"], row["src_host"], row["target_user"]) == ("AUTH_FAIL", "10.0.0.1", "bob")
    assert row["template"] == "Failed password for invalid user bob from IP port N"


def test_report_and_rejects(spark, text_file):
    rows = rows_of(spark, text_file)
    report = text_logs.parse_report(rows, filename="messages.log").first()
    assert (report["total_lines"], report["parsed_rows"], report["dropped_rows"]) == (7, 5, 2)
    assert report["has_year"] is False and report["parse_rate_pct"] == 71.4
    rejected = {r["line"]: r["reason"] for r in text_logs.rejected_lines(rows).collect()}
    assert rejected == {
        "Feb 29 01:00:00 combo cron: x": "invalid timestamp",
        "junk without structure": "unrecognised line",
    }


def test_assumed_leap_year_keeps_leap_day(spark, text_file):
    assert text_logs.read_text_logs(spark, text_file, assume_year=2024).count() == 6


def test_invalid_bytes_are_dropped(spark, tmp_path):
    path = tmp_path / "bad.log"
    path.write_bytes(b"Jun  9 06:06:23 combo kernel: a\xff\xfeb\n")
    assert text_logs.read_text_logs(spark, str(path)).first()["message"] == "ab"


def test_strict_input_errors(spark, tmp_path):
    junk = tmp_path / "junk.log"
    junk.write_text("nothing here\n")
    with pytest.raises(ValueError, match="No lines matched"):
        text_logs.read_text_logs(spark, str(junk), strict=True)
    undated = tmp_path / "undated.csv"
    undated.write_text("time,msg\nnever,hello\n")
    with pytest.raises(ValueError, match="valid timestamp"):
        csv_logs.read_csv_logs(spark, str(undated), strict=True)


def test_csv_aliases_quotes_and_defaults(spark, tmp_path):
    path = tmp_path / "logs.csv"
    path.write_text(
        'Date,Time,Msg,Level,Actual_Label\n'
        'x,2024-03-01 10:00:00,"said ""hi"",\nthen left",error,1\n'
        "x,03/02/2024 11:00:00,plain,NA,0\n"
        "x,not a time,dropped,,0\n"
    )
    got = [tuple(r) for r in csv_logs.read_csv_logs(spark, str(path), multi_line=True).orderBy("timestamp").select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm"), "hostname", "service", "message", "raw_event_type", "label"
    ).collect()]
    assert got == [
        ("2024-03-01 10:00", "unknown", "unknown", 'said "hi",\nthen left', "error", "1"),
        ("2024-03-02 11:00", "unknown", "unknown", "plain", None, "0"),
    ]


def test_csv_needs_time_and_message():
    with pytest.raises(ValueError, match="timestamp, message"):
        csv_logs.map_headers(["host", "level"])


def test_first_alias_in_list_order_wins():
    assert csv_logs.map_headers(["ts", " TIME ", "text", "msg"])["timestamp"] == " TIME "
    assert csv_logs.map_headers(["ts", "text", "msg"])["message"] == "msg"


@pytest.mark.parametrize(
    "shown, expected",
    [
        ("2024-03-01T10:00:00", "2024-03-01 10:00:00"),
        ("2024/3/1 10:00:00", "2024-03-01 10:00:00"),
        ("Fri Mar 1 10:00:00 2024", "2024-03-01 10:00:00"),
        ("1 Mar 2024 10:00:00", "2024-03-01 10:00:00"),
        ("Jun 9 06:06:20", None),
        ("soon", None),
    ],
)
def test_flexible_times(spark, shown, expected):
    text = F.lit(shown)
    got = spark.range(1).select(F.date_format(text_logs.flexible_time(text), "yyyy-MM-dd HH:mm:ss")).first()[0]
    assert got == expected


def test_exports_round_trip(spark, result, tmp_path):
    out = sinks.anomaly_export(result.events)
    sinks.write_csv(out, str(tmp_path / "anomalies"))
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "anomalies"))
    assert back.columns == list(sinks.REPORT_COLUMNS) and back.count() == out.count()
    sinks.write_events(result.events, str(tmp_path / "events"))
    plan = spark.read.parquet(str(tmp_path / "events")).where("date = '2024-01-03' AND severity = 'LOW'").select("event_id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in text and "PushedFilters: [IsNotNull(severity)" in text


def test_source_size(spark, text_file):
    import os

    shown = text_logs.source_size_kb(spark, text_file).first()[0]
    assert shown == round(os.path.getsize(text_file) / 1024, 2)


CELLS = ["plain", "with, comma", 'a "quoted" word', "two\nlines", "\n\n", '"', '"\n"', "", "é😀", "long " * 300, "crlf\r\nin a cell", "x\n" * 200]


@pytest.mark.parametrize("size", [120, 2000, 1 << 20])
def test_csv_over_many_splits(spark, tmp_path, size):
    """Records are whole wherever the files are split."""
    rng, written = random.Random(size), {}
    for name in ("b", "a", "c"):
        with open(tmp_path / f"{name}.csv", "w", newline="", encoding="utf-8") as out:
            writer = csv.writer(out, lineterminator="\r\n" if name == "a" else "\n")
            writer.writerow(["Time", "Message", "Host name"])
            written[name] = [[f"{name}{k}", rng.choice(CELLS), rng.choice(CELLS[:4])] for k in range(40)]
            writer.writerows(written[name])
    held = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        found = read_split_csv(spark, str(tmp_path)).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held[0])
        spark.conf.set("spark.sql.files.openCostInBytes", held[1])
    cells = [[c or None for c in row] for name in "abc" for row in written[name]]  # in the order of the files
    assert [list(r)[:-1] for r in found] == cells
    assert [r.line_no for r in found] == [41 * f + k + 1 for f in range(3) for k in range(40)]


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    held = [spark.conf.get(n) for n in names]
    spark.conf.set(names[1], 1)
    yield lambda size: spark.conf.set(names[0], size)
    for n, v in zip(names, held):
        spark.conf.set(n, v)


def test_one_reader_for_all_files(spark, tmp_path, small_splits):
    """Positions and rows are the same under three split sizes."""
    for name in ("b.log", "a.log"):
        (tmp_path / name).write_text("".join(f"Jun  9 06:{k % 60:02}:20 {name} sshd[{k}]: line {k}\n" for k in range(50)))
    (tmp_path / "c.csv").write_text('Date,Message,Host\n2026-01-02 03:04:05,"two\nlines",h\n2026-01-02 03:04:06,plain,h\n')
    seen = []
    for size in (200, 900, 1 << 20):
        small_splits(size)
        rows = log_files.read_logs(spark, str(tmp_path)).orderBy("line_no").select("line_no", "hostname", "message").collect()
        seen.append([tuple(r) for r in rows])
    assert seen[0] == seen[1] == seen[2]
    assert seen[0][:50] == [(k, "a.log", f"line {k}") for k in range(50)]
    assert [r[2] for r in seen[0][100:]] == ["two\nlines", "plain"]
    report = {r.file_type: (r.files, r.columns) for r in log_files.source_report(spark, str(tmp_path)).collect()}
    assert report["text"][0] == 2 and report["csv"] == (1, ["hostname", "message", "timestamp"])


TIMES = [
    ("Jun  9 06:06:20", "1900-06-09 06:06:20"), ("2026-09-10T00:07:00.123456789Z", "2026-09-10 00:07:00"),
    ("2026-09-10 00:07:00+02:00", "2026-09-09 22:07:00"), ("2026-09-10 00:07:00.5 -0130", "2026-09-10 01:37:00"),
    ("Thursday, 10 Sep 2026 1:07:09 pm", "2026-09-10 13:07:09"), ("10.9.2026", "2026-10-09 00:00:00"), ("13.9.2026 5:06", "2026-09-13 05:06:00"),
    ("09/13/2026, 12:05 AM", "2026-09-13 00:05:00"), ("10/Oct/2026:13:55:36 -0700", "2026-10-10 20:55:36"), ("20260910 010203", "2026-09-10 01:02:03"),
    ("Sep 10 01:02:03 2026", "2026-09-10 01:02:03"), ("Thu Sep 10 01:02:03 UTC 2026", "2026-09-10 01:02:03"), ("September 10, 2026", "2026-09-10 00:00:00"),
    ("2026/9/10 7 PM", "2026-09-10 19:00:00"), ("2026-02-30 01:02:03", None), ("13/13/2026", None), ("yesterday", None), ("", None), (None, None),
    ("12345", None), ("2026-9-10 25:00:00", None), ("Mon 9", None), ("10 Sep 2026 01:02:03", "2026-09-10 01:02:03"), ("2026-Sep-10 01:02", "2026-09-10 01:02:00"),
]


def test_lenient_times(spark):
    rows = spark.createDataFrame([(k, t, "x") for k, (t, _) in enumerate(TIMES)], "line_no long, time_text string, other string")
    found = time_shapes.lenient_timestamps(rows).orderBy("line_no")
    assert found.columns == ["line_no", "time_text", "other", "timestamp"]
    got = [(r.time_text, r.t) for r in found.select("time_text", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("t")).collect()]
    assert got == TIMES
