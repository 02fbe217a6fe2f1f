from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from emberlog.functions import text
from emberlog.functions.timing import bin_seconds, floor_seconds, format_time


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    "raw, kept, short",
    [
        ("sshd(pam_unix)[12]", "sshd(pam_unix)", "sshd"),
        ("syslogd 1.4.1", "syslogd", "syslogd"),
        ("[7]", "", "unknown"),
        ("a[1]b", "ab", "ab"),
        ("x (y) ", "x (y) ", "x (y)"),
    ],
)
def test_service_names(spark, raw, kept, short):
    service_raw = text.normalise_service_raw(F.lit(raw))
    assert value(spark, service_raw) == kept
    assert value(spark, text.normalise_service(service_raw)) == short


@pytest.mark.parametrize(
    "message, service, raw, expected",
    [
        ("auth module did fail", "x", None, "AUTH_FAIL"),
        ("authorised, then failure", "x", None, "AUTH_FAIL"),
        ("COMMAND=/bin/ls", "cron", None, "PRIVILEGE_EVENT"),
        ("pseudo sudoers", "cron", None, "INFO"),
        ("run by sudo now", "cron", None, "PRIVILEGE_EVENT"),
        ("session closed", "su", None, "SESSION_CLOSE"),
        ("session opened for user bob", "cron", None, "SESSION_OPEN"),
        ("io error", "kernel", None, "KERNEL_EVENT"),
        ("io error", "kernel", "error", "SERVICE_ERROR"),
        ("terrors everywhere", "x", None, "INFO"),
        ("an error", "x", None, "SERVICE_ERROR"),
        ("it died.", "x", None, "SERVICE_ERROR"),
        ("Warning: low", "x", None, "WARNING"),
        ("low", "x", "warning", "WARNING"),
        ("stopped", "x", None, "SERVICE_STOP"),
        ("starting up", "x", None, "SERVICE_START"),
        ("restarted", "x", None, "RESTART"),
        ("hello", "x", "RESTART", "RESTART"),
        ("hello", "x", None, "INFO"),
    ],
)
def test_event_classes(spark, message, service, raw, expected):
    got = text.classify_event(F.lower(F.lit(message)), F.lit(service), F.lit(raw).cast("string"))
    assert value(spark, got) == expected


@pytest.mark.parametrize(
    "message, source, user",
    [
        ("rhost=h.example user=bob", "h.example", "bob"),
        ("ruser=eve from 10.0.0.1", "10.0.0.1", None),
        ("for user ann by root", None, "ann"),
        ("for invalid user u1 from 1.2.3.4 port", "1.2.3.4", "u1"),
        ("waiting for job-7", None, "job-7"),
        ("nothing", None, None),
    ],
)
def test_identities(spark, message, source, user):
    m = F.lit(message)
    assert value(spark, text.source_host(m)) == source
    assert value(spark, text.target_user(m)) == user


def test_template_order_and_length(spark):
    m = F.lit("ruser=a user=b rhost=1.2.3.4 for user c at 0x1F from 10.0.0.1 x9 " + "z" * 80)
    got = value(spark, text.message_template(m))
    assert got.startswith("ruser=U user=U rhost=H for user U at HEX from IP xN zz") and got.endswith("z" * 80)


def test_unicode_text(spark):
    assert value(spark, text.strip(F.lit("   café 　"))) == "café"
    assert value(spark, text.token_count(F.lit("a b  c"))) == 3
    assert value(spark, text.token_count(F.lit("   "))) == 0
    assert value(spark, text.message_template(F.lit("n=٤٢"))) == "n=N"


def test_digit_ratio(spark):
    assert value(spark, text.digit_ratio(F.lit("a1b2"))) == 0.5
    assert value(spark, text.digit_ratio(F.lit(""))) == 0.0


def test_search_is_literal(spark):
    rows = spark.createDataFrame([("a.c", None), ("abc", None), (None, "A.C")], "m string, n string")
    assert rows.where(text.contains_text(" A.c ", "m", "n")).count() == 2


def test_redaction_skips_missing_values(spark):
    rows = spark.createDataFrame([("web1 saw 10.0.0.1", "web1", None)], "t string, h string, s string")
    assert rows.select(text.redact("t", "h", "s")).first()[0] == "[redacted] saw 10.0.0.1"


def test_times(spark):
    old = F.lit("1900-06-09 06:06:20").cast("timestamp")
    assert str(value(spark, floor_seconds(old, 300))) == "1900-06-09 06:05:00"
    assert value(spark, format_time(old, False)) == "Jun 09 06:06:20"
    assert value(spark, format_time(F.lit(None).cast("timestamp"), True)) == "—"
    spans = {0: 60, 48 * 60: 60, 48 * 61: 300, 48 * 86400: 86400, 48 * 90000: 604800, 48 * 10**7: 604800}
    for span, width in spans.items():
        assert value(spark, bin_seconds(F.lit(float(span)))) == width
