"""Column functions on log text: normalise, classify, extract, template.

All of them are built-in expressions, so they stay in the JVM and inside
whole-stage codegen.  ``(?U)`` makes ``\\d \\w \\s \\b`` cover all of Unicode and
``(?d)`` keeps ``.`` and ``$`` from treating exotic line separators as breaks.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from emberlog import constants as K

FLAGS = "(?Ud)"

# Every character Unicode counts as white space.
WHITESPACE = "".join(
    chr(c)
    for c in (
        *range(0x09, 0x0E),
        *range(0x1C, 0x21),
        0x85,
        0xA0,
        0x1680,
        *range(0x2000, 0x200B),
        0x2028,
        0x2029,
        0x202F,
        0x205F,
        0x3000,
    )
)


def _as_column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _matches(text: Column, pattern: str) -> Column:
    return text.rlike(FLAGS + pattern)


def _replace(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, FLAGS + pattern, by)


def strip(text) -> Column:
    """Trim all Unicode white space, not only blanks."""
    return F.btrim(_as_column(text), F.lit(WHITESPACE))


def normalise_service_raw(service) -> Column:
    """Drop ``[pid]`` anywhere and a trailing version number."""
    return _replace(_replace(_as_column(service), r"\[\d+\]", ""), r"\s[\d.]+$", "")


def normalise_service(service_raw) -> Column:
    """Drop a trailing ``(...)`` part; an empty name becomes ``unknown``."""
    base = strip(_replace(_as_column(service_raw), r"\(.*\)$", ""))
    return F.when(base == "", F.lit("unknown")).otherwise(base)


def _any_text(text: Column, texts=(), words=()) -> Column:
    """Literal search first; the word-boundary regex runs only on rows that hold the word."""
    hit = F.lit(False)
    for phrase in texts:
        hit = hit | text.contains(phrase)
    for word in words:
        hit = hit | (text.contains(word) & _matches(text, rf"\b{word}\b"))
    return hit


def classify_event(lowered, service, raw_event_type=None) -> Column:
    """Ordered rules on the lower-cased message; the first one that holds names the class."""
    text, svc = _as_column(lowered), _as_column(service)
    raw = F.lit("") if raw_event_type is None else F.upper(F.coalesce(_as_column(raw_event_type), F.lit("")))
    opened, closed = text.contains("session opened"), text.contains("session closed")
    auth_pattern = text.contains("auth") & text.contains("fail") & _matches(text, K.AUTH_FAIL_PATTERN)
    privileged = svc.isin(*K.PRIVILEGE_SERVICES) | _any_text(text, K.PRIVILEGE_TEXTS, K.PRIVILEGE_WORDS)
    rules = (
        ("AUTH_FAIL", _any_text(text, K.AUTH_FAIL_TEXTS) | auth_pattern),
        ("PRIVILEGE_EVENT", ~closed & privileged),
        ("SESSION_OPEN", opened),
        ("SESSION_CLOSE", closed),
        ("KERNEL_EVENT", (svc == "kernel") & (raw != "ERROR")),
        ("SERVICE_ERROR", (raw == "ERROR") | _any_text(text, K.ERROR_TEXTS, K.ERROR_WORDS)),
        ("WARNING", (raw == "WARNING") | text.contains("warning")),
        ("SERVICE_STOP", (raw == "SERVICE_STOP") | _any_text(text, K.STOP_TEXTS, K.STOP_WORDS)),
        ("SERVICE_START", (raw == "SERVICE_START") | _any_text(text, K.START_TEXTS, K.START_WORDS)),
        ("RESTART", (raw == "RESTART") | text.contains("restart")),
    )
    case = F
    for name, holds in rules:
        case = case.when(holds, F.lit(name))
    return case.otherwise(F.lit("INFO"))


def _first_group(text: Column, *candidates: tuple[str, str]) -> Column:
    """Group 1 of the first pattern that matches, null when none does."""
    return F.coalesce(
        *[
            F.nullif(
                F.when(text.contains(hint), F.regexp_extract(text, FLAGS + pattern, 1)), F.lit("")
            )
            for hint, pattern in candidates
        ]
    )


def source_host(message) -> Column:
    return _first_group(_as_column(message), K.RHOST, K.FROM_ADDRESS)


def target_user(message) -> Column:
    return _first_group(_as_column(message), K.USER_ASSIGNMENT, K.USER_PHRASE)


def message_template(message) -> Column:
    """The whole wording with its variable parts replaced."""
    text = _as_column(message)
    for pattern, by in K.TEMPLATE_RULES:
        text = _replace(text, pattern, by)
    return text


def token_count(message) -> Column:
    text = strip(message)
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, FLAGS + r"\s+")))


def digit_ratio(message) -> Column:
    text = _as_column(message)
    return F.regexp_count(text, F.lit(FLAGS + r"\d")) / F.greatest(F.length(text), F.lit(1))


def contains_text(needle: str, *columns: str) -> Column:
    """Case-insensitive literal search over several columns; nulls never match."""
    wanted = F.lower(F.lit(needle.strip()))
    hit = F.lit(False)
    for name in columns:
        hit = hit | F.lower(F.coalesce(F.col(name), F.lit(""))).contains(wanted)
    return hit


def redact(text, *identifiers) -> Column:
    """Replace every identifier value (taken from columns) inside ``text``."""
    out = _as_column(text)
    for identifier in identifiers:
        value = F.coalesce(_as_column(identifier), F.lit(""))
        out = F.when(value != "", F.replace(out, value, F.lit(K.REDACTED))).otherwise(out)
    return out
