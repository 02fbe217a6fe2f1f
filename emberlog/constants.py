"""Fixed values that decide the results: weights, thresholds, patterns, texts.

They are plain literals so a deployment can read them in one place.  The
operators take the tables below as defaults; pass your own mapping to
override one.
"""

# --- fixed values: event classes and how security-relevant each one is -------
EVENT_WEIGHTS = {
    "AUTH_FAIL": 1.00,
    "PRIVILEGE_EVENT": 0.70,
    "SERVICE_ERROR": 0.70,
    "WARNING": 0.50,
    "SERVICE_STOP": 0.30,
    "SESSION_OPEN": 0.25,
    "RESTART": 0.20,
    "SESSION_CLOSE": 0.10,
    "SERVICE_START": 0.15,
    "KERNEL_EVENT": 0.10,
    "INFO": 0.05,
}
DEFAULT_EVENT_WEIGHT = 0.05
EVENT_CLASSES = tuple(EVENT_WEIGHTS)

# --- fixed values: service sensitivity ---------------------------------------
SERVICE_SENSITIVITY = {
    "sshd": 1.0,
    "su": 0.9,
    "sudo": 0.9,
    "login": 0.8,
    "telnetd": 0.8,
    "ftpd": 0.7,
    "xinetd": 0.6,
    "unix_chkpwd": 0.7,
    "sendmail": 0.4,
    "named": 0.4,
    "cron": 0.4,
    "crond": 0.4,
    "systemd": 0.3,
    "logrotate": 0.3,
    "snmpd": 0.4,
    "squid": 0.3,
}
DEFAULT_SENSITIVITY = 0.2
SENSITIVE_SERVICE_FLOOR = 0.7

# --- fixed values: risk score ------------------------------------------------
RISK_WEIGHTS = {
    "event": 0.30,
    "service": 0.15,
    "burst": 0.15,
    "rarity": 0.10,
    "dbscan": 0.15,
    "forest": 0.15,
}
BURST_SATURATION = 50

# --- fixed values: severity bands, highest first -----------------------------
SEVERITY_THRESHOLDS = {"CRITICAL": 0.80, "HIGH": 0.60, "MEDIUM": 0.40}
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")

# --- fixed values: line formats ----------------------------------------------
SYSLOG_LINE = (
    r"^([A-Z][a-z]{2}\s+\d{1,2}\s\d{2}:\d{2}:\d{2})\s+(\S+)\s+"
    r"([\w./-]+(?:\([\w./-]+\))?(?:\s\d[\d.]*)?)(?:\[(\d+)\])?:\s*(.*)$"
)
ISO_LINE = (
    r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2})\s+(\S+)\s+"
    r"([\w./()-]+?)(?:\[(\d+)\])?:\s*(.*)$"
)

# --- fixed values: accepted CSV header names, first one present wins ---------
CSV_ALIASES = {
    "timestamp": ("timestamp", "time", "datetime", "date", "@timestamp", "ts"),
    "hostname": ("hostname", "host", "node", "machine"),
    "service": ("service", "program", "process", "app", "component", "daemon", "ident"),
    "message": ("message", "msg", "content", "log", "text", "description", "details"),
    "raw_event_type": ("event_type", "eventtype", "level", "type", "category"),
    "dbscan_cluster": ("dbscan_cluster",),
    "label": ("label", "actual_label", "is_anomaly", "anomaly", "ground_truth"),
}
CSV_REQUIRED = ("timestamp", "message")
# cell texts that mean "no value"
CSV_NULL_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# --- fixed values: classification phrases (on the lower-cased message) -------
AUTH_FAIL_TEXTS = (
    "authentication failure",
    "failed password",
    "failed login",
    "invalid user",
    "illegal user",
    "check pass; user unknown",
    "failed none",
    "login incorrect",
)
AUTH_FAIL_PATTERN = r"auth.*fail"
PRIVILEGE_SERVICES = ("su", "sudo")
PRIVILEGE_TEXTS = ("command=", "session opened for user root")
PRIVILEGE_WORDS = ("sudo",)
ERROR_TEXTS = ("exited abnormally", "fatal", "segfault", "failed")
ERROR_WORDS = ("error", "died")
STOP_TEXTS = ("shutdown succeeded", "shutting down", "terminated")
STOP_WORDS = ("stopped",)
START_TEXTS = ("startup succeeded",)
START_WORDS = ("started", "starting")

# --- fixed values: identifier extraction; (text that must occur, pattern) ----
RHOST = ("rhost=", r"rhost=([^\s]+)")
FROM_ADDRESS = ("from", r"\bfrom\s+(\d{1,3}(?:\.\d{1,3}){3})\b")
USER_ASSIGNMENT = ("user=", r"\buser=([^\s]+)")
USER_PHRASE = ("for", r"\b(?:for user|for invalid user|for)\s+([a-zA-Z0-9_.-]+)")

# --- fixed values: template rules, applied in this order ---------------------
TEMPLATE_RULES = (
    (r"rhost=\S+", "rhost=H"),
    (r"user=\S+", "user=U"),
    (r"for user \S+", "for user U"),
    (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "IP"),
    (r"0x[0-9a-fA-F]+", "HEX"),
    (r"\d+", "N"),
)

# --- fixed values: ground-truth spellings ------------------------------------
POSITIVE_LABELS = ("1", "true", "anomaly", "anomalous", "abnormal")
NEGATIVE_LABELS = ("0", "false", "normal")

# --- fixed values: rarity and volume thresholds ------------------------------
RARE_TEMPLATE_COUNT = 3
UNCOMMON_TEMPLATE_PCT = 1
QUIET_HOUR_PCT = 3

# --- fixed values: item spellings in time-window transactions ----------------
ANOMALY_ITEM = "ANOMALY_IN_WINDOW"
SERVICE_ITEM = "svc="
CLASS_ITEM = "evt="

# --- fixed values: trend bin widths in seconds -------------------------------
BIN_STEPS = (60, 300, 900, 1800, 3600, 10800, 21600, 43200, 86400, 604800)
BIN_TARGET = 48

# --- fixed values: relative time ranges in seconds ---------------------------
TIME_RANGES = {"Last 1 hour": 3600, "Last 24 hours": 86400, "Last 7 days": 604800}

# --- fixed values: detector names --------------------------------------------
METHOD_BOTH = "DBSCAN + Isolation Forest"
METHOD_DBSCAN = "DBSCAN"
METHOD_FOREST = "Isolation Forest"
METHOD_NONE = "—"
METHOD_NONE_SCORED = "Normal"

# --- fixed values: short reasons ---------------------------------------------
REASON_BOTH = "DBSCAN and Isolation Forest both identified unusual behaviour"
REASON_FOREST = "Isolation Forest anomaly score exceeded its unsupervised threshold"
REASON_DBSCAN = "Unusual feature pattern (DBSCAN noise)"
REASON_RARE = "Rare message pattern (seen {count}x)"

# --- fixed values: headlines -------------------------------------------------
HEADLINE_BURST = (
    "Repeated authentication failures were detected in a short time window — "
    "a typical brute-force or password-guessing indicator."
)
HEADLINE_BOTH = "DBSCAN and Isolation Forest both flagged this event as unusual compared with common activity."
HEADLINE_RARE = (
    "This event has a rare message pattern and sits outside every dense group of normal Linux activity."
)
HEADLINE_DBSCAN = (
    "This event's feature pattern is significantly different from normal Linux activity "
    "and belongs to the DBSCAN noise group."
)
HEADLINE_FOREST = "Isolation Forest flagged an unusual combination of event features."
HEADLINE_NONE = (
    "This event was not flagged as anomalous; the evidence below shows how it was scored."
)

# --- fixed values: evidence sentences ----------------------------------------
EVIDENCE_NOISE = (
    "**DBSCAN:** this event is in the noise group (label −1). In the standardised feature space "
    "(event class, hour, message length, message-pattern rarity, service rarity, burst size) it has fewer than "
    "{min_samples} neighbours within eps={eps}, so it does not belong to any dense group of normal Linux activity."
)
EVIDENCE_CLUSTER = (
    "**DBSCAN:** belongs to Cluster {cluster} ({size} events), so by density alone it looks like routine activity."
)
EVIDENCE_TEMPLATE = "**Message pattern:** this wording appears {count} time(s) ({pct}% of events) — {rarity}."
EVIDENCE_REPETITION = (
    "**Repetition:** {burst} `{event_class}` events from `{service}` occurred in the same {window} window."
)
EVIDENCE_BURST = (
    "**Burst rule:** at least {threshold} authentication failures from one service inside a {window} window "
    "(repeated-login-failure indicator)."
)
EVIDENCE_SOURCE = "**Source host `{source}`** is linked to {count} authentication-failure event(s)"
EVIDENCE_SOURCE_ACCOUNTS = " across {users} target account(s)"
EVIDENCE_ACCOUNT = "**Target account `{user}`** appears in {count} failed-authentication events."
EVIDENCE_TIMING = "**Timing:** only {share}% of events occur in hour {hour}:00."
EVIDENCE_FOREST = (
    "**Isolation Forest:** unsupervised anomaly score = {score}; the model {agree} with the ensemble detector label."
)
EVIDENCE_SENSITIVE = (
    "**Service sensitivity:** `{service}` is an access-control related service, which raises the risk score."
)

# --- fixed values: recommended actions per event class -----------------------
DEFAULT_ACTIONS = (
    "Review neighbouring events in the investigation timeline to understand context.",
    "Check whether the same message pattern appears across related events.",
    "Mark as benign if it matches known maintenance; otherwise escalate for analyst review.",
)
RECOMMENDED_ACTIONS = {
    "AUTH_FAIL": (
        "Identify the source host and check whether it is expected (admin jump host, scanner) or external.",
        "Search the same source for a *successful* login shortly after the failures (possible compromise).",
        "Rate-limit or block the source (firewall / fail2ban / SSH `MaxAuthTries`), and disable password auth for root where possible.",
        "If the targeted account is real, force a credential rotation and review its recent sessions.",
    ),
    "PRIVILEGE_EVENT": (
        "Confirm the user is authorised to use su/sudo on this host and that the timing matches a change window.",
        "Review commands run in the session and any new entries in sudoers or user accounts.",
        "Escalate to incident response if the account owner cannot explain the activity.",
    ),
    "SERVICE_ERROR": (
        "Check the service's recent logs and status for repeated crashes or exited-abnormally messages.",
        "Correlate with deployments, disk/memory pressure or dependency failures around the same time.",
        "If the service is security-relevant (auth, logging), treat repeated failures as a possible tampering indicator.",
    ),
    "WARNING": (
        "Review the warning in context; escalate only if it repeats or coincides with other anomalies.",
    ),
    "SERVICE_STOP": (
        "Verify the stop/shutdown was planned. Unplanned stops of logging or security services deserve follow-up.",
    ),
}

# --- fixed values: event summary and triage texts ----------------------------
PRIORITY_SUMMARY = {"CRITICAL": "P1 — urgent", "HIGH": "P2 — prompt"}
PRIORITY_SUMMARY_OTHER = "P3 — routine"
PRIORITY_TRIAGE = {"CRITICAL": "P1 — urgent analyst review", "HIGH": "P2 — prompt review"}
PRIORITY_TRIAGE_OTHER = "P3 — routine review"
DETAIL_DBSCAN = "DBSCAN flagged the event as outside the dense groups of common activity."
DETAIL_RARE = "This message pattern appears only {count} time(s) in the analyzed data."
DETAIL_FOREST = "Isolation Forest flagged an unusual combination of event features."
DETAIL_BURST = "{count} authentication failures formed a short-window burst."
DETAIL_BURST_UNSIZED = "Repeated authentication failures formed a short-window burst."
EVIDENCE_FALLBACK = "The detector identified a pattern that differs from normal activity."
ACTION_FALLBACK = "Review related events and verify whether the activity was expected."
HEADLINE_FALLBACK = "Unusual Linux activity detected"
ASSESSMENT_AUTH = (
    "Repeated authentication failures can result from mistyped or stale credentials, a misconfigured client, "
    "or password guessing. Check the source and whether any authentication succeeded; the detector cannot "
    "determine the cause from failures alone."
)
ASSESSMENT_OTHER = (
    "The detector found behavior that differs from the analyzed dataset. The cause is not established; "
    "validate whether the activity matches an approved operational change or indicates unauthorized behavior."
)
SUMMARY_CAVEAT = "The evidence above describes the specific signal and is not proof of compromise."
SUMMARY_ESCALATION = (
    "**Escalation criteria:** escalate if the source or account is unauthorized, the activity continues, "
    "or related events show successful access or other signs of impact."
)
TRIAGE_REASON = (
    "Reason: Unusual activity was detected and should be validated against surrounding events."
)
TRIAGE_CAVEAT = (
    "Validate the source and surrounding events before escalating; anomaly does not by itself prove compromise."
)
FACTS_WITHHELD = (
    "Hostnames, usernames, source addresses and raw log text are withheld from remote providers."
)
REDACTED = "[redacted]"

# --- fixed values: report texts ----------------------------------------------
REPORT_TITLE = "# Linux Log Anomaly Detection — Summary Report"
REPORT_NEXT_STEPS = (
    "1. Triage CRITICAL and HIGH anomalies in the Investigation page, starting with the highest risk score.",
    "2. For authentication-failure bursts, identify the source host, check for any later successful login from it, and block or rate-limit it.",
    "3. Review privilege (su/sudo) and service-error anomalies against change windows.",
    "4. Record benign findings and false positives to improve future review.",
)
REPORT_CLOSING = (
    "_Anomalous does not mean malicious: findings are risk indicators that require analyst review._"
)
REVIEW_TITLE = "# Analyst incident review"
REVIEW_NOTICE = (
    "AI is not configured. Use the standard summary and anomaly exports for a verified report."
)
REVIEW_FACTS_CAVEAT = (
    "Anomalies are not confirmed attacks. If ground-truth labels are supplied, "
    "they are used only for post-hoc evaluation."
)
REVIEW_CAVEAT = (
    "Anomalies are detector outputs, not confirmed attacks. Validate evidence and dispositions before sharing."
)
