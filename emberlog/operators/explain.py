"""Why each event got its verdict: evidence, headline, actions, context, related events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from emberlog import constants as K
from emberlog.functions import scoring
from emberlog.functions.texts import fill, present, two_places, with_commas
from emberlog.operators.ordering import with_row_index
from emberlog.operators.skew import attach_by_key
from emberlog.params import DEFAULTS, Params
from emberlog.session import store


def recommended_actions(event_class="event_class") -> Column:
    """Recommended actions of a class; unknown classes get the default list."""
    listed = lambda items: F.array(*[F.lit(i) for i in items])
    case = F
    for name, items in K.RECOMMENDED_ACTIONS.items():
        case = case.when(F.col(event_class) == name, listed(items))
    return case.otherwise(listed(K.DEFAULT_ACTIONS))


def with_actions(events: DataFrame) -> DataFrame:
    return events.withColumn("actions", recommended_actions())


def headline() -> Column:
    noise, forest = F.col("dbscan_noise"), F.col("iforest_noise")
    return (
        F.when(F.col("auth_burst"), F.lit(K.HEADLINE_BURST))
        .when(noise & forest, F.lit(K.HEADLINE_BOTH))
        .when(noise & (F.col("tmpl_freq") <= K.RARE_TEMPLATE_COUNT), F.lit(K.HEADLINE_RARE))
        .when(noise, F.lit(K.HEADLINE_DBSCAN))
        .when(forest, F.lit(K.HEADLINE_FOREST))
        .otherwise(F.lit(K.HEADLINE_NONE))
    )


def template_share(total: Column) -> Column:
    return F.col("tmpl_freq") / total * 100


def rarity_word(total: Column) -> Column:
    return (
        F.when(F.col("tmpl_freq") <= K.RARE_TEMPLATE_COUNT, F.lit("very rare"))
        .when(template_share(total) < K.UNCOMMON_TEMPLATE_PCT, F.lit("uncommon"))
        .otherwise(F.lit("common"))
    )


# ------------------------------------------------------------ facts to join
def source_facts(events: DataFrame) -> DataFrame:
    """Per source: rows, authentication failures, distinct accounts they targeted."""
    failing = F.col("event_class") == "AUTH_FAIL"
    return (
        events.where(F.col("src_host").isNotNull())
        .groupBy("src_host")
        .agg(
            F.count("*").alias("source_rows"),
            F.count_if(failing).alias("source_failures"),
            F.countDistinct(F.when(failing, F.col("target_user"))).alias("source_accounts"),
        )
    )


def account_facts(events: DataFrame) -> DataFrame:
    """Per target account: rows and authentication failures."""
    return (
        events.where(F.col("target_user").isNotNull())
        .groupBy("target_user")
        .agg(
            F.count("*").alias("account_rows"),
            F.count_if(F.col("event_class") == "AUTH_FAIL").alias("account_failures"),
        )
    )


def hour_facts(events: DataFrame) -> DataFrame:
    """Share of all events per hour of day, in percent."""
    total = events.agg(F.count("*").alias("n")).scalar()
    return events.groupBy("hour").agg(F.count("*").alias("hour_rows")).withColumn(
        "hour_share", F.col("hour_rows") / total * 100
    )


def cluster_facts(events: DataFrame) -> DataFrame:
    return events.groupBy("dbscan_cluster").agg(F.count("*").alias("cluster_size"))


def with_facts(focus: DataFrame, events: DataFrame) -> DataFrame:
    """Join the per-source, per-account, per-cluster and per-hour facts of ``events`` to ``focus``."""
    by = F.col("event_id")
    out = attach_by_key(focus, source_facts(events), ["src_host"], by, "source_rows")
    out = attach_by_key(out, account_facts(events), ["target_user"], by, "account_rows")
    out = attach_by_key(out, cluster_facts(events), ["dbscan_cluster"], by, "cluster_size")
    return out.join(F.broadcast(hour_facts(events)), "hour", "left")  # 24 rows


def evidence(total: Column, params: Params, eps_used: float, min_samples_used: int) -> Column:
    """Up to nine sentences; one that does not apply is left out."""
    has = lambda name: F.col(name).isNotNull() & (F.col(name) != "")
    c = F.col
    density = F.when(
        c("dbscan_noise"), fill(K.EVIDENCE_NOISE, min_samples=min_samples_used, eps=eps_used)
    ).otherwise(
        fill(K.EVIDENCE_CLUSTER, cluster=c("dbscan_cluster"), size=with_commas(c("cluster_size")))
    )
    wording = fill(
        K.EVIDENCE_TEMPLATE,
        count=with_commas(c("tmpl_freq")),
        pct=F.format_string("%.2f", template_share(total)),
        rarity=rarity_word(total),
    )
    repetition = F.when(
        c("burst") > 1,
        fill(K.EVIDENCE_REPETITION, burst=c("burst"), event_class=c("event_class"),
             service=c("service"), window=params.window_label),
    )
    burst = F.when(
        c("auth_burst"),
        fill(K.EVIDENCE_BURST, threshold=params.burst_threshold, window=params.window_label),
    )
    accounts = F.when(
        c("source_accounts") > 0, fill(K.EVIDENCE_SOURCE_ACCOUNTS, users=c("source_accounts"))
    ).otherwise(F.lit(""))
    source = F.when(
        has("src_host"),
        F.concat(
            fill(K.EVIDENCE_SOURCE, source=c("src_host"), count=with_commas(c("source_failures"))),
            accounts,
            F.lit("."),
        ),
    )
    account = F.when(
        has("target_user") & (c("account_failures") > 1),
        fill(K.EVIDENCE_ACCOUNT, user=c("target_user"), count=with_commas(c("account_failures"))),
    )
    timing = F.when(
        c("hour_share") < K.QUIET_HOUR_PCT,
        fill(K.EVIDENCE_TIMING, share=F.format_string("%.1f", c("hour_share")),
             hour=F.format_string("%02d", c("hour"))),
    )
    agrees = c("model_pred") == (c("status") == "ANOMALY").cast("int")
    forest = fill(
        K.EVIDENCE_FOREST,
        score=two_places(c("model_prob")),
        agree=F.when(agrees, F.lit("agrees")).otherwise(F.lit("disagrees")),
    )
    sensitive = F.when(
        scoring.service_sensitivity() >= K.SENSITIVE_SERVICE_FLOOR,
        fill(K.EVIDENCE_SENSITIVE, service=c("service")),
    )
    return present(density, wording, repetition, burst, source, account, timing, forest, sensitive)


def explain(
    events: DataFrame,
    focus: DataFrame | None = None,
    params: Params = DEFAULTS,
    eps_used: float | None = None,
    min_samples_used: int | None = None,
) -> DataFrame:
    """``focus`` events (default: all) with ``headline``, ``evidence`` and ``actions``.

    Counts the events once, so that the sentences carry the total as a literal.
    """
    total = F.lit(events.count())
    eps = params.eps if eps_used is None else eps_used
    samples = params.min_samples if min_samples_used is None else min_samples_used
    told = with_facts(events if focus is None else focus, events).withColumns(
        {"headline": headline(), "evidence": evidence(total, params, eps, samples)}
    )
    return with_actions(told)


def risk_breakdown(events: DataFrame, max_template) -> DataFrame:
    """Six (component, contribution, max_weight) rows per event that add up to its risk."""
    top = F.lit(max_template) if isinstance(max_template, (int, float)) else max_template
    terms = scoring.risk_terms(top)
    names = {
        "event": F.concat(F.lit("Event type ("), "event_class", F.lit(")")),
        "service": F.concat(F.lit("Service sensitivity ("), "service", F.lit(")")),
        "burst": F.lit("Repetition / burst size"),
        "rarity": F.lit("Message-pattern rarity"),
        "dbscan": F.lit("DBSCAN noise membership"),
        "forest": F.lit("Isolation Forest anomaly score"),
    }
    rows = F.array(
        *[
            F.struct(
                names[k].alias("component"),
                (F.lit(weight) * terms[k]).alias("contribution"),
                F.lit(weight).alias("max_weight"),
            )
            for k, weight in K.RISK_WEIGHTS.items()
        ]
    )
    return events.select("event_id", F.explode(rows).alias("part")).select("event_id", "part.*")


# ----------------------------------------------------- context and relations
def event_context(events: DataFrame, seeds: DataFrame, before: int = 8, after: int = 8) -> DataFrame:
    """Events around each seed by position: (seed_id, offset, event columns).

    Each seed names the positions it wants, so this is an equi join on the
    unique position, whatever the distribution of times.
    """
    offsets = F.explode(F.sequence(F.lit(-before), F.lit(after)))
    wanted = seeds.select(
        F.col("event_id").alias("seed_id"), F.col("row_idx").alias("_at"), offsets.alias("offset")
    ).select("seed_id", "offset", (F.col("_at") + F.col("offset")).alias("row_idx"))
    return wanted.join(events, "row_idx")


def earliest_per_key(events: DataFrame, key: str, limit: int) -> DataFrame:
    """The first ``limit`` events per key by time.

    The rank filter becomes a group limit before the shuffle, so a hot key
    sends at most ``limit`` rows per map task.
    """
    order = W.partitionBy(key).orderBy("row_idx")
    return (
        events.where(F.col(key).isNotNull())
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= limit)
    )


def related_by_key(events: DataFrame, seeds: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """All events related to the seeds: links (seed_id, ``key``), and (event columns, rank by time in the key).

    Each seed and each event of a seed's key is one row, however large the key.  Ranks come from
    the dense position over (``key``, ``row_idx``), so no task orders a whole key.
    """
    known = events.where(F.col(key).isNotNull())
    placed = with_row_index(known, key, "row_idx", name="_at", keep=store)
    links = seeds.where(F.col(key).isNotNull()).select(F.col("event_id").alias("seed_id"), key)
    first = placed.groupBy(key).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    asked = first.join(links.select(key).distinct(), key, "left_semi")
    ranked = attach_by_key(placed, asked, [key], F.col("_at"), "_rows").where(F.col("_first").isNotNull())
    return links, ranked.select(*events.columns, (F.col("_at") - F.col("_first") + 1).alias("rank"))


def related_events(events: DataFrame, seeds: DataFrame, key: str, limit: int) -> DataFrame:
    """(seed_id, event columns, rank): the ``limit`` earliest events sharing the seed's ``key`` value.

    ``related_by_key`` gives all of them.

    The list depends on the key alone, so it is built once per key (``limit``
    events at most) and then attached to the seeds, a hot key's seeds being
    spread.  Seeds are never paired with all events of a key.
    """
    first = earliest_per_key(events, key, limit)
    listed = first.groupBy(key).agg(F.collect_list(F.struct(*first.columns)).alias("related"))
    wanted = seeds.where(F.col(key).isNotNull()).select(F.col("event_id").alias("seed_id"), key)
    asked = wanted.groupBy(key).agg(F.count("*").alias("seed_rows"))
    told = attach_by_key(wanted, listed.join(asked, key), [key], F.col("seed_id"), "seed_rows")
    return told.select("seed_id", F.inline("related"))


def key_totals(events: DataFrame, key: str) -> DataFrame:
    """Events and anomalies per value of ``key``."""
    return events.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("events"), F.count_if(F.col("status") == "ANOMALY").alias("anomalies")
    )


def latest_dispositions(saved: DataFrame) -> DataFrame:
    """Last write per event from an append-only table (event_id, status, note, saved_at)."""
    last = F.max_by(F.struct("status", "note"), F.struct("saved_at", "status", "note"))
    return saved.groupBy("event_id").agg(last.alias("last")).select(
        "event_id", F.col("last.status").alias("disposition"), F.col("last.note").alias("note")
    )


def with_dispositions(events: DataFrame, saved: DataFrame) -> DataFrame:
    return events.join(latest_dispositions(saved), "event_id", "left").withColumn(
        "disposition", F.coalesce("disposition", F.lit("Unreviewed"))
    )
