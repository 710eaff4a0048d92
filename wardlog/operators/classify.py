"""Classification of observations and promotion into the event store.

Observations are flat: event_id, cursor, kind, observed_at (TIMESTAMP),
source_ip and the nullable username, password, request_target, status.
Extra columns (sensor, adapter, original text) pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlog.config import LIMITS, RuleConfig
from wardlog.functions.addresses import ip_number
from wardlog.functions.paths import http_eligible, http_verdict
from wardlog.functions.text import valid_rule_ids
from wardlog.operators.networks import contained, literal_prefixes

SSH = "ssh_auth_failure"
HTTP = "http_request"
RULE_SSH = "ssh/all-attempts-v1"


def _ssh_qualifies(rules: RuleConfig) -> Column:
    """An SSH failure that is neither of an excluded user nor trusted."""
    qualifies = F.col("kind") == SSH
    if rules.excluded_usernames:
        qualifies = qualifies & ~F.col("username").isin(*rules.excluded_usernames)
    if rules.trusted_cidrs:
        qualifies = qualifies & ~contained(ip_number(F.col("source_ip")), literal_prefixes(rules.trusted_cidrs))
    return qualifies


def classify_ssh(observations: DataFrame, rules: RuleConfig = RuleConfig()) -> DataFrame:
    """Every failed login qualifies unless its username is excluded or its
    address is trusted. Narrow: one filter and one literal column."""
    return observations.where(_ssh_qualifies(rules)).withColumn("rule_ids", F.array(F.lit(RULE_SSH)))


def _present(verdict: Column) -> Column:
    """Generator that yields the verdict's fields once where it is not null.
    A filter on the verdict would be pushed down and evaluate it twice."""
    return F.inline(F.filter(F.array(verdict), lambda v: v.isNotNull()))


def classify_http(observations: DataFrame, rules: RuleConfig = RuleConfig()) -> DataFrame:
    """HTTP probes with path (query stripped), matched_representation and
    rule_ids. Narrow; the regex checks run only on eligible rows."""
    target = F.col("request_target")
    eligible = observations.where((F.col("kind") == HTTP) & http_eligible(target, F.col("status"), rules))
    return eligible.select(*observations.columns, _present(http_verdict(target, rules)))


def promote(observations: DataFrame, rules: RuleConfig = RuleConfig()) -> DataFrame:
    """Promoted events: SSH failures and HTTP probes in one pass over the
    input. The request target is dropped, only the stripped path leaves the
    sensor."""
    target = F.col("request_target")
    nothing = F.lit(None).cast("string")
    ssh = F.struct(
        nothing.alias("path"), nothing.alias("matched_representation"), F.array(F.lit(RULE_SSH)).alias("rule_ids")
    )
    http = (F.col("kind") == HTTP) & http_eligible(target, F.col("status"), rules)
    verdict = F.when(_ssh_qualifies(rules), ssh).when(http, http_verdict(target, rules))
    kept = [c for c in observations.columns if c != "request_target"]
    return observations.select(*kept, _present(verdict)).drop("matched_representation")


def merge_rules(events: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply rule updates (event_id, rule_ids) to stored events.

    Returns every event with the merged ``rule_ids`` and ``promoted``, plus
    ``update_error`` naming why an update was refused: the event is not an SSH
    failure, is already in a batch, or the merged rules are invalid. Updates
    for unknown events come back as rows with only event_id and the error.
    """
    # One row per event id and no unbounded list: a duplicated update is an
    # error by contract, so its rules need not be collected.
    folded = updates.groupBy("event_id").agg(
        F.first("rule_ids").alias("_new"), F.count("*").alias("_updates")
    )
    joined = events.join(folded, "event_id", "full")
    merged = F.array_sort(F.array_union(F.coalesce("rule_ids", F.array().cast("array<string>")), "_new"))
    error = (
        F.when(F.col("_updates").isNull(), F.lit(None).cast("string"))
        .when(F.col("_updates") > 1, "duplicate_update")
        .when(F.col("kind").isNull(), "unknown_event")
        .when(~valid_rule_ids(F.col("_new")), "invalid_rules")
        .when(F.col("kind") != SSH, "not_ssh")
        .when(F.col("batch_sequence").isNotNull(), "already_batched")
        .when(F.size(merged) > LIMITS.rule_ids, "too_many_rules")
    )
    applied = F.col("_updates").isNotNull() & error.isNull()
    return joined.select(
        *[c for c in events.columns if c not in ("rule_ids", "promoted")],
        F.when(applied, merged).otherwise(F.col("rule_ids")).alias("rule_ids"),
        (F.coalesce("promoted", F.lit(False)) | applied).alias("promoted"),
        error.alias("update_error"),
    )
