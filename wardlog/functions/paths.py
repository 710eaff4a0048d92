"""Request-target expressions used by the HTTP rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlog.config import RuleConfig
from wardlog.functions.binding import bind
from wardlog.functions.text import bounded_text, holds

# Rule identifiers and the file names that mark a probe.
RULE_TRAVERSAL = "http/path-traversal-v1"
RULE_SENSITIVE_FILE = "http/sensitive-file-v1"
SENSITIVE_FILES = (
    "/etc/passwd",
    "/etc/shadow",
    "/windows/win.ini",
    "/.env",
    "/.git/config",
    "/proc/self/environ",
)


def strip_query(target: Column) -> Column:
    return F.regexp_extract(target, r"\A[^?#]*", 0)


def percent_decode(col: Column) -> Column:
    """Decode %XX once and leave '+' alone. Null when an escape is malformed,
    including the non-ASCII digits that the JVM decoder would accept."""
    malformed = col.rlike("%(?![0-9A-Fa-f]{2})")
    return F.when(~malformed, F.try_url_decode(F.replace(col, F.lit("+"), F.lit("%2B"))))


def path_representations(path: Column) -> Column:
    """ARRAY<STRUCT<name, value>>: the path raw, decoded once and twice, as
    far as decoding succeeds and still changes something."""

    def step(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    def decoded(once: Column) -> Column:
        twice = percent_decode(once)
        return (
            F.when(once.isNull() | (once == path), F.array(step("raw", path)))
            .when(
                twice.isNull() | (twice == once),
                F.array(step("raw", path), step("decoded_once", once)),
            )
            .otherwise(
                F.array(step("raw", path), step("decoded_once", once), step("decoded_twice", twice))
            )
        )

    return bind(percent_decode(path), decoded)


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def path_excluded(representations: Column, exact, prefixes) -> Column:
    return F.exists(
        representations,
        lambda r: _any(
            [r["value"].isin(*exact)] * bool(exact) + [r["value"].startswith(p) for p in prefixes]
        ),
    )


def path_sensitive(representations: Column, java_patterns) -> Column:
    return F.exists(
        representations, lambda r: _any([r["value"].rlike(p) for p in java_patterns])
    )


def _folded(value: Column) -> Column:
    # A dotted capital I lowers to a plain i, not to two code points.
    return F.lower(F.translate(value, "\\İ", "/i"))


def http_rules(representations: Column) -> Column:
    """STRUCT<rule_ids ARRAY<STRING>, matched_representation STRING>."""
    folded = F.transform(
        representations,
        lambda r: F.struct(r["name"].alias("name"), _folded(r["value"]).alias("value")),
    )

    def judged(reps: Column) -> Column:
        traversal = lambda r: F.contains(r["value"], F.lit("../"))
        sensitive = lambda r: _any([F.contains(r["value"], F.lit(f)) for f in SENSITIVE_FILES])
        hits = F.filter(reps, lambda r: traversal(r) | sensitive(r))
        return F.struct(
            F.array_compact(
                F.array(
                    F.when(F.exists(reps, traversal), F.lit(RULE_TRAVERSAL)),
                    F.when(F.exists(reps, sensitive), F.lit(RULE_SENSITIVE_FILE)),
                )
            ).alias("rule_ids"),
            F.when(F.size(hits) > 0, F.get(hits, F.lit(0))["name"]).alias("matched_representation"),
        )

    return bind(folded, judged)


def http_verdict(target: Column, rules: RuleConfig) -> Column:
    """Everything the rules say about one eligible target, decoded once:
    STRUCT<path, matched_representation, rule_ids>, or null when the path is
    excluded, holds private data or matches no rule."""

    def over(path: Column) -> Column:
        def judge(reps: Column) -> Column:
            dropped = F.lit(False)
            if rules.excluded_exact_paths or rules.excluded_path_prefixes:
                dropped = path_excluded(reps, rules.excluded_exact_paths, rules.excluded_path_prefixes)
            if rules.sensitive_path_patterns:
                dropped = dropped | path_sensitive(reps, rules.java_patterns())
            found = lambda r: F.when(
                (F.size(r["rule_ids"]) > 0) & ~dropped,
                F.struct(
                    path.alias("path"),
                    r["matched_representation"].alias("matched_representation"),
                    r["rule_ids"].alias("rule_ids"),
                ),
            )
            return bind(http_rules(reps), found)

        return bind(path_representations(path), judge)

    return bind(strip_query(target), over)


def http_eligible(target: Column, status: Column, rules: RuleConfig) -> Column:
    """Cheap filters first: status, origin form, then the path's text."""
    return (
        holds(status.isin(*rules.eligible_statuses))
        & holds(target.startswith("/"))
        & bounded_text(strip_query(target), rules.max_path_bytes)
    )
