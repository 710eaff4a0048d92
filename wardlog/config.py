"""Configuration: wire names, limits and classification rules."""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass


@dataclass(frozen=True)
class WireNames:
    """Names that appear inside documents and signatures.

    ``namespace`` prefixes every schema version, the signing domain and the
    firewall set names, so an existing deployment is read and written
    unchanged by giving its namespace here.
    """

    namespace: str = "wardlog"
    documentation_url: str = "https://example.org/deny-list"
    label: str = "self-reported suspected probes"

    @property
    def signing_domain(self) -> str:
        return f"{self.namespace}-batch-v1\0"

    def schema(self, document: str) -> str:
        return f"{self.namespace}.{document}/v1"


@dataclass(frozen=True)
class Limits:
    """The bounds of the data model, in bytes or rows."""

    log_line_bytes: int = 65_536
    journal_record_bytes: int = 262_144
    cursor_bytes: int = 1_024
    event_id_bytes: int = 128
    username_bytes: int = 256
    password_bytes: int = 256
    path_bytes: int = 2_048
    rule_id_bytes: int = 128
    rule_ids: int = 16
    key_id_bytes: int = 128
    source_id_bytes: int = 64
    classifier_bytes: int = 128
    sequence_digits: int = 19
    batch_records: int = 10_000
    batch_bytes: int = 1_048_576
    envelope_bytes: int = 1_048_576 + 4_096
    hourly_buckets: int = 744
    safe_integer: int = 9_007_199_254_740_991
    window_days: int = 31
    reason_bytes: int = 200
    dimension_values: int = 10_000
    public_values: int = 100
    period_retention_days: int = 31
    deny_records: int = 50_000
    deny_days: int = 31
    recent_hours: int = 72
    persistent_days: int = 30
    persistent_min_sources: int = 2
    persistent_min_days: int = 3
    ipset_timeout_seconds: int = 2_147_483
    quarantine_entries: int = 256
    quarantine_file_bytes: int = 512
    input_files: int = 256
    files_per_source: int = 48
    receipt_bytes: int = 4_096
    clock_skew_minutes: int = 5
    watermark_seconds: int = 30


LIMITS = Limits()
NAMES = WireNames()


@dataclass(frozen=True)
class RuleConfig:
    """Classification rules. The patterns are fixed values written in the RE2
    dialect; :meth:`java_patterns` adapts them."""

    excluded_usernames: tuple[str, ...] = ()
    trusted_cidrs: tuple[str, ...] = ()
    eligible_statuses: tuple[int, ...] = (400, 403, 404)
    excluded_exact_paths: tuple[str, ...] = ()
    excluded_path_prefixes: tuple[str, ...] = ()
    sensitive_path_patterns: tuple[str, ...] = (
        r"(?i)[a-z0-9._%+-]+(?:@|%40)[a-z0-9.-]+\.[a-z]{2,}",
        r"(?i)(?:token|secret|password|api[_-]?key)[=/:%-][^/]+",
        r"eyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}",
    )
    max_path_bytes: int = 2_048

    def __post_init__(self) -> None:
        if "" in self.excluded_usernames:
            raise ValueError("excluded usernames must not be empty")
        if "" in self.excluded_exact_paths or "" in self.excluded_path_prefixes:
            raise ValueError("excluded paths must not be empty")
        if not self.eligible_statuses:
            raise ValueError("eligible statuses are required")
        if any(not 100 <= status <= 599 for status in self.eligible_statuses):
            raise ValueError("eligible statuses must lie between 100 and 599")
        if self.max_path_bytes <= 0:
            raise ValueError("max_path_bytes must be positive")
        for pattern in self.sensitive_path_patterns:
            re.compile(pattern)
        for cidr in self.trusted_cidrs:
            network = ipaddress.ip_network(cidr, strict=True)
            mapped = network.version == 6 and network.network_address.ipv4_mapped
            if str(network) != cidr or mapped:
                raise ValueError(f"trusted network {cidr!r} is not canonical")

    def java_patterns(self) -> tuple[str, ...]:
        """Java folds only ASCII unless told, and its dot skips more than \\n."""
        return tuple(
            "(?d)" + ("(?iu)" + p[4:] if p.startswith("(?i)") else p)
            for p in self.sensitive_path_patterns
        )
