"""Personal-data patterns, findings, redaction and export policies as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Finding type, pattern, mark; redaction runs in this order.
PATTERNS = (
    ("email_address", r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b", "[EMAIL REDACTED]"),
    ("phone_number", r"\b(?:\+?1[\s\-.]?)?\(?\d{3}\)?[\s\-.]?\d{3}[\s\-.]?\d{4}\b", "[PHONE REDACTED]"),
    ("ssn_like", r"\b\d{3}[-\s]\d{2}[-\s]\d{4}\b", "[SSN REDACTED]"),
    ("credit_card_like", r"\b(?:\d{4}[\s\-]){3}\d{4}\b", "[CARD REDACTED]"),
)
#: Export profiles.
PROFILES = ("raw", "reviewed", "scrubbed", "metadata-only", "exclude")
NEED_SCRUB = ("scrubbed", "reviewed")


@dataclass(frozen=True)
class Security:
    """The security part of a configuration."""

    default_export_profile: str = "raw"
    scan_enabled: bool = True
    scrub_enabled: bool = True
    redact_email_addresses: bool = False
    redact_phone_numbers: bool = False
    redact_ssn_like_numbers: bool = False
    redact_credit_card_like_numbers: bool = False

    @classmethod
    def of(cls, config: dict | None) -> Security:
        given = (config or {}).get("security") or {}
        return cls(**{k: v for k, v in given.items() if k in cls.__dataclass_fields__ and v is not None})

    def flags(self) -> tuple[bool, ...]:
        return (self.redact_email_addresses, self.redact_phone_numbers, self.redact_ssn_like_numbers,
                self.redact_credit_card_like_numbers)


def _unicode(pattern: str) -> str:
    return "(?U)" + pattern


def _may_hold(text: Column, kind: str) -> Column:
    """A cheap test that every match of the pattern passes; most texts need no more than this."""
    if kind == "email_address":
        return F.contains(text, F.lit("@"))
    return F.regexp_like(text, F.lit(r"\p{Nd}{3}"))


def findings(text: Column) -> Column:
    """array<struct<finding_type, severity, detector, excerpt, count>>: one entry for each type that occurs."""
    entries = []
    for kind, pattern, _ in PATTERNS:
        hits = F.when(_may_hold(text, kind), F.regexp_extract_all(text, F.lit(_unicode(pattern)), F.lit(0)))
        entries.append(F.when(F.size(hits) > 0, F.struct(
            F.lit(kind).alias("finding_type"), F.lit("medium").alias("severity"), F.lit("regex").alias("detector"),
            F.substring(F.element_at(hits, 1), 1, 100).alias("excerpt"), F.size(hits).alias("count"))))
    return F.array_compact(F.array(*entries))


def scrub(text: Column, security: Security) -> Column:
    """Replace what the flags name, in the fixed order; without flags the text stays."""
    on = [p for p, flag in zip(PATTERNS, security.flags(), strict=True) if flag]

    def replaced(kinds: list) -> Column:
        out = text
        for _, pattern, mark in kinds:
            out = F.regexp_replace(out, _unicode(pattern), mark)
        return out

    # redaction adds neither "@" nor digits, so the tests on the original text hold for every step
    mail, rest = [p for p in on if p[0] == "email_address"], [p for p in on if p[0] != "email_address"]
    has_mail = _may_hold(text, "email_address") if mail else F.lit(False)
    has_rest = _may_hold(text, "") if rest else F.lit(False)
    return F.when(has_mail & has_rest, replaced(on)).when(has_mail, replaced(mail)).when(
        has_rest, replaced(rest)).otherwise(text)


def export_profile(profile: Column, default: str | None) -> Column:
    """The record's profile if it is known, else the default; a null or empty default is ``raw``."""
    return F.when(profile.isin(*PROFILES), profile).otherwise(F.lit(default or "raw"))


def apply_policy(body: Column, profile: Column, security: Security) -> tuple[Column, Column]:
    """(body to export, whether redaction changed it) for an effective profile."""
    if security.scrub_enabled:
        original = F.coalesce(body, F.lit(""))
        cleaned = scrub(original, security)
        needs = profile.isin(*NEED_SCRUB)
        out = F.when(needs, cleaned).when(profile == "metadata-only", F.lit(None)).otherwise(body)
        return out, F.coalesce(needs & (cleaned != original), F.lit(False))
    return F.when(profile == "metadata-only", F.lit(None)).otherwise(body), F.lit(False)
