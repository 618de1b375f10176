"""Ordered declarative rules compiled to one column expression."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import category_path

ASSIGNED = "struct<rule:string,classifier_type:string,confidence:double,category_path:string,sensitivity:string,notebooklm_priority:string,export_profile:string>"


@dataclass(frozen=True)
class Assignment:
    category_path: str | None = None
    sensitivity: str | None = None
    notebooklm_priority: str | None = None
    export_profile: str | None = None


@dataclass(frozen=True)
class Rule:
    """Matches when any value of any list does; ``assign`` goes before ``assign_hint``."""

    name: str
    from_domain: tuple[str, ...] = ()
    from_contains: tuple[str, ...] = ()
    subject_contains: tuple[str, ...] = ()
    assign: Assignment | None = None
    assign_hint: Assignment | None = None

    @classmethod
    def of(cls, entry: dict) -> Rule:
        match = entry.get("match") or {}

        def values(key: str) -> tuple[str, ...]:
            given = match.get(key) or ()
            return (given,) if isinstance(given, str) else tuple(given)

        def assignment(key: str) -> Assignment | None:
            given = entry.get(key) or {}
            known = {k: v for k, v in given.items() if k in Assignment.__dataclass_fields__}
            return Assignment(**known) if given else None

        return cls(entry.get("name", ""), values("from_domain"), values("from_contains"), values("subject_contains"),
                   assignment("assign"), assignment("assign_hint"))

    def matches(self, sender: Column, recipients: Column, subject: Column) -> Column:
        """Addresses are the sender's and the recipients'; nulls count as empty; case is ignored."""
        addresses = F.transform(F.concat(
            F.array(F.coalesce(sender, F.lit(""))), F.coalesce(recipients, F.array().cast("array<string>"))), F.lower)
        title = F.lower(F.coalesce(subject, F.lit("")))

        def ends(domain: str) -> Column:
            return F.exists(addresses, lambda a: F.endswith(a, F.lit("@" + domain.lower())))

        def has(part: str) -> Column:
            return F.exists(addresses, lambda a: F.contains(a, F.lit(part.lower())))

        tests = [*map(ends, self.from_domain), *map(has, self.from_contains)]
        tests += [F.contains(title, F.lit(x.lower())) for x in self.subject_contains]
        return reduce(or_, tests, F.lit(False))

    def outcome(self) -> Column | None:
        """Struct of what the rule assigns; null when it has neither assignment nor hint."""
        chosen, kind, confidence = (self.assign, "rule", 1.0) if self.assign else (self.assign_hint, "rule_hint", 0.75)
        if chosen is None:
            return None
        path = category_path(F.lit(chosen.category_path)) if chosen.category_path else F.lit(None).cast("string")
        return F.struct(
            F.lit(self.name).alias("rule"), F.lit(kind).alias("classifier_type"), F.lit(confidence).alias("confidence"),
            path.alias("category_path"), F.lit(chosen.sensitivity).cast("string").alias("sensitivity"),
            F.lit(chosen.notebooklm_priority).cast("string").alias("notebooklm_priority"),
            F.lit(chosen.export_profile).cast("string").alias("export_profile")).cast(ASSIGNED)


def first_match(rules: Iterable[Rule], sender: Column, recipients: Column, subject: Column) -> Column:
    """What the first matching rule with an assignment or hint gives; null when none does."""
    chain = None
    for rule in rules:
        outcome = rule.outcome()
        if outcome is not None:
            test = rule.matches(sender, recipients, subject)
            chain = F.when(test, outcome) if chain is None else chain.when(test, outcome)
    return chain if chain is not None else F.lit(None).cast(ASSIGNED)
