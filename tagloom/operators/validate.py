"""Tag rules: each is a Column that is true where the tags keep it; the first that fails names the rejection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALID = "-._A-Za-z0-9^~"


@dataclass(frozen=True)
class Rule:
    name: str
    ok: Column


def _keys(tags: str) -> Column:
    return F.map_keys(tags)


def has_key(key: str = "name", tags: str = "tags") -> Rule:
    return Rule(f"has-key:{key}", F.map_contains_key(tags, key))


def key_length(low: int = 2, high: int = 60, tags: str = "tags") -> Rule:
    return Rule("key-length", F.forall(_keys(tags), lambda k: F.length(k).between(low, high)))


def name_value_length(name: tuple[int, int] = (2, 255), other: tuple[int, int] = (1, 120), tags: str = "tags") -> Rule:
    return Rule("name-value-length", F.forall(F.map_entries(tags), lambda e: F.when(e["key"] == "name", F.length(e["value"]).between(*name)).otherwise(F.length(e["value"]).between(*other))))


def value_length(low: int = 1, high: int = 120, tags: str = "tags") -> Rule:
    return Rule("value-length", F.forall(F.map_values(tags), lambda v: F.length(v).between(low, high)))


def valid_characters(default: str = VALID, overrides: dict[str, str] | None = None, tags: str = "tags") -> Rule:
    """Keys and values consist of the given characters; overrides have sets for the values of some keys."""
    overrides = overrides or {}

    def one(e: Column) -> Column:
        value = F.lit(True)
        if overrides:
            case = None
            for k, chars in overrides.items():
                hit = e["value"].rlike(f"^[{chars}]*$")
                case = F.when(e["key"] == k, hit) if case is None else case.when(e["key"] == k, hit)
            value = case.otherwise(e["value"].rlike(f"^[{default}]*$"))
        else:
            value = e["value"].rlike(f"^[{default}]*$")
        return e["key"].rlike(f"^[{default}]*$") & value

    return Rule("valid-characters", F.forall(F.map_entries(tags), one))


def max_user_tags(limit: int = 20, system_prefixes: Sequence[str] = ("sys.",), tags: str = "tags") -> Rule:
    def user(k: Column) -> Column:
        out = F.lit(True)
        for p in system_prefixes:
            out = out & ~k.startswith(p)
        return out

    return Rule("max-user-tags", F.size(F.filter(_keys(tags), user)) <= limit)


def reserved_key(prefix: str = "sys.", allowed: Sequence[str] = (), tags: str = "tags") -> Rule:
    return Rule(f"reserved-key:{prefix}", F.forall(_keys(tags), lambda k: ~k.startswith(prefix) | k.isin(*allowed) if allowed else ~k.startswith(prefix)))


def key_pattern(pattern: str, tags: str = "tags") -> Rule:
    return Rule("key-pattern", F.forall(_keys(tags), lambda k: k.rlike(f"^(?:{pattern})$")))


def value_pattern(pattern: str, tags: str = "tags") -> Rule:
    return Rule("value-pattern", F.forall(F.map_values(tags), lambda v: v.rlike(pattern)))


def composite(*rules: Rule) -> Rule:
    ok = F.lit(True)
    for r in rules:
        ok = ok & r.ok
    return Rule("composite", ok)


def defaults() -> list[Rule]:
    return [has_key(), key_length(), name_value_length(), valid_characters(), max_user_tags(), reserved_key()]


def validated(df: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """df with `failed`: the name of the first rule that a row breaks, null if it keeps all."""
    out = F.lit(None).cast("string")
    for r in reversed(rules if rules is not None else defaults()):
        out = F.when(~F.coalesce(r.ok, F.lit(False)), F.lit(r.name)).otherwise(out)
    return df.withColumn("failed", out)


def age_check(ts: Column, now: int, limit: int) -> Column:
    """Neither older nor newer than the limit."""
    return F.abs(ts - F.lit(now)) <= limit
