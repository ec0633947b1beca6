"""Column functions: severity, rates, timestamps, archetype codes, tokens, slugs and endpoint masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Archetype names in the order of their codes.
ARCHETYPES = ("NOMINAL", "DB_CONNECTION_POOL_SATURATION", "MEMORY_LEAK_GC_PAUSE", "CASCADING_THIRD_PARTY_FAILURE", "PAYMENT_GATEWAY_OUTAGE", "BLACK_FRIDAY_TRAFFIC_BURST")


def ordered_rules(rules: list[tuple[Column, object]], default=None) -> Column:
    """The value of the first predicate that holds."""
    out = F.lit(default) if not isinstance(default, Column) else default
    for predicate, value in reversed(rules):
        out = F.when(predicate, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def severity_of(sigma: Column) -> Column:
    """Severity by the size of a deviation."""
    s = F.abs(sigma)
    return ordered_rules([(s >= 5, "CRITICAL"), (s >= 3.5, "HIGH"), (s >= 2.5, "MEDIUM")], "LOW")


def error_rate(c2xx: Column, c4xx: Column, c5xx: Column) -> Column:
    """B2: share of 5xx, 0 without requests."""
    return F.coalesce(F.try_divide(c5xx.cast("double"), c2xx + c4xx + c5xx), F.lit(0.0))


def parse_ts(text: Column) -> Column:
    """An ISO timestamp, with or without Z; null if it is none."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def encode_archetype(name: Column) -> Column:
    """Code of an archetype's name; unknown names and null count as the first."""
    return ordered_rules([(name == n, i) for i, n in enumerate(ARCHETYPES)], 0)


def tokenise_technical(text: Column) -> Column:
    """lower-case runs of letters, digits, _, # and -; single characters only if they are digits."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9_#-]+)"), 1)
    return F.filter(found, lambda t: (F.length(t) > 1) | t.rlike("^[0-9]$"))


def slug(title: Column) -> Column:
    """lower case, only letters, digits and _ of any script, and every run of blanks, _ and - as one dash."""
    bare = F.regexp_replace(F.lower(title), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    kept = F.regexp_replace(bare, r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f-]", "")
    return F.regexp_replace(kept, r"(?U)[\s\x1c-\x1f_-]+", "-")


def chunk_id(stem: Column, title: Column) -> Column:
    return F.concat(stem, F.lit("#"), slug(title))


def normalise_endpoint(path: Column) -> Column:
    """Path parts that name one thing (long, digits only, trace or incident ids) become {id}."""
    mask = lambda p: F.when((F.length(p) > 20) | p.rlike("^[0-9]+$") | p.startswith("tr-") | p.startswith("INC-"), "{id}").otherwise(p)
    return F.array_join(F.transform(F.split(path, "/"), mask), "/")
