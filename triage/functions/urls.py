"""URL pieces, query parameters and path templates, all as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from triage import rules
from triage.functions.tags import TagSet, let, word_rules

OBJECT_IDS = TagSet(rules.OBJECT_ID_NAMES + rules.PATH_SLOTS)
RISKS = TagSet(list(rules.RISK_TAG_WORDS) + rules.EXTRA_RISK_TAGS)

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_OPTIONAL_SCHEME = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?"


def _without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, _OPTIONAL_SCHEME + r"//([^/?#]*)", 1)


def host(url: Column) -> Column:
    """Lower-case host name without user info, port or brackets."""
    # user info goes by substring_index: a pattern that repeats a group takes a stack frame for every "@"
    return let(F.substring_index(netloc(url), "@", -1), lambda a: F.lower(
        F.regexp_extract(a, r"^\[?((?<=\[)[^\]]*|[^:\[\]]*)", 1)))


def path(url: Column) -> Column:
    return F.regexp_extract(url, _OPTIONAL_SCHEME + r"(?://[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(_without_fragment(url), r"(?s)^[^?]*\?(.*)$", 1)


def url_parts(url: Column) -> Column:
    return F.struct(scheme(url).alias("scheme"), netloc(url).alias("netloc"), host(url).alias("host"),
                    path(url).alias("path"), query(url).alias("query"))


def _decode(text: Column) -> Column:
    # a stray percent sign stands for itself
    return F.coalesce(F.try_url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")), text)


def unquote_plus(text: Column) -> Column:
    """Form decoding: '+' is a blank."""
    return F.when(text.rlike("[%+]"), _decode(text)).otherwise(text)


def unquote(text: Column) -> Column:
    """Percent decoding that keeps '+'."""
    return F.when(text.contains("%"), _decode(F.replace(text, F.lit("+"), F.lit("%2B")))).otherwise(text)


def query_pairs(text: Column, keep_blank: bool = True) -> Column:
    """``array<struct<name,value>>`` of a query string or form body."""
    pieces = F.filter(F.split(text, "&"), lambda p: (p != "") if keep_blank else p.rlike(r"(?s)^[^=]*=."))
    return F.transform(pieces, lambda p: F.struct(
        unquote_plus(F.substring_index(p, "=", 1)).alias("name"),
        unquote_plus(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).alias("value")))


def query_params(text: Column, keep_blank: bool = True) -> Column:
    """Sorted distinct parameter names."""
    return F.array_sort(F.array_distinct(F.transform(query_pairs(text, keep_blank), lambda p: p["name"])))


def normalize_path(raw: Column) -> Column:
    """Replace object identifiers in a path by ``{uuid}``, ``{id}`` or ``{slug}``.

    A fold, because the word before a slug is tested after its own rewriting.
    """
    clean = F.when(raw == "", F.lit("/")).otherwise(raw)

    def step(acc, part):
        new = (F.when((part == "") | part.startswith("{"), part)
               .when(part.rlike(rules.UUID_PART), F.lit("{uuid}"))
               .when(part.rlike(r"^\p{Nd}+\z"), F.lit("{id}"))
               .when(acc["n"].cast("boolean") & F.lower(acc["prev"]).isin(rules.RESOURCE_WORDS)
                     & part.rlike(rules.SLUG_PART), F.lit("{slug}"))
               .otherwise(part))
        return let(new, lambda v: F.struct(
            F.when(acc["n"] == 0, v).otherwise(F.concat(acc["out"], F.lit("/"), v)).alias("out"),
            v.alias("prev"), F.lit(1).alias("n")))

    start = F.struct(F.lit("").alias("out"), F.lit("").alias("prev"), F.lit(0).alias("n"))
    folded = F.aggregate(F.split(clean, "/"), start, step, lambda acc: acc["out"])
    # most paths hold nothing to rewrite: one look decides whether the fold runs at all
    may = r"(?Ui)(?:^|/)(?:\d+|[0-9a-f]{8}-[0-9a-f-]{27})(?:/|\z)|(?:^|/)(?:" + "|".join(rules.RESOURCE_WORDS) + ")/"
    return F.when(~clean.rlike(may) | clean.rlike(rules.STATIC_PATH), clean).otherwise(folded)


def object_id_mask(lowered_names: Column, normalized: Column) -> Column:
    """Known object-id names among the lower-cased parameter names plus the slots of the path template."""
    conds = {n: F.array_contains(lowered_names, n.lower()) for n in rules.OBJECT_ID_NAMES}
    conds |= {slot: normalized.contains(slot) for slot in rules.PATH_SLOTS}
    return OBJECT_IDS.mask(conds)


def risk_mask(lowered_path: Column, method: Column, object_ids: Column, url_scheme: Column) -> Column:
    """Risk tags of an endpoint; pass a materialized lower-case path, it is read once per word."""
    conds = word_rules(lowered_path, rules.RISK_TAG_WORDS)
    conds["websocket"] = url_scheme.isin("ws", "wss")
    conds["idor-candidate"] = object_ids != 0
    conds["state-changing"] = method.isin(rules.STATE_CHANGING_METHODS)
    return RISKS.mask(conds)


def root_domain(host_name: Column) -> Column:
    """The last two labels, as an approximation of the registrable domain."""
    return F.substring_index(F.lower(host_name), ".", -2)
