"""Redaction and sensitive-data detection over any text column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triage import rules
from triage.functions.tags import TagSet, contains_any, let, present

CATEGORIES = TagSet(rules.SENSITIVE_CATEGORIES)
SENTINEL = "\x01"


def redact(text: Column) -> Column:
    """Replace secrets and personal data by typed placeholders.

    The nine replacements run in order, and only on texts that pass one cheap
    necessary test, so clean text costs one regex pass instead of nine.
    """
    replaced = reduce(lambda c, r: F.regexp_replace(c, F.lit(r[1]), F.lit(r[2])), rules.REDACTIONS, text)
    return F.when(text.rlike(rules.REDACTION_PRETEST), replaced).otherwise(text)


def redact_table(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: redact(F.col(c)) for c in columns})


def redact_struct(df: DataFrame) -> DataFrame:
    """Redact every string of every nested column; secret-named fields go whole."""
    def walk(col: Column, dtype: T.DataType, name: str) -> Column:
        if isinstance(dtype, T.StringType):
            if secret_name.search(name):
                return F.when(col.isNotNull(), F.lit("<redacted-secret>"))
            return redact(col)
        if isinstance(dtype, T.ArrayType):
            return F.transform(col, lambda x: walk(x, dtype.elementType, ""))
        if isinstance(dtype, T.MapType) and isinstance(dtype.keyType, T.StringType):
            def entry(key, value):
                inner = walk(value, dtype.valueType, "")
                if isinstance(dtype.valueType, T.StringType):
                    inner = F.when(key.rlike(rules.SECRET_KEY_NAMES), F.lit("<redacted-secret>")).otherwise(inner)
                return inner
            return F.transform_values(col, entry)
        if isinstance(dtype, T.StructType):
            fields = [walk(col[f.name], f.dataType, f.name).alias(f.name) for f in dtype.fields]
            return F.when(col.isNotNull(), F.struct(*fields))
        return col

    import re

    secret_name = re.compile(rules.SECRET_KEY_NAMES)
    return df.select(*[walk(F.col(f.name), f.dataType, f.name).alias(f.name) for f in df.schema.fields])


def contains_sensitive(text: Column) -> Column:
    return ~redact(text).eqNullSafe(text)


def redaction_classes(text: Column) -> Column:
    """Sorted names of the redaction classes that still occur; the values are withheld."""
    labels: dict[str, list[str]] = {}
    for label, pattern, _ in rules.REDACTIONS:
        labels.setdefault(label, []).append(pattern)
    conds = [(reduce(lambda a, b: a | b, (text.rlike(p) for p in patterns)), label)
             for label, patterns in labels.items()]
    found = F.array_sort(present(*conds))
    return F.when(text.rlike(rules.REDACTION_PRETEST), found).otherwise(F.array().cast("array<string>"))


def redaction_audit(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per record and class still present in its text."""
    return df.select(*keep, F.explode(redaction_classes(F.col(text))).alias("redaction_class"))


def category_mask(name: Column, value: Column, low: Column | None = None, low_value: Column | None = None) -> Column:
    """Sensitive categories of a named value, as a mask over ``CATEGORIES``.

    Substring tests on the lower-cased texts decide which patterns run; pass those
    texts as columns where many values are judged.
    """
    low = F.lower(name) if low is None else low
    low_value = F.lower(value) if low_value is None else low_value
    key_words = ["key", "secret", "token"]
    may_key = contains_any(low, key_words) | contains_any(low_value, key_words)
    sensitive_name = low.rlike("api[_-]?key") | contains_any(low, rules.SENSITIVE_NAME_WORDS)
    return CATEGORIES.mask({
        "bearer_token": low.contains("authorization") & value.rlike(rules.BEARER_VALUE),
        "jwt": value.contains("eyJ") & value.rlike(rules.JWT_VALUE),
        "api_key": (low.contains("api") & low.contains("key"))
        | (may_key & F.concat(name, F.lit("="), value).rlike(rules.API_KEY_VALUE)),
        "session": low.contains("session"),
        "csrf_token": low.contains("csrf") | low.contains("xsrf"),
        "oauth_authorization_code": (low.contains("oauth") & low.contains("code"))
        | low.isin("code", "authorization_code"),
        "refresh_token": low.contains("refresh") & low.contains("token"),
        "email": value.contains("@") & value.rlike(rules.EMAIL_VALUE),
        "phone_number": value.rlike("\\d{4}") & value.rlike(rules.PHONE_VALUE),
        "sensitive_key_value": sensitive_name & (value != ""),
    })


def categories(name: Column, value: Column) -> Column:
    return CATEGORIES.array(category_mask(name, value))


def strip(text: Column) -> Column:
    """Trim every ASCII blank, not only spaces."""
    return F.trim(text, F.lit(" \t\n\r\x0b\x0c"))


def slug(text: Column, empty: str = "report") -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(cleaned == "", F.lit(empty)).otherwise(cleaned)


def line_list(text: Column) -> Column:
    """Lines of a text under every line terminator; no empty last line."""
    parts = F.split(text, rules.LINE_BREAKS)
    return let(parts, lambda p: F.when(F.try_element_at(p, F.lit(-1)) == "", F.slice(p, F.lit(1), F.size(p) - 1))
               .otherwise(p))


def lines(artifacts: DataFrame, *keep: str) -> DataFrame:
    """Line table: one row per line with its 1-based number."""
    keep = keep or ("source_file",)
    split = artifacts.select(*keep, F.posexplode(line_list(F.col("text"))).alias("pos", "line"))
    return split.select(*keep, (F.col("pos") + 1).alias("line_no"), "line")


def pattern_hits(text: Column, pattern: str, groups=(0,), may: Column | None = None) -> Column:
    """``array<struct<line:int, g0:string, ...>>``: all matches with their line numbers.

    Every match gets a marker in front of it.  The markers of each line, repeated
    as that line's number, come out in match order, so the whole thing is linear
    in the text and a match may span lines.  ``may`` is a cheap necessary test; the
    pattern itself serves if there is none.
    """
    fields = ["line"] + [f"g{g}" for g in groups]
    none = F.array().cast("array<int>")

    def marks(line, i):
        count = F.length(line) - F.length(F.replace(line, F.lit(SENTINEL), F.lit("")))
        return F.when(line.contains(SENTINEL), F.array_repeat(i + 1, count)).otherwise(none)

    clean = F.when(text.contains(SENTINEL), F.translate(text, SENTINEL, " ")).otherwise(text)
    marked = F.regexp_replace(clean, F.lit(pattern), F.lit(SENTINEL + "$0"))
    numbers = F.flatten(F.transform(F.split(marked, "\n"), marks))
    matches = [F.regexp_extract_all(clean, F.lit(pattern), F.lit(g)) for g in groups]
    zipped = F.transform(F.arrays_zip(numbers, *matches),
                         lambda z: F.struct(*[z.getField(str(i)).alias(n) for i, n in enumerate(fields)]))
    empty = F.array().cast("array<struct<line:int," + ",".join(f"{n}:string" for n in fields[1:]) + ">>")
    return F.when(text.rlike(pattern) if may is None else may, zipped).otherwise(empty)
