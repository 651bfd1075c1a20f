"""Format-preserving pseudonyms for personal data, in DataFrame functions.

A keyed Feistel network permutes each value within its own format: numbers on the product of two residue rings whose sizes multiply to
the number of valid values, so no value is ever out of range and the mapping is one to one.  Equal values get equal pseudonyms in every
document, in whatever way they are spaced.  Texts without a find are passed on as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: name, pattern; tried in this order at each place.  No group of open length is repeated: each repeat would take a stack frame.  So the
#: domain of an address is one run of letters, digits, hyphens and dots (two dots in a row included) that ends in a dot and letters.
KINDS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,}"),
    ("phone", r"\+1[ -]?\(?[2-9][0-9]{2}\)?[ -]?[2-9][0-9]{2}[ -]?[0-9]{4}(?![0-9])"),
    ("date", r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/]|[.-][0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"),
    ("ip", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"),
    ("card", r"(?<![0-9.])(?:(?:[0-9]{4} ){3}[0-9]{4}|(?:[0-9]{4}-){3}[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9])"),
)
PATTERN = "|".join(p for _, p in KINDS)
NAMES = tuple(n for n, _ in KINDS)
#: 400 years have 146097 days, wherever they begin; 146097 = 189 · 773.
FIRST_DAY, LAST_DAY, DAYS = "1800-01-01", "2199-12-31", (189, 773)


def _f(key: str, kind: str, i: Column, x: Column) -> Column:
    """60 bits of a keyed hash."""
    hashed = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), x.cast("string")).cast("binary"), 256)
    return F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, sizes: tuple[Column | int, Column | int], key: str, kind: str, inverse: bool = False) -> Column:
    """Permutes (a, b) of Z/sizes[0] × Z/sizes[1]; a struct of both."""
    sa, sb = (s if isinstance(s, Column) else F.lit(s).cast("long") for s in sizes)
    turn = -1 if inverse else 1
    order = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def step(s: Column, i: Column) -> Column:
        left = F.struct(F.pmod(s["a"] + turn * F.pmod(_f(key, kind, i, s["b"]), sa), sa).alias("a"), s["b"].alias("b"))
        right = F.struct(s["a"].alias("a"), F.pmod(s["b"] + turn * F.pmod(_f(key, kind, i, s["a"]), sb), sb).alias("b"))
        return F.when(i % 2 == 0, left).otherwise(right)

    return F.aggregate(order, F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def permute_digits(digits: Column, key: str, kind: str, inverse: bool = False) -> Column:
    """A string of 2 to 36 digits to another of its length."""
    half = F.floor(F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    out = feistel(F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, rest), (_power(half), _power(rest)), key,
                  kind, inverse)
    return _pair(out, lambda p: F.concat(F.lpad(p["a"].cast("string"), half, "0"), F.lpad(p["b"].cast("string"), rest, "0")))


def _pair(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def luhn_sum(digits: Column) -> Column:
    def one(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), one), F.lit(0), lambda s, d: s + d)


def _refill(shape: Column, digits: Column) -> Column:
    """The shape with its digits replaced one by one."""
    parts, own = F.split(shape, "[0-9]", -1), F.concat(F.split(digits, ""), F.array(F.lit("")))
    return F.array_join(F.zip_with(parts, own, lambda p, d: F.concat(p, d)), "")


def _card(v: Column, key: str, inverse: bool) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    middle = permute_digits(F.substring(digits, F.lit(2), F.length(digits) - 2), key, "card", inverse)

    def made(m: Column) -> Column:
        body = F.concat(F.substring(digits, 1, 1), m)
        check = F.pmod(10 - luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
        return _refill(v, F.concat(body, check))

    return F.when(F.pmod(luhn_sum(digits), F.lit(10)) == 0, _pair(middle, made))


def _phone(v: Column, key: str, inverse: bool) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    area, exchange, line = (F.substring(digits, *p).cast("long") for p in ((2, 3), (5, 3), (8, 4)))
    number = ((area - 200) * 800 + exchange - 200) * 10000 + line
    size = 80_000  # 800 · 800 · 10000 = 80000²
    out = feistel(F.floor(number / size), number % size, (size, size), key, "phone", inverse)

    def made(p: Column) -> Column:
        n = p["a"] * size + p["b"]
        parts = [F.floor(n / 8_000_000) + 200, F.floor(n / 10_000) % 800 + 200]
        return _refill(v, F.concat(F.substring(digits, 1, 1), *[x.cast("long").cast("string") for x in parts],
                                   F.lpad((n % 10_000).cast("string"), 4, "0")))

    return _pair(out, made)


def _ip(v: Column, key: str, inverse: bool) -> Column:
    parts = F.transform(F.split(v, r"\."), lambda x: x.cast("long"))
    valid = ~F.exists(parts, lambda x: x > 255) & ~v.rlike(r"(^|\.)0[0-9]")
    get = lambda i: F.get(parts, F.lit(i))
    out = feistel(get(0) * 256 + get(1), get(2) * 256 + get(3), (65536, 65536), key, "ip", inverse)
    made = lambda p: F.concat_ws(".", *[x.cast("long").cast("string") for x in (
        F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256)])
    return F.when(valid, _pair(out, made))


def _date(v: Column, key: str, inverse: bool) -> Column:
    """Year first, or month/day/year."""
    iso = F.when(v.rlike("^[0-9]{4}-"), v).otherwise(F.concat_ws("-", F.substring(v, 7, 4), F.substring(v, 1, 2), F.substring(v, 4, 2)))
    day = F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date")
    first = F.lit(FIRST_DAY).cast("date")
    number = F.datediff(day, first).cast("long")
    out = feistel(F.floor(number / DAYS[1]), number % DAYS[1], DAYS, key, "date", inverse)

    def made(p: Column) -> Column:
        new = F.date_add(first, (p["a"] * DAYS[1] + p["b"]).cast("int"))
        return F.when(v.rlike("^[0-9]{4}-"), F.date_format(new, "yyyy-MM-dd")).otherwise(F.date_format(new, "MM/dd/yyyy"))

    return F.when(day.between(first, F.lit(LAST_DAY).cast("date")), _pair(out, made))


def _ssn(v: Column, key: str, inverse: bool) -> Column:
    """Areas 001-899 but 666, groups 01-99, serials 0001-9999: 898 · 99 and 9999 values."""
    area, group, serial = (F.substring(v, *p).cast("long") for p in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    out = feistel(place * 99 + group - 1, serial - 1, (898 * 99, 9999), key, "ssn", inverse)

    def made(p: Column) -> Column:
        place = F.floor(p["a"] / 99)
        parts = ((F.when(place >= 665, place + 2).otherwise(place + 1), 3), (p["a"] % 99 + 1, 2), (p["b"] + 1, 4))
        return F.concat_ws("-", *[F.lpad(x.cast("long").cast("string"), n, "0") for x, n in parts])

    return F.when(valid, _pair(out, made))


def _email(v: Column, key: str, inverse: bool) -> Column:
    """The name as a number to base 36, eight letters and digits at a time; case, signs and the domain stay.  Letters may become digits."""
    name, domain = F.substring_index(v, "@", 1), F.substring_index(v, "@", -1)
    plain = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    blocks = F.regexp_extract_all(plain, F.lit("[a-z0-9]{1,8}"), F.lit(0))

    def block(x: Column, i: Column) -> Column:
        n = F.length(x)
        half, rest = F.floor(n / 2).cast("int"), n - F.floor(n / 2).cast("int")
        size = lambda k: F.pow(F.lit(36.0), k).cast("long")
        read = lambda s: F.coalesce(F.conv(s, 36, 10).cast("long"), F.lit(0).cast("long"))
        out = feistel(read(F.substring(x, F.lit(1), half)), read(F.substring(x, half + 1, rest)), (size(half), size(rest)), key,
                      "email", inverse)
        write = lambda p, k: F.substring(F.lower(F.lpad(F.conv(p.cast("string"), 10, 36), 8, "0")), 9 - k, k)
        return _pair(out, lambda p: F.concat(write(p["a"], half), write(p["b"], rest)))

    parts, own = F.split(name, "[A-Za-z0-9]", -1), F.concat(F.split(F.array_join(F.transform(blocks, block), ""), ""), F.array(F.lit("")))
    filled = F.array_join(F.zip_with(parts, own, lambda p, d: F.concat(p, d)), "")
    return F.when(F.length(plain) > 0, F.concat(filled, F.lit("@"), domain))


_MAKE = {"email": _email, "phone": _phone, "date": _date, "ssn": _ssn, "ip": _ip, "card": _card}


def _kind(v: Column) -> Column:
    return reduce(lambda c, k: c.when(v.rlike(f"^(?:{k[1]})$"), F.lit(k[0])), KINDS[1:], F.when(v.rlike(f"^(?:{KINDS[0][1]})$"), F.lit("email")))


def pseudonym(v: Column, key: str, inverse: bool = False) -> Column:
    """A found value to a struct (kind, new); new is null for values that fail validation, which stay as they are."""
    kind = _kind(v)

    def made(k: Column) -> Column:
        new = reduce(lambda c, n: c.when(k == n, _MAKE[n](v, key, inverse)), NAMES[1:], F.when(k == NAMES[0], _MAKE[NAMES[0]](v, key, inverse)))
        return F.struct(k.alias("kind"), new.alias("new"))

    return _pair(kind, made)


def pseudonymise(docs: DataFrame, key: str, *, text: str = "text", inverse: bool = False) -> DataFrame:
    """Every row with its columns, the text with pseudonyms, and n_<kind> (long) for each kind replaced.

    Kinds: e-mail names, +1 phone numbers, dates of 1800 to 2199 (yyyy-MM-dd, MM/dd/yyyy), social security numbers, IPv4 addresses, card numbers
    that pass the Luhn check (first digit kept, check digit made anew).  Anything that fails its validation stays.  ``inverse`` takes
    pseudonyms back with the same key (e-mail names come back in lower case).  Null texts stay null with counts 0.
    Repeated rows get the same text, an empty table gives an empty one, and texts of any length are handled in one pass of each pattern.
    The key stands in the plan: keep event logs as closed as the key.  Columns already named n_<kind> are replaced.
    """
    docs = docs.drop(*[f"n_{k}" for k in NAMES])
    body = F.coalesce(F.col(text), F.lit(""))
    found = docs.withColumn("__found", F.regexp_extract_all(body, F.lit(PATTERN), F.lit(0)))
    made = found.withColumn("__new", F.transform("__found", lambda v: pseudonym(v, key, inverse))).withColumn(
        "__parts", F.when(F.size("__found") > 0, F.split(F.col(text), PATTERN, -1)))
    new = F.concat(F.zip_with("__found", "__new", lambda v, n: F.coalesce(n["new"], v)), F.array(F.lit("")))
    filled = F.when(F.size("__found") > 0, F.array_join(F.zip_with("__parts", new, lambda p, n: F.concat(p, n)), "")).otherwise(F.col(text))
    count = lambda k: F.size(F.filter("__new", lambda n: (n["kind"] == k) & n["new"].isNotNull())).cast("long")
    return made.withColumns({text: filled, **{f"n_{k}": count(k) for k in NAMES}}).drop("__found", "__new", "__parts")
