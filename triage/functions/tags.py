"""Closed tag vocabularies carried as bit masks.

A tag set drawn from a closed list fits in one bigint, so the union over a group
is ``bit_or``: a fixed-width buffer that Spark hash-aggregates and combines
before the shuffle, however many rows one group has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class TagSet:
    def __init__(self, names):
        self.names = sorted(set(names))
        self._bit = {name: 1 << i for i, name in enumerate(self.names)}

    def mask(self, conditions: dict[str, Column]) -> Column:
        """Mask of the names whose condition holds (NULL counts as false)."""
        bits = [F.when(cond, F.lit(self._bit[name]).cast("long")).otherwise(F.lit(0).cast("long"))
                for name, cond in conditions.items()]
        return reduce(lambda a, b: a.bitwiseOR(b), bits)

    def mask_of_array(self, values: Column) -> Column:
        """Mask of the known names inside an array column."""
        return self.mask({name: F.array_contains(values, name) for name in self.names})

    def has(self, mask: Column, *names: str) -> Column:
        """Whether any of the names is in the mask."""
        bits = reduce(lambda a, b: a | b, (self._bit[n] for n in names), 0)
        return mask.bitwiseAND(F.lit(bits).cast("long")) != 0

    def array(self, mask: Column) -> Column:
        """Sorted array of the names in the mask."""
        return F.array_compact(F.array(*[F.when(self.has(mask, n), F.lit(n)) for n in self.names]))

    def joined(self, mask: Column) -> Column:
        """The sorted names as one comma-separated string."""
        return F.concat_ws(",", *[F.when(self.has(mask, n), F.lit(n)) for n in self.names])


def contains_any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def word_rules(text: Column, rules: dict[str, list[str]]) -> dict[str, Column]:
    """One condition per tag: any of its words occurs in the text."""
    return {tag: contains_any(text, words) for tag, words in rules.items()}


def present(*pairs) -> Column:
    """Array of the values whose condition holds, in the order given."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(value)) for cond, value in pairs]))


def let(value: Column, body) -> Column:
    """Bind a value once and use it several times inside one expression."""
    return F.transform(F.array(value), body)[0]


def is_in(value: Column, words) -> Column:
    return value.isin(list(words))


def key_id(prefix: str, *parts) -> Column:
    """Prefix plus twelve hex digits of the SHA-256 of the parts joined by '|'."""
    cols = [F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.concat_ws("|", *cols), 256), 1, 12))
