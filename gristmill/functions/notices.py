"""Short notices as expressions of built-in functions: normal form, ordered mentions, event codes, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.text import ACCENTED, PLAIN

#: Fixed value: the form of an event code, as the public standard of event codes has it.
EVENT_CODE = r"/([OTEX])\.([A-Z]{3})\.([A-Z0-9]{4})\.([A-Z0-9]{2})\.([A-Z])\.(\d{4})\.(\d{6}T\d{4}Z)-(\d{6}T\d{4}Z)/"
#: Look-alikes and the letter that each stands for.
ALIKE, LETTER = "0134578@$!", "oieastbasi"


def normal(text: Column) -> Column:
    """One line in lower case: dashes and quotes in one form, hyphens without blanks, single blanks."""
    one = F.translate(F.lower(text), "‘’`“”–—−", "'''\"\"---")
    return F.trim(F.regexp_replace(F.regexp_replace(one, r"\s+", " "), r" ?- ?", "-"))


def mentions(text: Column, rules: dict[str, str]) -> Column:
    """(at, kind, said): what the rules find, in order of place; of overlapping ones the first, and at one place the longest.

    A rule's pattern holds no groups.  Matches are found from left to right
    by one pattern of all rules, longest alternatives first, and named after.
    """
    joined = "|".join(p for p in sorted(rules.values(), key=len, reverse=True))
    said = F.regexp_extract_all(text, F.lit(f"({joined})"), F.lit(1))

    def named(word: Column) -> Column:
        kind = F.coalesce(*[F.when(word.rlike(f"^(?:{p})$"), name) for name, p in rules.items()])
        return F.struct(kind.alias("kind"), word.alias("said"))

    return F.transform(said, named)


def revoked(kinds: Column, taken_back: str) -> Column:
    """The kinds that stay: a kind just before ``taken_back`` goes with it."""
    last = F.size(kinds) - 1

    def stays(kind: Column, at: Column) -> Column:
        after = F.when(at < last, F.get(kinds, at + 1))
        return (kind != taken_back) & ~F.coalesce(after == taken_back, F.lit(False))

    return F.filter(kinds, stays)


def event_code(text: Column) -> Column:
    """The parts of the first event code in a text; null without one.  An open time is written as zeros and comes out null."""
    part = [F.regexp_extract(text, EVENT_CODE, k) for k in range(1, 9)]

    def instant(t: Column) -> Column:
        return F.try_to_timestamp(F.when(t != "000000T0000Z", F.concat(F.lit("20"), F.substring(t, 1, 11))), F.lit("yyyyMMdd'T'HHmm"))

    names = ("status", "action", "office", "phenomena", "significance")
    whole = F.struct(*[p.alias(n) for p, n in zip(part, names)], part[5].cast("int").alias("number"), instant(part[6]).alias("begin"), instant(part[7]).alias("end"))
    return F.when(F.regexp_like(text, F.lit(EVENT_CODE)), whole)


def event_codes(text: Column) -> Column:
    """The parts of every event code in a text, in order; null of a null.  An open time is written as zeros and comes out null."""
    return F.transform(F.regexp_extract_all(text, F.lit(EVENT_CODE), F.lit(0)), event_code)


def county_key(name: Column) -> Column:
    """A county's name without accents, case, marks and its kind."""
    plain = F.regexp_replace(F.translate(F.lower(name), ACCENTED, PLAIN), r"[^a-z ]", "")
    return F.regexp_replace(F.trim(F.regexp_replace(plain, r"\b(county|parish|borough)\b", "")), r" +", " ")


def skeleton(name: Column) -> Column:
    """What a name looks like: look-alikes as letters, marks out, repeated letters once."""
    return F.regexp_replace(F.regexp_replace(F.translate(F.lower(name), ALIKE, LETTER), "[^a-z]", ""), r"(.)\1+", "$1")


def display_name(name: Column) -> Column:
    """Title case, with small words in lower case but for the first, and initials in capitals."""
    words = F.split(F.lower(F.trim(name)), r"\s+")
    small = F.array(*map(F.lit, ("of", "the", "and", "at", "for", "in")))

    def cased(word: Column, at: Column) -> Column:
        return F.when((at > 0) & F.array_contains(small, word), word).when(F.regexp_like(word, F.lit(r"^([a-z]\.)+$")), F.upper(word)).otherwise(F.initcap(word))

    return F.array_join(F.transform(words, cased), " ")


def highlights(name: Column, words: list[str]) -> Column:
    """Half-open ranges of ``name`` (lower case) that the words cover where they begin one of its words, in order."""
    lowered = F.lower(name)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))), lambda k: (k == 1) | ~F.regexp_like(F.substring(lowered, k - 1, F.lit(1)), F.lit("[a-z0-9]")))

    def length(k: Column) -> Column:
        return F.greatest(F.lit(0), *[F.when(F.substring(lowered, k, F.lit(len(w))) == w, len(w)).otherwise(0) for w in words])

    found = F.transform(starts, lambda k: F.struct((k - 1).alias("start"), (k - 1 + length(k)).alias("end")))
    return F.filter(found, lambda r: r["end"] > r["start"])
