"""Text scalars as expressions of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and what each is folded to.
ACCENTED, PLAIN = "àáâãäåèéêëìíîïòóôõöùúûüçñýÿ", "aaaaaaeeeeiiiiooooouuuucnyy"
HMAC_BLOCK = 64


def folded(text: Column) -> Column:
    """Lower case without accents; sharp s as two letters."""
    return F.replace(F.translate(F.lower(text), ACCENTED, PLAIN), F.lit("ß"), F.lit("ss"))


def comparison_key(text: Column) -> Column:
    """One spelling for a name: folded, marks out, white space as one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(folded(text), r"[^a-z0-9\s]", ""), r"\s+", " "))


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits, in order."""
    return F.filter(F.split(folded(text), r"[^a-z0-9]+"), lambda t: t != "")


def hmac_sha256(text: Column, key: bytes) -> Column:
    """Keyed SHA-256 in hexadecimal: the nested digests of the standard, for a key of at most one block."""
    padded = key.ljust(HMAC_BLOCK, b"\0")
    inner, outer = (bytearray(b ^ x for b in padded) for x in (0x36, 0x5C))
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(text, "UTF-8")), 256))), 256)


def quantised_weight(weight: Column) -> Column:
    """min(4095, round(128 log2(1 + w)))."""
    return F.least(F.lit(4095), F.round(F.log2(1 + weight) * 128)).cast("int")


def zigzag(value: Column) -> Column:
    """Signed to unsigned: 0, -1, 1, -2 become 0, 1, 2, 3."""
    return F.shiftleft(value, 1).bitwiseXOR(F.shiftright(value, 63))


def unzigzag(value: Column) -> Column:
    return F.shiftrightunsigned(value, 1).bitwiseXOR(-value.bitwiseAND(F.lit(1)))


def duration_minutes(text: Column) -> Column:
    """Minutes of "2 hours", "1 1/2 hrs", "90 min"; null outside 10 minutes to 5 hours."""
    hours = F.regexp_extract(text, r"(\d+)(?:\s+(1/2))?\s*(?:hours?|hrs?)", 1)
    half = F.regexp_extract(text, r"(\d+)\s+(1/2)\s*(?:hours?|hrs?)", 2)
    minutes = F.regexp_extract(text, r"(\d+)\s*min", 1)
    value = F.when(hours != "", F.try_to_number(hours, F.lit("9999")).cast("int") * 60 + F.when(half != "", 30).otherwise(0)).when(minutes != "", F.try_to_number(minutes, F.lit("9999")).cast("int"))
    return F.when(value.between(10, 300), value)


def clock_minutes(text: Column) -> Column:
    """Minutes of the day of "10:30 am", "7 pm", "noon", "midnight"; null where no clock time is named."""
    hour = F.try_to_number(F.regexp_extract(text, r"\b(\d{1,2})(?::(\d{2}))?\s*([ap])\.?m", 1), F.lit("99")).cast("int")
    minute = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, r"\b(\d{1,2}):(\d{2})\s*([ap])\.?m", 2), F.lit("")), F.lit("99")).cast("int"), F.lit(0))
    after = F.regexp_extract(text, r"\b(\d{1,2})(?::(\d{2}))?\s*([ap])\.?m", 3) == "p"
    clock = F.when(hour.between(1, 12) & (minute < 60), F.pmod(hour, F.lit(12)) * 60 + minute + F.when(after, 720).otherwise(0))
    return F.when(text.rlike(r"\bnoon\b"), 720).when(text.rlike(r"\bmidnight\b"), 0).otherwise(clock)


def expanded_zones(code: Column) -> Column:
    """Array of zone codes of a list such as CTZ005>008-010-NJZ002-281015-: ranges spelled out, letters carried on, the closing time left out."""
    parts = F.filter(F.split(code, "-"), lambda p: (p != "") & ~p.rlike(r"^\d{6}$"))

    def step(state: Column, part: Column) -> Column:
        letters = F.when(part.rlike("^[A-Z]"), F.substring(part, 1, 3)).otherwise(state["letters"])
        numbers = F.split(F.regexp_replace(part, "^[A-Z]{3}", ""), ">")
        low, high = F.get(numbers, F.lit(0)).cast("int"), F.coalesce(F.get(numbers, F.lit(1)), F.get(numbers, F.lit(0))).cast("int")
        codes = F.transform(F.sequence(low, high), lambda n: F.concat(letters, F.lpad(n.cast("string"), 3, "0")))
        return F.struct(letters.alias("letters"), F.concat(state["codes"], codes).alias("codes"))

    start = F.struct(F.lit("").alias("letters"), F.array().cast("array<string>").alias("codes"))
    return F.aggregate(parts, start, step, lambda s: s["codes"])


def name_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two names' words, where words one letter apart match."""
    left, right = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    shared = F.size(F.filter(left, lambda x: F.exists(right, lambda y: F.levenshtein(x, y, 1) >= 0)))
    union = F.size(left) + F.size(right) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))
