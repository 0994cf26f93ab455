"""Personal data: fixed patterns, and a semi-Markov conditional random field for what they miss.

The field scores whole candidate segments of up to ``LONGEST`` tokens by
features of the span (digits, checksums, shape, what stands before it) for
every type at once, and dynamic programming over (end, length, type) chooses
boundaries and types together.  Its weights are fitted here by stochastic
gradient on the conditional likelihood of ``training_windows()`` made-up
windows, a fixed number that depends on no data; executors get the weights by
closure.

A segment must hold a digit, an @ or the word dot, so only tokens within ``LONGEST`` of such
a token can be part of one: decoding these stretches alone gives the best
labelling of the whole text.  Spans of the patterns stay; segments that
overlap one are not candidates.

Edge cases: a null text counts as empty and has no spans; repeated rows are
searched one by one; an empty table gives an empty result; other columns are
ignored; work on a text is linear in its length, however long it is; a token of more
than ``LONGEST_TOKEN`` letters is no part of a segment.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import LOWER, UPPER, documents, slices

#: Fixed values of the contract: the base kinds, in order, and their patterns.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
TYPES = ("email", "ip", "card", "phone", "secret", "national_id", "iban")
LONGEST = 16
TOKEN = re.compile(r"[^\W_]+|_+|[^\w\s]")
TRIGGER = re.compile(r"[0-9@]|\bdot\b", re.I)
#: Longer tokens, and white space longer than that between two, are no part of a segment.
LONGEST_TOKEN, LONGEST_GAP = 512, 4
KEY = re.compile(r"(?:token|secret|passw(?:or)?d|pwd|api[_ -]?key|key|auth)\w{0,12}[\"']?\s*(?:=|:|is)\s*[\"']?$", re.I)

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        value = int(c) * (1 + k % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _valid(kind: str, text: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        parts = [p.lstrip("0") or "0" for p in text.split(".")]
        return all(len(p) <= 3 and int(p) <= 255 for p in parts)
    digits = re.sub("[^0-9]", "", text)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; failing ones are dropped and not tried again."""
    found: list[Span] = []
    has_digit = re.search("[0-9]", text) is not None
    for kind, pattern in BASE.items():
        if "@" in text if kind == "email" else has_digit and (kind != "phone" or "+" in text):
            found += [(kind, m.start(), m.end()) for m in _finds(kind, pattern, text) if _valid(kind, m.group())]
    return found


def _finds(kind: str, pattern: re.Pattern, text: str) -> Iterator[re.Match]:
    """``pattern.finditer`` in linear time.

    Mail is only tried where an @ follows the run of characters before it.
    Numbers joined by dots are found as whole chains, of which every four
    in turn are a match.
    """
    if kind == "ip":
        for chain in _CHAIN.finditer(text):
            ends = [m.span() for m in _NUMBER.finditer(text, chain.start(), chain.end())]
            for k in range(3, len(ends), 4):
                yield pattern.match(text, ends[k - 3][0], ends[k][1])
        return
    if kind != "email":
        yield from pattern.finditer(text)
        return
    end = 0
    for at in re.finditer("@", text):
        if at.start() < end:
            continue
        start = at.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at.start() and (m := pattern.match(text, start)):
            yield m
            end = m.end()


_NUMBER = re.compile("[0-9]+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_LOCAL = frozenset("._%+-0123456789" + UPPER + LOWER)

FEATURES = (
    "one", "email_shape", "email_words", "four_parts", "parts_small", "colon_hex", "luhn", "card_digits", "phone_digits", "few_digits", "many_digits",
    "plus", "paren", "split_334", "split_324", "iban_shape", "iban_sum", "long_hex", "mixed_run", "key_before", "joined_before", "joined_after",
    "loose_edge", "letters_word", "quote_inside", "long_gap", "one_token", "grouped_4", "dots_digits",
)
_EMAIL = re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+\Z")
_AT_WORD = re.compile(r"\s*[\[(]?\s*(?:@|\bat\b)\s*[\])]?\s*", re.I)
_DOT_WORD = re.compile(r"\s*[\[(]?\s*(?:\.|\bdot\b)\s*[\])]?\s*", re.I)
_MAIL_NAME, _HOST_NAME = re.compile(r"[\w.%+-]+\Z"), re.compile(r"[\w-]+\Z")
_FOUR = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}\Z")
_COLON_HEX = re.compile(r"[0-9a-f]{1,4}(?::[0-9a-f]{0,4}){4,7}\Z", re.I)
_334 = re.compile(r"\(?\d{3}\)?[ .-]?\d{3}[ .-]\d{4}\Z")
_324 = re.compile(r"\d{3}-\d{2}-\d{4}\Z")
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\Z")
_HEX = re.compile(r"[0-9a-f]{32,}\Z", re.I)
_RUN = re.compile(r"[A-Za-z0-9_\-]{16,}\Z")
_GROUP4 = re.compile(r"\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}\Z")


def _in_words(span: str) -> bool:
    """A mail address whose marks may be words: name at host dot com."""
    halves = _AT_WORD.split(span)
    if len(halves) != 2 or not _MAIL_NAME.match(halves[0]):
        return False
    parts = _DOT_WORD.split(halves[1])
    return len(parts) > 1 and all(map(_HOST_NAME.match, parts))


def span_features(text: str, start: int, end: int, tokens: int) -> np.ndarray:
    """0 or 1 for each of ``FEATURES``, of text[start:end] and what stands around it."""
    span = text[start:end]
    digits = sum("0" <= c <= "9" for c in span)
    letters = sum(c.isalpha() for c in span)
    edge = _IBAN.match(span) is not None
    plain = re.sub("[ -]", "", span)
    checks = {
        "one": True,
        "email_shape": _EMAIL.match(span),
        "email_words": _in_words(span),
        "four_parts": _FOUR.match(span),
        "parts_small": _FOUR.match(span) and _valid("ip", span),
        "colon_hex": _COLON_HEX.match(span),
        "luhn": 13 <= digits <= 19 and not letters and luhn(re.sub("[^0-9]", "", span)),
        "card_digits": 13 <= digits <= 19 and not letters,
        "phone_digits": 9 <= digits <= 12 and not letters,
        "few_digits": digits < 7,
        "many_digits": digits > 19 and not letters,
        "plus": span[0] == "+",
        "paren": "(" in span and ")" in span,
        "split_334": _334.match(span),
        "split_324": _324.match(span),
        "iban_shape": edge,
        "iban_sum": edge and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1,
        "long_hex": _HEX.match(span),
        "mixed_run": digits > 3 and letters > 3 and _RUN.match(span),
        "key_before": KEY.search(text[max(0, start - 40) : start]),
        "joined_before": start > 0 and text[start - 1].isalnum(),
        "joined_after": end < len(text) and text[end].isalnum(),
        "loose_edge": not (span[0].isalnum() or span[0] in "+(") or not span[-1].isalnum(),
        "letters_word": any(w.isalpha() for w in span.split()),
        "quote_inside": any(c in "\"'=|" for c in span),
        "long_gap": re.search(r"\s\s|\n", span) is not None,
        "one_token": tokens == 1,
        "grouped_4": _GROUP4.match(span),
        "dots_digits": not letters and digits < 9 and "." in span,
    }
    return np.fromiter((bool(checks[f]) for f in FEATURES), np.float64, len(FEATURES))


def lattice(text: str, tokens: list[tuple[int, int]], free: list[bool]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Feature rows of all candidates and their (first token, tokens): a trigger inside, and every token free."""
    trigger = [TRIGGER.search(text, a, b) is not None for a, b in tokens]
    rows, where = [], []
    for i in range(len(tokens)):
        holds = False
        for n in range(1, min(LONGEST, len(tokens) - i) + 1):
            if not free[i + n - 1] or n > 1 and tokens[i + n - 1][0] - tokens[i + n - 2][1] > LONGEST_GAP:
                break
            holds |= trigger[i + n - 1]
            if holds:
                rows.append(span_features(text, tokens[i][0], tokens[i + n - 1][1], n))
                where.append((i, n))
    return (np.array(rows) if rows else np.zeros((0, len(FEATURES)))), where


def best(scores: np.ndarray, where: list[tuple[int, int]], n: int) -> list[tuple[int, int, int]]:
    """The best labelling as (first token, tokens, type); a token outside segments scores 0."""
    ends: list[list[tuple[int, int, int]]] = [[] for _ in range(n + 1)]
    kinds = scores.argmax(axis=1) if len(where) else []
    for k, (i, size) in enumerate(where):
        ends[i + size].append((k, i, int(kinds[k])))
    value, back = [0.0] * (n + 1), [None] * (n + 1)
    for end in range(1, n + 1):
        value[end] = value[end - 1]
        for k, i, kind in ends[end]:
            if value[i] + scores[k, kind] > value[end]:
                value[end], back[end] = value[i] + scores[k, kind], (i, end - i, kind)
    out, at = [], n
    while at:
        if back[at] is None:
            at -= 1
        else:
            out.append(back[at])
            at = back[at][0]
    return out[::-1]


def marginals(scores: np.ndarray, where: list[tuple[int, int]], n: int) -> np.ndarray:
    """The probability of each candidate and type, by forward and backward sums over segmentations."""
    total = np.logaddexp.reduce(scores, axis=1)
    forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    forward[0] = backward[n] = 0.0
    by_end: list[list[int]] = [[] for _ in range(n + 1)]
    by_start: list[list[int]] = [[] for _ in range(n + 1)]
    for k, (i, size) in enumerate(where):
        by_end[i + size].append(k)
        by_start[i].append(k)
    for end in range(1, n + 1):
        forward[end] = np.logaddexp.reduce([forward[end - 1], *(forward[where[k][0]] + total[k] for k in by_end[end])])
    for start in range(n - 1, -1, -1):
        backward[start] = np.logaddexp.reduce([backward[start + 1], *(backward[start + where[k][1]] + total[k] for k in by_start[start])])
    outer = np.array([forward[i] + backward[i + size] for i, size in where]) - forward[n]
    return np.exp(outer[:, None] + scores)


def training_windows(count: int = 210, seed: int = 5) -> list[tuple[str, list[Span]]]:
    """Made-up windows: one entity or one look-alike between words."""
    rng = random.Random(seed)
    letters, hexes = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"

    def word(low: int = 2, high: int = 9) -> str:
        return "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))

    def digits(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def card(good: bool) -> str:
        head = "4" + digits(14)
        return next(head + c for c in "0123456789" if luhn(head + c) == good)

    def iban() -> str:
        body, land = digits(18), rng.choice(["DE", "FR", "ES", "IT"])
        check = 98 - int(body + "".join(str(int(c, 36)) for c in land) + "00") % 97
        return f"{land}{check:02d}{body}"

    def grouped(s: str) -> str:
        return " ".join(s[k : k + 4] for k in range(0, len(s), 4))

    makers = {
        "email": lambda: f"{word()}{rng.choice(['.', '_', ''])}{digits(2)}@{word()}.{rng.choice(['example.com', 'org', 'net'])}",
        "email ": lambda: f"{word()} [at] {word()}{digits(rng.randint(0, 1))} [dot] com" if rng.random() < 0.5 else f"{word()} @ {word()} . com",
        "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "ip ": lambda: ":".join("".join(rng.choice(hexes) for _ in range(4)) for _ in range(8)),
        "card": lambda: card(True) if rng.random() < 0.5 else grouped(card(True)),
        "phone": lambda: f"+{rng.randint(1, 49)} ({digits(3)}) {digits(3)}-{digits(4)}",
        "phone ": lambda: f"({digits(3)}) {digits(3)}-{digits(4)}" if rng.random() < 0.5 else f"{digits(3)}-{digits(3)}-{digits(4)}",
        "secret": lambda: "".join(rng.choice(hexes) for _ in range(rng.choice([32, 40, 64]))),
        "secret ": lambda: "".join(rng.choice(letters + letters.upper() + "0123456789") for _ in range(rng.randint(20, 40))) + digits(4),
        "national_id": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        "iban": lambda: iban() if rng.random() < 0.5 else grouped(iban()),
    }
    plain = (
        lambda: card(False), lambda: digits(rng.randint(1, 7)), lambda: f"{digits(1)}.{digits(1)}", lambda: f"version {digits(1)}.{digits(1)}.{digits(1)}",
        lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"{digits(3)},{digits(3)}", lambda: f"@{word()}",
        lambda: f"{rng.randint(256, 999)}.{digits(3)}.{digits(2)}.{digits(2)}", lambda: f"{word()}{digits(2)}", lambda: digits(rng.randint(20, 30)),
        lambda: f"{word()} @ {word()}", lambda: f"{digits(4)} {digits(4)}", lambda: f"{digits(3)}x{digits(3)}", lambda: f"{digits(12)}",
        lambda: f"{word()} dot {word()}", lambda: f"{word()} at {word()} {digits(1)}",
    )
    kinds, out = list(makers), []
    for k in range(count):
        before = " ".join(word() for _ in range(rng.randint(0, 4)))
        after = " ".join(word() for _ in range(rng.randint(0, 4)))
        if k % 2:
            kind = kinds[k // 2 % len(kinds)]
            body = makers[kind]()
            lead = f'{rng.choice(["token", "secret", "api_key", "password"])}{rng.choice([" = ", "=", ": "])}{chr(34)}' if kind.startswith("secret") else ""
            tail = chr(34) if lead else rng.choice(["", "", ".", ","])
            text = f"{before} {lead}{body}{tail} {after}"
            start = len(before) + 1 + len(lead)
            out.append((text, [(kind.strip(), start, start + len(body))]))
        else:
            out.append((f"{before} {plain[k // 2 % len(plain)]()}{rng.choice(['', '', '.', ','])} {after}", []))
    return out


@lru_cache(maxsize=1)
def fitted(epochs: int = 8, rate: float = 0.5, penalty: float = 1e-4) -> np.ndarray:
    """Weights (feature, type), by AdaGrad over the windows in a fixed order."""
    weights, power = np.zeros((len(FEATURES), len(TYPES))), np.full((len(FEATURES), len(TYPES)), 1e-6)
    weights[0] = -2.0
    cases = []
    for text, spans in training_windows():
        tokens = [m.span() for m in TOKEN.finditer(text)]
        rows, where = lattice(text, tokens, [True] * len(tokens))
        gold = np.zeros((len(where), len(TYPES)))
        for k, (i, n) in enumerate(where):
            for kind, a, b in spans:
                if (tokens[i][0], tokens[i + n - 1][1]) == (a, b):
                    gold[k, TYPES.index(kind)] = 1
        if where:
            cases.append((rows, where, len(tokens), gold))
    for _ in range(epochs):
        for rows, where, n, gold in cases:
            step = rows.T @ (gold - marginals(rows @ weights, where, n)) - penalty * weights
            power += step**2
            weights += rate * step / np.sqrt(power)
    return weights


def added_spans(text: str, base: list[Span], weights: np.ndarray) -> list[Span]:
    """What the field finds outside the spans of the patterns."""
    if not TRIGGER.search(text):
        return []
    tokens = [m.span() for m in TOKEN.finditer(text)]
    taken = sorted((a, b) for _, a, b in base)
    free, at = [], 0
    high = 0
    for a, b in tokens:
        while at < len(taken) and taken[at][0] < b:
            high = max(high, taken[at][1])
            at += 1
        free.append(a >= high and b - a <= LONGEST_TOKEN)
    near = [k for k, (a, b) in enumerate(tokens) if free[k] and TRIGGER.search(text, a, b)]
    out: list[Span] = []
    stretch = 0
    while stretch < len(near):
        last = stretch
        while last + 1 < len(near) and near[last + 1] - near[last] <= 2 * LONGEST:
            last += 1
        low, top = max(0, near[stretch] - LONGEST), min(len(tokens), near[last] + LONGEST + 1)
        rows, where = lattice(text, tokens[low:top], free[low:top])
        if where:
            out += [(TYPES[kind], tokens[low + i][0], tokens[low + i + n - 1][1]) for i, n, kind in best(rows @ weights, where, top - low)]
        stretch = last + 1
    return out


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (TYPES.index(s[0]), s[1], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base and added: arrays of (kind, start, end), in code points, ends exclusive."""
    weights = fitted()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns: tuple[list, list] = ([], [])
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                for column, spans in zip(columns, (base, ordered(added_spans(text or "", base, weights)))):
                    column.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, span) for c in columns)], names=["id", "base", "added"])

    kind = docs.schema[id_col].dataType.simpleString()
    spans = "array<struct<kind:string,start:int,end:int>>"
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(found, f"id {kind}, base {spans}, added {spans}").withColumnRenamed("id", id_col)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    def text(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    every = F.array_sort(
        F.concat("base", "added"),
        lambda x, y: F.when(_rank(x) < _rank(y), -1).when(_rank(x) > _rank(y), 1).when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).otherwise(x["end"] - y["end"]),
    )
    counts = [F.size(F.array_compact(F.transform("base", _if_kind(k)))).cast("long").alias(f"n_{k}") for k in BASE]
    return find(documents(spark, sf_dir)).select("doc_id", *counts, F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(every).alias("spans"))


def _rank(span):
    return F.array_position(F.array(*map(F.lit, TYPES)), span["kind"])


def _if_kind(kind: str):
    return lambda span: F.when(span["kind"] == kind, True)
