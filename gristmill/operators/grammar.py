"""Statuses that texts announce, read by one automaton of all terms and clauses over its spans.

Terms are phrases of words, each of a kind.  One automaton, sent to the
workers once, finds every occurrence of every term, overlapping ones too; what
a span means then follows from the clause that it stands in:

- Full stops, semicolons, colons, marks and line ends end a clause; a comma
  ends what a negation reaches.
- Of status spans of which one holds the other, the longer one is read.
- A negation takes a status back if it is one of the ``REACH`` words before
  it, or only fillers lie between; so it takes back the whole of a list that
  joins statuses by joiners.  A revocation takes back the last status before
  it in its clause.
- A status is of the last subject before it in its clause, else of the first
  one after it, else of the last subject of an earlier clause, else of none.
- It is partial if its clause holds a part.
- ``unread`` counts the words of its clause that belong to no term: where it
  is high, the reading is a guess.

A text is read in one pass over its words, whatever its length; a null one has
no mentions.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUS, SUBJECT, PART, NEGATION, FILLER, JOINER, REVOCATION = "status", "subject", "part", "negation", "filler", "joiner", "revocation"
REACH = 2
TOKEN = r"([\p{L}\p{N}']+|[.,;:!?\n])"
ENDS = frozenset(".;:!?\n")
SCHEMA = "array<struct<start: int, end: int, status: string, subject: string, partial: boolean, taken_back: boolean, unread: int>>"


@dataclass(frozen=True)
class Term:
    phrase: str
    kind: str
    value: str


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    term: Term


#: What is announced of schools in English notices; other languages and uses bring their own terms.
SCHOOL_TERMS = tuple(
    Term(phrase, kind, value)
    for kind, value, phrases in (
        (STATUS, "closed", "closed|will close|closing|no school|no classes|cancelled|canceled"),
        (STATUS, "delayed", "delayed|delay|hour delay|two hour delay|opening late|late start"),
        (STATUS, "dismissed", "early dismissal|dismissing early|early release"),
        (STATUS, "remote", "remote learning|virtual day|remote day"),
        (STATUS, "open", "open|normal schedule|on time"),
        (SUBJECT, "schools", "school|schools|classes|students|district"),
        (SUBJECT, "staff", "staff|teachers|offices|office"),
        (SUBJECT, "activities", "activities|games|practices|evening events"),
        (SUBJECT, "buses", "bus|buses|transportation"),
        (PART, "part", "except|only|elementary|high school|campus|kindergarten|some"),
        (NEGATION, "not", "no|not|never|without|isn't|aren't|won't"),
        (FILLER, "filler", "a|an|any|be|one|two|three|hour|hours"),
        (JOINER, "joiner", "or|nor|and"),
        (REVOCATION, "revoked", "no longer in effect|lifted|rescinded|withdrawn"),
    )
    for phrase in phrases.split("|")
)


class Automaton:
    """All occurrences of all terms in a row of words."""

    def __init__(self, terms: Iterable[Term]) -> None:
        import ahocorasick

        held: dict[str, list[Term]] = {}
        for term in terms:
            held.setdefault(f" {' '.join(term.phrase.split())} ", []).append(term)
        self._found = ahocorasick.Automaton()
        for phrase, same in held.items():
            self._found.add_word(phrase, (len(phrase), phrase.count(" ") - 1, same))
        self._empty = not held
        self._found.make_automaton()

    def spans(self, tokens: list[str]) -> list[Span]:
        """By start and end."""
        if self._empty or not tokens:
            return []
        whole, starts, at = f" {' '.join(tokens)} ", [], 0
        for token in tokens:
            starts.append(at)
            at += len(token) + 1
        out = []
        for last, (letters, words, same) in self._found.iter(whole):
            first = bisect_left(starts, last + 1 - letters)
            out += [Span(first, first + words, term) for term in same]
        return sorted(out, key=lambda s: (s.start, s.end, s.term.kind, s.term.value))


def _outer(spans: list[Span]) -> list[Span]:
    """Spans that no longer one holds, in order; of equal ones the first."""
    out: list[Span] = []
    for span in sorted(spans, key=lambda s: (s.start, -s.end)):
        if not out or span.end > out[-1].end:
            out.append(span)
    return out


def read(tokens: list[str], automaton: Automaton) -> list[tuple]:
    """The rows of ``SCHEMA`` for a row of words and marks."""
    found, carried, begin, k = [], None, 0, 0
    spans = automaton.spans(tokens)
    for end in [*(i for i, t in enumerate(tokens) if t in ENDS), len(tokens)]:
        clause = []
        while k < len(spans) and spans[k].start < end:
            clause.append(spans[k])
            k += 1
        rows, carried = _clause(tokens, begin, end, clause, carried)
        found += rows
        begin = end + 1
    return found


def _clause(tokens: list[str], begin: int, end: int, spans: list[Span], carried: str | None) -> tuple[list[tuple], str | None]:
    statuses = _outer([s for s in spans if s.term.kind == STATUS])
    inside = lambda s: any(o.start <= s.start and s.end <= o.end for o in statuses)
    subjects = [s for s in _outer([s for s in spans if s.term.kind == SUBJECT]) if not inside(s)]
    partial = any(s.term.kind == PART and not inside(s) for s in spans)
    kinds: dict[int, set[str]] = {}
    for s in spans:
        if s.term.kind in (NEGATION, FILLER, JOINER) and s.end == s.start + 1:
            kinds.setdefault(s.start, set()).add(s.term.kind)
    covered = {i for s in spans for i in range(s.start, s.end)}
    unread = sum(1 for i in range(begin, end) if i not in covered and tokens[i] != ",")
    rows, taken = [], {}
    for number, s in enumerate(statuses):
        taken[number] = _negated(tokens, begin, s.start, kinds) or bool(number and taken[number - 1] and _joined(statuses[number - 1].end, s.start, kinds))
    for s in spans:
        if s.term.kind == REVOCATION:
            before = [n for n, o in enumerate(statuses) if o.end <= s.start]
            if before:
                taken[before[-1]] = True
    for number, s in enumerate(statuses):
        earlier, later = [o for o in subjects if o.end <= s.start], [o for o in subjects if o.start >= s.end]
        subject = earlier[-1].term.value if earlier else later[0].term.value if later else carried
        rows.append((s.start, s.end, s.term.value, subject, partial, taken[number], unread))
    return rows, subjects[-1].term.value if subjects else carried


def _negated(tokens: list[str], begin: int, start: int, kinds: dict[int, set[str]]) -> bool:
    fillers = True
    for back in range(1, start - begin + 1):
        at = start - back
        if tokens[at] == "," or back > REACH and not fillers:
            return False
        here = kinds.get(at, set())
        if NEGATION in here:
            return True
        fillers = fillers and FILLER in here
    return False


def _joined(end: int, start: int, kinds: dict[int, set[str]]) -> bool:
    between = [kinds.get(i, set()) for i in range(end, start)]
    return any(JOINER in k for k in between) and all(k & {JOINER, FILLER} for k in between)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1))


def status_mentions(texts: DataFrame, text: str, name: str, terms: Iterable[Term] = SCHOOL_TERMS) -> DataFrame:
    """``texts`` with ``name``: the mentions of each text, of ``SCHEMA``; starts and ends are numbers of words and marks."""
    shared = texts.sparkSession.sparkContext.broadcast(tuple(terms))

    @F.pandas_udf(SCHEMA)
    def mentioned(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = Automaton(shared.value)
        names = ("start", "end", "status", "subject", "partial", "taken_back", "unread")
        for rows in series:
            yield pd.Series([[dict(zip(names, r)) for r in read(list(tokens), automaton)] for tokens in rows])

    return texts.withColumn(name, mentioned(words(F.col(text))))


def term_counts(texts: DataFrame, row_id: str, text: str, terms: Iterable[Term]) -> DataFrame:
    """(row_id, phrase, n): how often each term stands in each text, overlapping ones too."""
    shared = texts.sparkSession.sparkContext.broadcast(tuple(terms))

    @F.pandas_udf("array<string>")
    def found(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = Automaton(shared.value)
        for rows in series:
            yield pd.Series([[s.term.phrase for s in automaton.spans(list(tokens))] for tokens in rows])

    return texts.select(row_id, F.explode(found(words(F.col(text)))).alias("phrase")).groupBy(row_id, "phrase").agg(F.count("*").alias("n"))
