"""Statuses in notices: sentences read by hand, and the automaton against a plain scan."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gristmill.operators import grammar

SCHOOL = grammar.Automaton(grammar.SCHOOL_TERMS)


def tokens(text):
    return re.findall(r"[\w']+|[.,;:!?\n]", text.lower())


def said(text):
    return [(status, subject, partial, taken) for _, _, status, subject, partial, taken, _ in grammar.read(tokens(text), SCHOOL)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("All schools closed today.", [("closed", "schools", False, False)]),
        ("Two hour delay for students; staff report on time.", [("delayed", "schools", False, False), ("open", "staff", False, False)]),
        ("There will not be a delay.", [("delayed", None, False, True)]),
        ("No two hour delay or early dismissal.", [("delayed", None, False, True), ("dismissed", None, False, True)]),
        ("No buses, delayed", [("delayed", "buses", False, False)]),
        ("Schools will not be closed. Activities cancelled", [("closed", "schools", False, True), ("closed", "activities", False, False)]),
        ("The delay for buses has been lifted", [("delayed", "buses", False, True)]),
        ("Elementary closed only", [("closed", None, True, False)]),
        ("Schools: opening late\nclosed on Monday", [("delayed", "schools", False, False), ("closed", "schools", False, False)]),
        ("No school", [("closed", None, False, False)]),
        ("Never mind what was said of the delay", [("delayed", None, False, False)]),
        ("", []),
        (", . ;", []),
    ],
)
def test_sentences(text, want):
    assert said(text) == want


def test_unread_words_of_the_clause_are_counted():
    assert [r[-1] for r in grammar.read(tokens("Schools closed, the governor said. Delayed"), SCHOOL)] == [3, 0]


def test_automaton_equals_a_plain_scan():
    rng = random.Random(3)
    for _ in range(200):
        phrases = {" ".join(rng.choice("ab") * rng.randint(1, 2) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 6))}
        terms = [grammar.Term(p, rng.choice(["x", "y"]), p) for p in sorted(phrases)]
        row = [rng.choice(["a", "aa", "b", "bb", ".", ","]) for _ in range(rng.randint(0, 25))]
        want = sorted((i, i + len(t.phrase.split()), t.kind, t.value) for t in terms for i in range(len(row)) if row[i : i + len(t.phrase.split())] == t.phrase.split())
        assert [(s.start, s.end, s.term.kind, s.term.value) for s in grammar.Automaton(terms).spans(row)] == want


def test_frames_with_nulls_and_long_texts(spark):
    rows = [(1, None), (2, ""), (3, "Schools closed."), (4, "filler word " * 30_000 + ". Buses delayed.")]
    got = {r.id: r.m for r in grammar.status_mentions(spark.createDataFrame(rows, "id int, text string"), "text", "m").collect()}
    assert got[1] == got[2] == [] and [(m.status, m.subject) for m in got[3]] == [("closed", "schools")] and (got[4][0].start, got[4][0].subject) == (60_002, "buses")
    counts = grammar.term_counts(spark.createDataFrame(rows, "id int, text string"), "id", "text", grammar.SCHOOL_TERMS)
    assert {(r.id, r.phrase, r.n) for r in counts.where(F.col("id") > 2).collect()} == {(3, "schools", 1), (3, "closed", 1), (4, "buses", 1), (4, "delayed", 1)}
