"""Terms and the statuses they announce over the tables' texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators import grammar
from gristmill.operators.grammar import FILLER, JOINER, NEGATION, PART, REVOCATION, STATUS, SUBJECT, Term
from gristmill.plans.registry import query
from gristmill.session import table

#: The tables' prose is invented, so its small words stand for terms; phrases overlap and hold each other.
TERMS = tuple(
    Term(phrase, kind, value)
    for kind, value, phrases in (
        (STATUS, "closed", "in the|the|of the"), (STATUS, "delayed", "that|that is|to the"), (STATUS, "open", "der|la|die"), (SUBJECT, "schools", "of|de|von"), (SUBJECT, "staff", "for|en|und"),
        (PART, "part", "with|from|des"), (NEGATION, "not", "is|was|le"), (FILLER, "filler", "a|an|un"), (JOINER, "joiner", "and|or|et"), (REVOCATION, "revoked", "on the|by|que"),
    )
    for phrase in phrases.split("|")
)


@query(
    "term_counts",
    rf"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}'']+|[.,;:!?\n]') AS words FROM documents), t AS (SELECT unnest({sorted({t.phrase for t in TERMS})}) AS phrase),
    s AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w), g AS (SELECT doc_id, words[i] AS phrase FROM s UNION ALL SELECT doc_id, words[i] || ' ' || words[i + 1] FROM s WHERE i < len(words))
    SELECT doc_id, phrase, count(*) AS n FROM g JOIN t USING (phrase) GROUP BY 1, 2""",
)
def term_counts(spark, d):
    return grammar.term_counts(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", TERMS)


@query("status_mentions")
def status_mentions(spark, d):
    """What each text of a conversation announces, of whom, and what is taken back. No SQL: clauses are read in order."""
    found = grammar.status_mentions(table(spark, d, "conversations").select("conv_id", "turn", "text"), "text", "mentions", TERMS)
    return found.select("conv_id", "turn", F.posexplode("mentions").alias("number", "m")).select("conv_id", "turn", "number", "m.*")
