"""Fill-in-middle transformation over ropes.

A text is a rope: a balanced tree whose leaves hold a few lines each, and whose
nodes keep how many units (lines) and code points lie below them.  Two splits at
unit ranks give prefix, middle and suffix; the output is the concatenation of
these trees, in the order of its form, with sentinels that count no unit.  The
inverse builds a rope of the output, finds the sentinels that the form names,
splits at their code point ranks and puts the pieces back in order.

Ranks and forms are drawn from SHA-256 of the seed and the id, so reruns,
retried tasks and other partitionings agree, and no row needs another: the
plan has no shuffle.

Edge cases: a null text is an empty one; an empty text, or one that contains a
sentinel, is plain and stays as it is; a null id is drawn as an empty id; rows
that repeat get the same form; very long texts and lines are cut by references
to leaves, so an output costs its own length once; an empty table gives an
empty result; all columns are kept, and the result is one struct column
``into``, which replaces a column of that name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.common import documents, slices

#: Fixed values of the contract: sentinels, seed, and the shares of a hundred that are transformed and that put the suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
RATE, SUFFIX_FIRST = 100, 50

LEAF_CHARS = 512


@dataclass(frozen=True, slots=True)
class Leaf:
    """Some text; ``units`` and ``chars`` are its lines and code points."""

    text: str
    units: int
    chars: int


@dataclass(frozen=True, slots=True)
class Node:
    left: Rope
    right: Rope
    units: int = field(init=False)
    chars: int = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "units", self.left.units + self.right.units)
        object.__setattr__(self, "chars", self.left.chars + self.right.chars)


Rope = Leaf | Node
NOTHING = Leaf("", 0, 0)


def leaf(text: str) -> Leaf:
    return Leaf(text, text.count("\n") + (text != "" and text[-1] != "\n"), len(text))


def mark(sentinel: str) -> Leaf:
    return Leaf(sentinel, 0, len(sentinel))


def balanced(parts: list[Rope]) -> Rope:
    """A tree over ``parts`` in order, as flat as can be."""
    while len(parts) > 1:
        parts = [Node(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0] if parts else NOTHING


def rope(text: str, leaf_chars: int = LEAF_CHARS) -> Rope:
    """Leaves of whole lines, of ``leaf_chars`` code points or more but for the last."""
    leaves: list[Rope] = []
    at = 0
    while at < len(text):
        end = text.find("\n", at + leaf_chars - 1) + 1 or len(text)
        leaves.append(leaf(text[at:end]))
        at = end
    return balanced(leaves)


def _joined(left: Rope, right: Rope) -> Rope:
    return right if left is NOTHING else left if right is NOTHING else Node(left, right)


def split_units(tree: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first ``rank`` units, and the rest."""
    if rank <= 0:
        return NOTHING, tree
    if rank >= tree.units:
        return tree, NOTHING
    if isinstance(tree, Node):
        if rank <= tree.left.units:
            left, right = split_units(tree.left, rank)
            return left, _joined(right, tree.right)
        left, right = split_units(tree.right, rank - tree.left.units)
        return _joined(tree.left, left), right
    at = 0
    for _ in range(rank):
        at = tree.text.index("\n", at) + 1
    return Leaf(tree.text[:at], rank, at), Leaf(tree.text[at:], tree.units - rank, tree.chars - at)


def split_chars(tree: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first ``rank`` code points, and the rest."""
    if rank <= 0:
        return NOTHING, tree
    if rank >= tree.chars:
        return tree, NOTHING
    if isinstance(tree, Node):
        if rank <= tree.left.chars:
            left, right = split_chars(tree.left, rank)
            return left, _joined(right, tree.right)
        left, right = split_chars(tree.right, rank - tree.left.chars)
        return _joined(tree.left, left), right
    return leaf(tree.text[:rank]), leaf(tree.text[rank:])


def text_of(tree: Rope) -> str:
    parts, open_ = [], [tree]
    while open_:
        top = open_.pop()
        if isinstance(top, Node):
            open_ += (top.right, top.left)
        else:
            parts.append(top.text)
    return "".join(parts)


def draws(number: int | None, seed: int = SEED) -> list[int]:
    """Four unsigned 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if number is None else number}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def transformed(text: str, drawn: list[int], rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[str, str, int, int | None, int | None]:
    """(output, form, units, code points of the prefix, of the middle)."""
    whole = rope(text)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or drawn[2] % 100 >= rate:
        return text, "plain", whole.units, None, None
    one, two = sorted(h % (whole.units + 1) for h in drawn[:2])
    prefix, rest = split_units(whole, one)
    middle, suffix = split_units(rest, two - one)
    if drawn[3] % 100 < suffix_first:
        form, parts = "spm", [mark(SUFFIX), suffix, mark(PREFIX), prefix, mark(MIDDLE), middle]
    else:
        form, parts = "psm", [mark(PREFIX), prefix, mark(SUFFIX), suffix, mark(MIDDLE), middle]
    return text_of(balanced(parts)), form, whole.units, prefix.chars, middle.chars


def inverted(output: str, form: str) -> str:
    """The text from which ``transformed`` made this output."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    at = output.index(second, len(first))  # no piece holds a sentinel, and none can begin before the real one
    last = output.index(MIDDLE, at + len(second))
    _, rest = split_chars(rope(output), len(first))
    one, rest = split_chars(rest, at - len(first))
    _, rest = split_chars(rest, len(second))
    two, rest = split_chars(rest, last - at - len(second))
    _, middle = split_chars(rest, len(MIDDLE))
    prefix, suffix = (two, one) if form == "spm" else (one, two)
    return text_of(balanced([prefix, middle, suffix]))


RESULT = T.StructType([T.StructField(name, kind()) for name, kind in (("output", T.StringType), ("form", T.StringType), ("n", T.LongType), ("prefix_chars", T.LongType), ("middle_chars", T.LongType))])


def _passed(docs: DataFrame, columns: dict[str, Column], results: T.StructType, work: Callable[..., list]) -> DataFrame:
    """``docs`` as (row, results): ``work`` gets the named columns as lists, the longest text first, and gives a list for each field."""
    names = list(columns)
    kinds = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.string() for f in results.fields]
    whole = docs.select(*[column.alias(name) for name, column in columns.items()], F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, names[0]):
            found = work(*(batch.column(c).to_pylist() for c in names))
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(x, kind) for x, kind in zip(found, kinds))], names=["row", *results.names])

    return whole.mapInArrow(applied, T.StructType([T.StructField("row", whole.schema["row"].dataType), *results.fields]))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", into: str = "fim", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``docs`` with a struct column ``into`` of ``RESULT``."""

    def work(texts: list[str | None], ids: list[int | None]) -> list[tuple]:
        return list(zip(*(transformed(t or "", draws(i, seed), rate, suffix_first) for t, i in zip(texts, ids)))) or [()] * len(RESULT)

    found = _passed(docs, {"text": F.col(text_col), "id": F.col(id_col)}, RESULT, work)
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != into], F.struct(*RESULT.names).alias(into))


def restore(docs: DataFrame, fim_col: str = "fim", into: str = "restored") -> DataFrame:
    """``docs`` with a string column ``into``: the text rebuilt from the output and the form of ``fim_col`` alone."""
    parts = {c: F.col(f"{fim_col}.{c}") for c in ("output", "form")}
    found = _passed(docs, parts, T.StructType([T.StructField("text", T.StringType())]), lambda outputs, forms: [[inverted(o, f) for o, f in zip(outputs, forms)]])
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != into], F.col("text").alias(into))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = restore(fill_in_middle(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "fim"))
    digest = [F.sha2(F.encode(c, "UTF-8"), 256).alias(name) for c, name in (("fim.output", "output_sha256"), ("restored", "restored_sha256"))]
    return made.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", *digest)


ORACLE_SQL = r"""
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id::VARCHAR) AS d, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units
    FROM documents
), numbers AS (
    SELECT doc_id, text, units, len(units) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4
    FROM drawn
), formed AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM numbers
), cut AS (
    SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix
    FROM formed
)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""
