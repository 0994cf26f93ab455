"""BPE encoding and decoding with a lexicon of frequent words.

Words are counted over all texts; the most frequent ones are encoded once on
the driver and compiled into a minimal acyclic transducer (``lexicon``) that
is broadcast and memory-mapped.  Their number and ``LEXICON_LETTERS`` bound
what is broadcast.  A slice of texts is cut at white space and its runs are
numbered; each distinct run is split by the tokenizer's pattern once, all
distinct words go through the transducer together, and what it does not accept
is merged by rank, exactly.  Ids are put together by number of the run, and
what they decode to by id, so a worker remembers ids alone.

The vocabulary file is JSON of the tokenizers library: NFC, lower case and
white space removed, words and marks by pattern, bytes as printable
characters, a suffix at a word's end.  Its path is a parameter; executors get
the tables by broadcast and read no file.

Edge cases: a null text counts as empty and has no ids; special tokens inside
a text are ids of their own; repeated rows are encoded one by one; an empty
table gives an empty result; other columns are ignored; a word of n letters is
merged in n log n steps.  Letters and digits are those of the installed
``regex`` module: code points that only the newest Unicode versions assign may
be split otherwise than by the library.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import cut, documents, frequent, slices
from gristmill.llm.lexicon import Lexicon, compile_words

FREQUENT_WORDS = 1 << 16
#: Longer words stay out of the lexicon.
LEXICON_LETTERS = 64
#: Words outside the lexicon that a worker remembers, up to twice as many.
MEMO_WORDS = 1 << 15
#: Parts from which the merges of a word are kept in a heap.
HEAP_PARTS = 48
ENCODE_BYTES = 1 << 20

#: Fixed value: the pattern of the tokenizer file, and what it is for a lower-case ASCII run.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ASCII_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")

#: White space by Unicode; Python's own also has the four separators from 1C to 1F, which the tokenizer keeps.
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The runs between white space of all texts, as numbers of the distinct ones; where each text's begin; the distinct ones.

    No piece of the tokenizer reaches across white space.
    """
    if pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py():
        lists = pa.array([_SPACES.split(t) for t in texts.to_pylist()], pa.list_(pa.string()))
    else:
        lists = pc.utf8_split_whitespace(texts)
    flat, offsets = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    some = pc.not_equal(flat, "")
    before = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    found = flat.filter(some).dictionary_encode()
    return np.asarray(found.indices).astype(np.int64), before[offsets - offsets[0]], found.dictionary


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else the next free one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Rules:
    """How one tokenizer file splits texts."""

    def __init__(self, spec: dict) -> None:
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        if pattern != PIECE or any("|" not in s for s in self.special):
            raise ValueError("a tokenizer file of another kind")
        self.piece = regex.compile(pattern)
        self.marks = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")

    def pieces(self, text: str) -> list[str]:
        """Special tokens as they stand, and the words and marks between them after normalisation."""
        if not self.marks.search(text):
            return self.piece.findall(_normal(text))
        out: list[str] = []
        for part in self.marks.split(text):
            out += [part] if part in self.special else self.piece.findall(_normal(part))
        return out


    def prepared(self, texts: pa.Array) -> pa.Array:
        """The texts after normalisation; a special token is a run of its number after a capital, which no other run has."""
        marks = [*self.special]
        out = []
        for text in texts.to_pylist():
            if text and any(s in text for s in marks):
                out.append(" ".join(f"S{self.special[p]}" if p in self.special else _normal(p) for p in self.marks.split(text)))
            else:
                out.append(_normal(text or ""))
        return pa.array(out, pa.string())

    def of_run(self, run: str) -> list[str]:
        """The pieces of a run of ``prepared`` without white space; a run of letters is one."""
        if run[0] == "S":
            return [next(s for s, i in self.special.items() if i == int(run[1:]))]
        return _ASCII_PIECE.findall(run) if run.isascii() else self.piece.findall(run)


class Model(Rules):
    """Splitting rules, vocabulary and merge ranks of one tokenizer file."""

    def __init__(self, spec: dict) -> None:
        super().__init__(spec)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = {pair: (rank, pair[0] + pair[1]) for rank, pair in enumerate(pairs)}
        self.suffix: str = model["end_of_word_suffix"]
        self.bytes = byte_characters()
        self.strings = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}

    @classmethod
    def load(cls, path: str) -> Model:
        with open(path, encoding="utf-8") as file:
            return cls(json.load(file))

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece: the pair of lowest rank, leftmost first, is merged until none is left."""
        if piece in self.special:
            return [self.special[piece]]
        table = self.bytes
        parts = [table[b] for b in piece.encode("utf-8")]
        parts[-1] += self.suffix
        merges = self.merges
        if len(parts) > HEAP_PARTS:
            return [self.ids[p] for p in merged(parts, merges)]
        ranks = [merges.get(pair) for pair in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for k, found in enumerate(ranks):
                if found is not None and (best is None or found[0] < best[0]):
                    best, at = found, k
            if best is None:
                return [self.ids[p] for p in parts]
            parts[at : at + 2] = [best[1]]
            del ranks[at]
            if at > 0:
                ranks[at - 1] = merges.get((parts[at - 1], parts[at]))
            if at < len(parts) - 1:
                ranks[at] = merges.get((parts[at], parts[at + 1]))

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's strings joined by spaces, as a tokenizer without a decoder has it."""
        return " ".join(self.strings[i] for i in ids)


def _normal(text: str) -> str:
    """NFC, then every character lower-cased by itself (no rule for a last sigma)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def merged(parts: list[str], merges: dict[tuple[str, str], tuple[int, str]]) -> list[str]:
    """The parts after all merges, lowest rank and leftmost first, by a heap over a linked list."""
    after = [*range(1, len(parts)), -1]
    before = list(range(-1, len(parts) - 1))
    alive: list[str | None] = list(parts)
    heap = [(found[0], k, pair) for k, pair in enumerate(zip(parts, parts[1:])) if (found := merges.get(pair))]
    heapq.heapify(heap)
    while heap:
        _, at, pair = heapq.heappop(heap)
        other = after[at]
        if other < 0 or (alive[at], alive[other]) != pair:
            continue
        alive[at], alive[other] = merges[pair][1], None
        after[at] = after[other]
        if after[at] >= 0:
            before[after[at]] = at
        for low, high in ((before[at], at), (at, after[at])):
            if low >= 0 and high >= 0 and (found := merges.get((alive[low], alive[high]))):
                heapq.heappush(heap, (found[0], low, (alive[low], alive[high])))
    return [p for p in alive if p is not None]


class Numbers(dict):
    """Keys numbered in the order in which they are asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


class Encoder:
    """A model with its lexicon; of words outside the lexicon, what it has met lately is remembered."""

    def __init__(self, model: Model, compiled: bytes) -> None:
        self.model, self.lexicon = model, Lexicon(compiled)
        self._accepted: list[bytes | None] = [None] * self.lexicon.words
        self._memo: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        known = range(max(model.strings) + 1)
        self._strings = pa.array([model.strings.get(i) for i in known], pa.string())
        self._decimals = pa.array([str(i) for i in known], pa.string())

    def forget(self) -> None:
        """Drop what has been met, and hand back memory: workers stay when their task ends."""
        self._accepted = [None] * self.lexicon.words
        self._memo, self._older = {}, {}
        pa.default_memory_pool().release_unused()

    def _unseen(self, piece: str) -> bytes:
        entry = self._memo.get(piece)
        if entry is None:
            entry = self._older.get(piece) or array("i", self.model.merge(piece)).tobytes()
            if len(self._memo) >= MEMO_WORDS:
                self._older, self._memo = self._memo, {}
            if len(piece) <= LEXICON_LETTERS:
                self._memo[piece] = entry
        return entry

    def entries(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece as bytes: the transducer's output, or else merges."""
        out = []
        accepted = self._accepted
        for piece, rank in zip(pieces, self.lexicon.ranks(pieces).tolist()):
            if rank < 0:
                out.append(self._unseen(piece))
                continue
            entry = accepted[rank]
            if entry is None:
                entry = accepted[rank] = array("i", self.lexicon.output(rank)).tobytes()
            out.append(entry)
        return out

    def encode(self, texts: pa.Array) -> Encoded:
        """The texts of one slice."""
        order, starts, distinct = numbered(self.model.prepared(texts))
        known = Numbers()
        single, several = [], {}
        for k, run in enumerate(distinct.to_pylist()):
            if run.isalpha():
                single.append(known[run])
            else:
                pieces = self.model.of_run(run)
                single.append(known[pieces[0]])
                if len(pieces) > 1:
                    several[k] = [known[p] for p in pieces]
        found = self.entries(list(known))
        entries = [found[k] for k in single]
        for k, pieces in several.items():
            entries[k] = b"".join([found[p] for p in pieces])
        return Encoded(order, starts, entries, self._decimals, self._strings)


class Encoded:
    """Encoded texts: the ids of all in one array, and where each text's begin."""

    def __init__(self, order: np.ndarray, starts: np.ndarray, entries: list[bytes], decimals: pa.Array, strings: pa.Array) -> None:
        self._decimals, self._strings = decimals, strings
        sizes = np.fromiter(map(len, entries), np.int64, len(entries)) // 4
        lengths = sizes[order]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat((np.cumsum(sizes) - sizes)[order] - ends[:-1], lengths) + np.arange(int(ends[-1]))
        self._flat = pa.array(np.frombuffer(b"".join(entries), np.int32)[at], pa.int32())
        self._starts = ends[starts]

    def ids(self) -> pa.ListArray:
        """The ids of each text as one list array."""
        return self._listed(self._flat)

    def counts(self) -> np.ndarray:
        """Ids of each text."""
        return np.diff(self._starts)

    def decimals(self) -> pa.Array:
        """The ids of each text in decimal, joined by spaces."""
        return pc.binary_join(self._listed(self._decimals.take(self._flat)), " ")

    def decoded(self) -> pa.Array:
        return pc.binary_join(self._listed(self._strings.take(self._flat)), " ")

    def _listed(self, values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(self._starts.astype(np.int32)), values)


_encoders: dict[str, Encoder] = {}


def _encoder(key: str, model: Broadcast, compiled: Broadcast) -> Encoder:
    """One for each worker process and lexicon."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(Model(json.loads(model.value)), compiled.value)
    return _encoders[key]


def frequent_words(texts: DataFrame, model: Broadcast, limit: int = FREQUENT_WORDS, memory: int = 100_000) -> list[str]:
    """The most frequent pieces over all texts, at most ``limit``: as many whole levels of the count's logarithm as fit.

    Tasks add up pieces before anything is shuffled and hand on what they
    hold whenever ``memory`` distinct ones are held.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, held = Rules(model.value), Counter()
        for batch in slices(batches, budget=ENCODE_BYTES):
            order, _, distinct = numbered(rules.prepared(batch.column("text")))
            times = np.bincount(order, minlength=len(distinct)).tolist()
            for run, n in zip(distinct.to_pylist(), times):
                if run.isalpha():
                    held[run] += n
                else:
                    for piece in rules.of_run(run):
                        held[piece] += n
            if len(held) > memory:
                yield pairs(held)
                held = Counter()
        yield pairs(held)
        pa.default_memory_pool().release_unused()

    def pairs(held: Counter) -> pa.RecordBatch:
        kept = [(p, n) for p, n in held.items() if len(p) <= LEXICON_LETTERS]
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["piece", "n"])

    counts = cut(texts.mapInArrow(counted, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")), "pieces")
    return [r.piece for r in frequent(counts, limit).collect()]


def prepare(docs: DataFrame, path: str, text_col: str = "text", limit: int = FREQUENT_WORDS) -> tuple[Broadcast, Broadcast]:
    """The tokenizer's file and the compiled lexicon of ``docs``, both broadcast; a worker keeps no more of the file than its tables."""
    with open(path, encoding="utf-8") as file:
        source = file.read()
    context, spec = docs.sparkSession.sparkContext, json.loads(source)
    splitting = context.broadcast({k: spec[k] for k in ("added_tokens", "pre_tokenizer")})
    model = Model(spec)
    words = frequent_words(docs.select(F.col(text_col).alias("text")), splitting, limit)
    return context.broadcast(source.encode()), context.broadcast(compile_words({w: model.merge(w) for w in words}))


def digested(texts: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(t).hexdigest() for t in texts.cast(pa.binary()).to_pylist()], pa.string())


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = FREQUENT_WORDS, digest: bool = False) -> DataFrame:
    """id, n_tokens, ids (array of int) and decoded text of every row, or with ``digest`` its digest as decoded_sha256."""

    def body(encoded: Encoded) -> list[pa.Array]:
        back = digested(encoded.decoded()) if digest else encoded.decoded()
        return [pa.array(encoded.counts()), encoded.ids(), back]

    return _map(docs, path, id_col, text_col, limit, f"n_tokens long, ids array<int>, {'decoded_sha256' if digest else 'decoded'} string", body)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = FREQUENT_WORDS) -> DataFrame:
    """id, n_tokens and the digests of ids and decoded text."""

    def body(encoded: Encoded) -> list[pa.Array]:
        return [pa.array(encoded.counts()), digested(encoded.decimals()), digested(encoded.decoded())]

    return _map(docs, path, id_col, text_col, limit, "n_tokens long, ids_sha256 string, decoded_sha256 string", body)


def _map(docs: DataFrame, path: str, id_col: str, text_col: str, limit: int, columns: str, body) -> DataFrame:
    shared, compiled = prepare(docs, path, text_col, limit)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, shared, compiled)
        for batch in slices(batches, budget=ENCODE_BYTES):
            arrays = body(encoder.encode(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], names=names)
        encoder.forget()

    key = uuid.uuid4().hex
    names = ["id", *(c.split()[0] for c in columns.split(", "))]
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(encoded, f"id {kind}, {columns}").withColumnRenamed("id", id_col)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), tokenizer_path())
