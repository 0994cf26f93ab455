"""A minimal acyclic transducer: words to numbers, in shared suffixes.

``compile_words`` adds sorted words one by one and merges equal states as soon
as no later word can change them, so the automaton stays minimal while it is
built.  Each transition holds how many accepted words lie before it, so the
sum along a path is the word's rank, and an array of outputs is read at that
rank.  The result is one run of bytes that a worker maps into memory.
"""

from __future__ import annotations

import mmap
import struct
import tempfile
from collections.abc import Sequence

import numpy as np

_HEAD = struct.Struct("<5q")


class _State:
    __slots__ = ("edges", "final", "number")

    def __init__(self) -> None:
        self.edges: dict[int, _State] = {}
        self.final = False
        self.number = -1

    def key(self) -> tuple:
        return (self.final, *((b, id(s)) for b, s in self.edges.items()))


def compile_words(outputs: dict[str, Sequence[int]]) -> bytes:
    """The automaton of the keys and their id sequences, as bytes."""
    keys = sorted((word.encode("utf-8"), ids) for word, ids in outputs.items())
    root, register = _State(), {}
    path: list[tuple[_State, int]] = []  # from the root to the end of the last word
    last = b""

    def settle(depth: int) -> None:
        while len(path) > depth:
            parent, byte = path.pop()
            child = parent.edges[byte]
            parent.edges[byte] = register.setdefault(child.key(), child)

    for word, _ in keys:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        settle(same)
        at = root if not path else path[-1][0].edges[path[-1][1]]
        for byte in word[same:]:
            at.edges[byte] = _State()
            path.append((at, byte))
            at = at.edges[byte]
        at.final = True
        last = word
    settle(0)
    return _pack(root, [ids for _, ids in keys])


def _pack(root: _State, outputs: list[Sequence[int]]) -> bytes:
    order: list[_State] = []  # children before parents
    stack: list[tuple[_State, bool]] = [(root, False)]
    while stack:
        state, done = stack.pop()
        if state.number >= 0:
            continue
        if done:
            state.number = len(order)
            order.append(state)
        else:
            stack.append((state, True))
            stack.extend((child, False) for child in state.edges.values() if child.number < 0)
    below = np.zeros(len(order), np.int64)
    first, finals, labels, targets, skipped = [0], [], [], [], []
    for state in order:
        rank = int(state.final)
        finals.append(state.final)
        for byte, child in state.edges.items():  # ascending, since words came sorted
            labels.append(byte)
            targets.append(child.number)
            skipped.append(rank)
            rank += int(below[child.number])
        below[state.number] = rank
        first.append(len(labels))
    offsets = np.cumsum([0, *map(len, outputs)], dtype=np.int32)
    parts = [
        np.array(first, np.int32), np.array(targets, np.int32), np.array(skipped, np.int32), offsets,
        np.array([i for ids in outputs for i in ids], np.int32), np.array(labels, np.uint8), np.array(finals, np.uint8),
    ]
    return _HEAD.pack(len(order), len(labels), len(outputs), int(offsets[-1]), root.number) + b"".join(p.tobytes() for p in parts)


class Lexicon:
    """A compiled automaton, mapped into memory from an unlinked scratch file."""

    def __init__(self, compiled: bytes) -> None:
        with tempfile.TemporaryFile() as scratch:
            scratch.write(compiled)
            scratch.flush()
            self._map = mmap.mmap(scratch.fileno(), 0, access=mmap.ACCESS_READ)
        states, edges, words, ids, self._root = _HEAD.unpack_from(self._map)
        at = _HEAD.size

        def take(kind: str, size: int) -> memoryview:
            nonlocal at
            view = memoryview(self._map)[at : at + size * struct.calcsize(kind)].cast(kind)
            at += size * struct.calcsize(kind)
            return view

        self._first, self._target, self._skipped = take("i", states + 1), take("i", edges), take("i", edges)
        self._offset, self._ids = take("i", words + 1), take("i", ids)
        self._label, self._final = take("B", edges), take("B", states)
        self.states, self.words = states, words
        first, label = np.asarray(self._first), np.asarray(self._label)
        self._edge = np.repeat(np.arange(states), np.diff(first)) * 256 + label  # ascends with state and label

    def get(self, word: str) -> list[int] | None:
        """The output of a word, or None where the automaton does not accept it."""
        state, rank = self._root, 0
        for byte in word.encode("utf-8"):
            low, high = self._first[state], self._first[state + 1]
            while low < high:  # labels of a state ascend
                middle = (low + high) // 2
                if self._label[middle] < byte:
                    low = middle + 1
                else:
                    high = middle
            if low == self._first[state + 1] or self._label[low] != byte:
                return None
            rank += self._skipped[low]
            state = self._target[low]
        return self.output(rank) if self._final[state] else None

    def output(self, rank: int) -> list[int]:
        """The ids of the accepted word of this rank."""
        return list(self._ids[self._offset[rank] : self._offset[rank + 1]])

    def ranks(self, words: list[str]) -> np.ndarray:
        """The rank of each word, -1 where the automaton does not accept it; all words take a step at a time."""
        encoded = [w.encode("utf-8") for w in words]
        out = np.full(len(words), -1, np.int64)
        if not self.words or not words:
            return out
        letters = np.frombuffer(b"".join(encoded), np.uint8)
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        at = np.cumsum(sizes) - sizes
        live, left = np.arange(len(words)), sizes
        state, rank = np.full(len(words), self._root, np.int64), np.zeros(len(words), np.int64)
        target, skipped, final = np.asarray(self._target), np.asarray(self._skipped), np.asarray(self._final)
        while len(live):
            done = left == 0
            ended = done & (final[state] == 1)
            out[live[ended]] = rank[ended]
            live, left, at, state, rank = live[~done], left[~done], at[~done], state[~done], rank[~done]
            wanted = state * 256 + letters[at]
            edge = np.minimum(np.searchsorted(self._edge, wanted), len(self._edge) - 1)
            found = self._edge[edge] == wanted
            live, left, at, rank, edge = live[found], left[found] - 1, at[found] + 1, rank[found], edge[found]
            rank = rank + skipped[edge]
            state = target[edge].astype(np.int64)
        return out
