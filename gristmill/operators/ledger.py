"""When rows of a source's list were first seen, kept as state over its reads.

A read lists (key, ident) rows of a source at a time: the key names a row as it
stands, the ident what it is about.  A key's first sighting is dated by an
interval: after ``lo``, the last good read before it, and by ``hi``, the read
that showed it.  ``lo`` is null, and the sighting ``cold``, where the last good
read is too old or the key was there before, and ``churn`` where the list was
largely replaced.

- A read that is not newer than the last good one is late and changes nothing.
- A read that lost half of the rows or more is partial and changes nothing,
  unless the next one repeats it.
- A read that found the list not modified confirms it as it was; after a
  partial read it does not.
- A key that is absent for under three hours, or while no new key has come,
  keeps its sighting when it returns on the same day: a flap.  Otherwise it has
  appeared again.
- Absent keys are gone once a read three hours on has passed and a new key has
  come; keys not seen for two weeks are forgotten, and a source without a good
  read for two weeks starts anew.
- A new key with the ident of an absent one is its successor; of several, the
  one seen last, and none where that is a tie.

A read costs what it lists and changes: present keys share the time of the last
good read, and absent ones wait in queues by time.  ``step`` is one read; the
batch form folds a source's reads in order, and ``gristmill.streaming.ledger``
calls the same step from streaming state.  A state packs into bytes that are
the same for equal states.
"""

from __future__ import annotations

import hashlib
import json
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WARM_SECONDS = 36 * 3600
FLAP_SECONDS = 3 * 3600
PRUNE_SECONDS = 14 * 86400
DAY_SECONDS = 86400
PARTIAL_SHARE = 0.5
LEAST_FOR_CHURN = 5
SCHEMA = "source long, key string, ident string, lo long, hi long, started string, pred string, last_seen long, absent_since long, gone boolean, derived string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


@dataclass
class Sighting:
    ident: str
    lo: int | None
    hi: int
    started: str
    pred: str | None = None
    last_seen: int | None = None  # null while present
    absent_since: int | None = None
    gone: bool = False


@dataclass
class State:
    last_good: int | None = None
    partial: bool = False  # the last read was
    ignored: str | None = None  # digest of the partial read
    newest: int | None = None  # the last read that brought a new key
    keys: dict[str, Sighting] = field(default_factory=dict)
    present: set[str] = field(default_factory=set)
    absent: dict[str, set[str]] = field(default_factory=dict)  # ident to keys that are absent and not gone
    ageing: deque = field(default_factory=deque)  # (absent since, key) in order
    pruning: deque = field(default_factory=deque)  # (last seen, key) in order
    version: str | None = None
    derived: dict[str, str | None] = field(default_factory=dict)


def pack(state: State) -> bytes:
    """The state as bytes, equal for equal states."""
    keys = {k: asdict(s) for k, s in sorted(state.keys.items())}
    return json.dumps([state.last_good, state.partial, state.ignored, state.newest, keys, state.version, sorted(state.derived.items())], separators=(",", ":"), ensure_ascii=False).encode("utf-8", "surrogatepass")


def unpack(data: bytes) -> State:
    last_good, partial, ignored, newest, keys, version, derived = json.loads(data.decode("utf-8", "surrogatepass"))
    state = State(last_good, partial, ignored, newest, {k: Sighting(**s) for k, s in keys.items()}, version=version, derived=dict(derived))
    away = []
    for key, held in state.keys.items():
        if held.absent_since is None:
            state.present.add(key)
        else:
            away.append((held.last_seen, held.absent_since, key))
            if not held.gone:
                state.absent.setdefault(held.ident, set()).add(key)
    for last_seen, since, key in sorted(away):
        state.pruning.append((last_seen, key))
        if not state.keys[key].gone:
            state.ageing.append((since, key))
    return state


def _churned(was: set[str], now: set[str]) -> bool:
    return len(was) >= LEAST_FOR_CHURN and len(now - was) >= 0.5 * len(now) and len(was - now) >= 0.5 * len(was)


def _predecessor(state: State, ident: str, taken: set[str]) -> tuple[str | None, bool]:
    """The absent key of ``ident`` that was seen last, and whether several were."""
    found = sorted(((state.keys[k].last_seen, k) for k in state.absent.get(ident, ()) if k not in taken), reverse=True)
    if not found:
        return None, False
    tied = len(found) > 1 and found[0][0] == found[1][0]
    return (None, True) if tied else (found[0][1], False)


def _age(state: State, at: int) -> list[str]:
    """Mark as gone what has been absent for three hours and since before a new key came."""
    gone, until = [], min(at - FLAP_SECONDS, state.newest if state.newest is not None else -(1 << 62))
    while state.ageing and state.ageing[0][0] <= until:
        since, key = state.ageing.popleft()
        held = state.keys.get(key)
        if held is not None and held.absent_since == since and not held.gone:
            held.gone = True
            state.absent[held.ident].discard(key)
            gone.append(key)
    while state.pruning and state.pruning[0][0] < at - PRUNE_SECONDS:
        last_seen, key = state.pruning.popleft()
        held = state.keys.get(key)
        if held is not None and held.absent_since is not None and held.last_seen == last_seen:
            _forget(state, key)
    return gone


def _forget(state: State, key: str) -> None:
    held = state.keys.pop(key)
    state.absent.get(held.ident, set()).discard(key)
    if not state.absent.get(held.ident):
        state.absent.pop(held.ident, None)
    state.derived.pop(key, None)


def step(state: State, at: int, listed: Iterable[tuple[str, str]] | None, outcome: str = "ok") -> str:
    """Take in one read; what became of it: good, confirmed, late, partial or failed.

    ``listed`` is None for a read without a body: not modified, or failed.  Of
    rows that share a key the last one counts.
    """
    if outcome not in ("ok", "not_modified"):
        return "failed"
    if state.last_good is not None and at <= state.last_good:
        return "late"
    if state.last_good is not None and at - state.last_good > PRUNE_SECONDS:
        state.__init__()
    if listed is None:
        if outcome != "not_modified" or state.last_good is None:
            return "failed"
        if state.partial:
            return "partial"
        state.last_good = at
        _age(state, at)
        return "confirmed"
    now = dict(listed)
    was = state.present
    digest = hashlib.sha256("\n".join(sorted(now)).encode("utf-8", "surrogatepass")).hexdigest()
    if was and len(now) <= PARTIAL_SHARE * len(was) and digest != state.ignored:
        state.partial, state.ignored = True, digest
        return "partial"
    churned = _churned({state.keys[k].ident for k in was}, set(now.values())) or _churned(was, set(now))
    last = state.last_good
    warm = last is not None and at - last <= WARM_SECONDS
    for key in was - now.keys():
        held = state.keys[key]
        held.last_seen, held.absent_since = last, at
        state.absent.setdefault(held.ident, set()).add(key)
        state.ageing.append((at, key))
        state.pruning.append((last, key))
    new = sorted(k for k in now if k not in state.keys or state.keys[k].gone)
    if new:
        state.newest = at
    again: list[tuple[str, bool]] = []
    for key in sorted(now.keys() - was - set(new)):
        held = state.keys[key]
        away = at - held.absent_since >= FLAP_SECONDS
        before_new = state.newest is not None and state.newest >= held.absent_since and (state.newest < at or not new)
        if away and (before_new or held.hi // DAY_SECONDS < at // DAY_SECONDS):
            again.append((key, before_new))
            continue
        state.absent[held.ident].discard(key)
        held.last_seen = held.absent_since = None
    back = {k for k, _ in again}
    dated: dict[str, Sighting] = {}
    for key, lapsed in [*((k, True) for k in new), *again]:
        pred, tied = _predecessor(state, now[key], back) if key in state.keys.keys() - back or key not in state.keys else (None, False)
        pred = None if pred == key else pred
        lo = last if lapsed and warm and not tied and (pred is not None or not churned) else None
        started = "warm" if lo is not None else "churn" if warm and churned and not tied and key not in back else "cold"
        dated[key] = Sighting(now[key], lo, at, started, pred)
    for key, sighting in dated.items():
        if key in state.keys:
            _forget(state, key)
        state.keys[key] = sighting
    state.present = set(now)
    state.last_good, state.partial, state.ignored = at, False, None
    _age(state, at)
    return "good"


def derive(state: State, version: str, of: Callable[[str], str | None]) -> int:
    """What ``of`` makes of each key, worked out anew only for new keys, or for all when ``version`` has changed; how many were."""
    if version != state.version:
        state.version, state.derived = version, {}
    wanted = [k for k in state.keys if k not in state.derived]
    state.derived.update((k, of(k)) for k in wanted)
    return len(wanted)


def rows_of(source: int, state: State) -> pd.DataFrame:
    """One row for each key, gone ones included; a present key was last seen by the last good read."""
    rows = [
        (source, k, s.ident, s.lo, s.hi, s.started, s.pred, state.last_good if s.absent_since is None else s.last_seen, s.absent_since, s.gone, state.derived.get(k)) for k, s in sorted(state.keys.items())
    ]
    frame = pd.DataFrame(rows, columns=COLUMNS)
    return frame.astype({"lo": "Int64", "hi": "Int64", "last_seen": "Int64", "absent_since": "Int64", "gone": "boolean"})


def observe(reads: DataFrame, version: str = "", of: Callable[[str], str | None] | None = None) -> DataFrame:
    """The ledger after all reads (source, at, outcome, rows of key and ident): one row for each source and key; times are epoch seconds.

    A source's reads stream through one task in order of time, sorted by the
    shuffle; only the state of one source is held.
    """

    def finished(source: int, state: State) -> pd.DataFrame:
        if of is not None:
            derive(state, version, of)
        return rows_of(int(source), state)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at_source, state = None, State()
        for frame in frames:
            for source, at, outcome, rows in zip(frame["source"], frame["at"], frame["outcome"], frame["rows"]):
                if at_source is not None and source != at_source:
                    yield finished(at_source, state)
                    state = State()
                at_source = source
                step(state, int(at), None if rows is None else [(r["key"], r["ident"]) for r in rows], outcome)
        if at_source is not None:
            yield finished(at_source, state)

    return reads.select("source", "at", "outcome", "rows").repartition("source").sortWithinPartitions("source", "at").mapInPandas(fold, SCHEMA)


def reads_of(rows: DataFrame, source: str, read_at: str, key: str, ident: str) -> DataFrame:
    """Reads from a table of listed rows: each moment at which a source lists anything is a good read."""
    listed = F.array_sort(F.collect_set(F.struct(F.col(key).alias("key"), F.col(ident).alias("ident"))))
    return rows.groupBy(F.col(source).alias("source"), F.unix_timestamp(read_at).alias("at")).agg(F.lit("ok").alias("outcome"), listed.alias("rows"))
