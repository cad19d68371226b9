"""The probe state machine of every item, kept in streaming state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FINAL = ("refresh_proven", "historical")


def _after(sessions: list[tuple[int, str, str]], base: int, limit: int) -> int | None:
    """The position of the first session that ends the item, ``base`` of which stand before them, if there is one."""
    return next((k for k, (_, kind, _) in enumerate(sessions) if kind in FINAL or (kind == "timeout" and base + k + 1 >= limit)), None)


def track(stream: DataFrame, key: str, session: str, order: str, outcome: str, limit: int, delay: int | None = None) -> DataFrame:
    """``(key, state, attempts, session, late)`` whenever an item's state is touched.

    Whatever the order in which sessions arrive, an item's last row equals ``merge_sessions`` over all its
    probes: a session counts once, by its last probe, sessions are taken by number, and the first
    that ends the item stands. As a session may still get a later probe, all of them stay open in
    the item's state.

    With a ``delay``, in units of ``order``, sessions that lie further behind the item's newest probe are
    closed and only their count and last outcome are kept, so that state is bounded by the sessions of one delay. An item
    whose end is closed keeps one small tuple. A probe behind the closed sessions is given as a row of its own with ``late``
    and no state, and counts no more, unless its session is open; a session must not last longer than the delay.
    Repeated probes change nothing; those without a session or number are left out, as is a null outcome.
    """
    if limit < 1 or (delay is not None and delay < 0):
        raise ValueError("an item has at least one attempt, and a delay isn't negative")

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, kind, name, closed, ended, newest, *columns = state.get if state.exists else (0, None, None, None, False, None, [], [], [])
        held = {s: (at, o) for at, o, s in zip(*columns, strict=True)}
        late: set[str] = set()
        for rows in batches:
            for s, at, o in zip(rows[session], rows[order].astype("int64"), rows[outcome], strict=True):
                newest = int(at) if newest is None else max(newest, int(at))
                if closed is not None and at <= closed and s not in held:
                    late.add(s)
                elif not ended:
                    held[s] = max(held.get(s, (-1 << 63, "")), (int(at), o))
        sessions = sorted((at, o, s) for s, (at, o) in held.items())
        end = _after(sessions, count, limit)
        counted = sessions if end is None else sessions[: end + 1]
        attempts, now, of = (count + len(counted), *counted[-1][1:]) if counted else (count, kind, name)
        old = 0 if delay is None else sum(at < newest - delay for at, _, _ in sessions)
        if old:
            ended = end is not None and end < old
            last = end if ended else old - 1
            count, (closed, kind, name) = count + last + 1, sessions[last]
            sessions = [] if ended else sessions[old:]
        state.update((count, kind, name, closed, ended, newest, *([x[c] for x in sessions] for c in range(3))))
        if now == "timeout":
            now = "terminal" if attempts >= limit else "retryable"
        found = [(k[0], now, attempts, of, False)] + [(k[0], None, None, s, True) for s in sorted(late)]
        out = pd.DataFrame(found, columns=[key, "state", "attempts", "session", "late"])
        yield out.astype({"attempts": "Int32"})

    whole = stream.filter(F.col(session).isNotNull() & F.col(order).isNotNull() & F.col(outcome).isNotNull())
    kept = "count int, kind string, name string, closed long, ended boolean, newest long, orders array<long>, outcomes array<string>, sessions array<string>"
    return whole.groupBy(key).applyInPandasWithState(step, f"{key} long, state string, attempts int, session string, late boolean", kept, "update", GroupStateTimeout.NoTimeout)
