"""Queues with a cool-down: what a saved document sets off, and how often."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def reactions(changes: DataFrame, seconds: int = 6 * 3600) -> DataFrame:
    """path, seq, action and wait of a stream of saves (path, seq, etag, at in seconds).

    A version is reacted to once (else `seen`); a save within the cool-down is `deferred` by the rest of it; one that a
    later save has overtaken is `dropped`.
    """

    def act(key: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seq, etag, last = state.get if state.exists else (-1, "", -(1 << 40))
        out = []
        for b in rows:
            for r in b.sort_values("seq").itertuples():
                wait = 0
                if r.seq <= seq:
                    action = "dropped"
                elif r.etag == etag:
                    action = "seen"
                elif r.at - last < seconds:
                    action, wait = "deferred", int(last + seconds - r.at)
                else:
                    action, etag, last = "react", r.etag, int(r.at)
                seq = max(seq, int(r.seq))
                out.append((key[0], int(r.seq), action, wait))
        state.update((seq, etag, last))
        yield pd.DataFrame(out, columns=["path", "seq", "action", "wait"])

    return changes.groupBy("path").applyInPandasWithState(act, "path string, seq long, action string, wait long", "seq long, etag string, last long", "append", "NoTimeout")


def spaced(raised: DataFrame, seconds: int = 7 * 86_400) -> DataFrame:
    """Of a stream of findings (pair, at in seconds) those that come at least so long after the pair's last kept one."""

    def act(key: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for at in sorted(int(x) for b in rows for x in b["at"]):
            if last is None or at - last >= seconds:
                last = at
                out.append((key[0], at))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["pair", "at"])

    return raised.groupBy("pair").applyInPandasWithState(act, "pair string, at long", "last long", "append", "NoTimeout")
