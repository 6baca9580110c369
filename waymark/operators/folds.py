"""Operators that depend on the row before: a step is a small function of a state and a row.

A step takes (state, row) and returns (state, row's verdict); rows with a verdict go out with it.  `fold` runs
a step over a table: rows are dealt by key, sorted within their partition and streamed, so a key of any length
takes constant memory.  `waymark.streaming.stateful` runs the same steps over streams.

Defined results: rows with a null key form one key; an empty table gives an empty result; repeated rows are
rows of their own; a fix without coordinates or time is never kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

Step = Callable[[tuple | None, dict[str, Any]], tuple[tuple | None, Any]]


def _metres(lat1: float, lng1: float, lat2: float, lng2: float) -> float:
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lng2 - lng1) / 2) ** 2
    return 2 * 6371000.0 * math.asin(min(1.0, math.sqrt(a)))


def _located(row: dict) -> bool:
    return row["lat"] is not None and row["lng"] is not None and math.isfinite(row["lat"]) and math.isfinite(row["lng"])


def thin(metres: float) -> Step:
    """Fixes at least `metres` from the last one kept."""

    def step(state, row):
        if not _located(row) or state and _metres(*state, row["lat"], row["lng"]) < metres:
            return state, None
        return (row["lat"], row["lng"]), True

    return step


def verdict(box: dict[str, float], metres: float, accuracy: float) -> Step:
    """Why a fix is kept (first, moved) or not (manual, invalid, outside, accuracy, too-close)."""

    def step(state, row):
        if row["manual"]:
            return state, "manual"
        if not _located(row):
            return state, "invalid"
        if not (box["south"] < row["lat"] < box["north"] and box["west"] < row["lng"] < box["east"]):
            return state, "outside"
        if row["acc"] is not None and accuracy < row["acc"] < math.inf:
            return state, "accuracy"
        if state and _metres(*state, row["lat"], row["lng"]) < metres:
            return state, "too-close"
        return (row["lat"], row["lng"]), "moved" if state else "first"

    return step


def reports(confirm_ms: int = 5 * 60_000, statuses: tuple[str, ...] = ("open", "down")) -> Step:
    """What a report does to its ride: set, clear (a null status takes back one that stands), or nothing.

    An unknown status does nothing, nor does one that stands already and was set less than confirm_ms ago.
    """

    def step(state, row):
        if row["status"] is None:
            return None, "clear" if state else None
        if row["status"] not in statuses or state and state[0] == row["status"] and row["ms"] - state[1] < confirm_ms:
            return state, None
        return (row["status"], row["ms"]), "set"

    return step


def session_number(gap_ms: int) -> Step:
    """1 for the first session; a new one where time runs backwards or stands still for gap_ms."""

    def step(state, row):
        if state is None or row["ms"] < state[0] or row["ms"] - state[0] >= gap_ms:
            state = (row["ms"], (state[1] if state else 0) + 1)
        return (row["ms"], state[1]), state[1]

    return step


def newer() -> Step:
    """Rows later than all before them."""

    def step(state, row):
        return (state, None) if state and row["ms"] <= state[0] else ((row["ms"],), True)

    return step


def first_seen(reset_gap: int = 64) -> Step:
    """Frames above the sender's highest number; one that is far below begins a new run."""

    def step(state, row):
        fresh = state is None or row["number"] > state[0] or state[0] - row["number"] > reset_gap
        return ((row["number"],), True) if fresh else (state, None)

    return step


def rate_limit(window_ms: int, limit: int) -> Step:
    def step(state, row):
        bucket = row["ms"] // window_ms
        used = state[1] + 1 if state and state[0] == bucket else 1
        return (bucket, used), True if used <= limit else None

    return step


def send_gate(least_ms: int = 3000, metres: float = 12.0, degrees: float = 25.0, heartbeat_ms: int = 20000) -> Step:
    """Why a position is sent, compared with the last one sent: first, target, moved, turned or heartbeat."""

    def step(state, row):
        new = (row["ms"], row["target"], row["lat"], row["lng"], row["heading"])
        if state is None:
            return new, "first"
        ms, target, lat, lng, heading = state
        turn = abs((row["heading"] - heading + 180) % 360 - 180)
        if row["ms"] - ms < least_ms:
            return state, None
        why = "target" if row["target"] != target else "moved" if _metres(lat, lng, row["lat"], row["lng"]) >= metres else "turned" if turn >= degrees else "heartbeat" if row["ms"] - ms >= heartbeat_ms else None
        return (new, why) if why else (state, None)

    return step


def dwell(min_ms: int, min_samples: int) -> Step:
    """Marks the fix at which a stay at one target has lasted long enough, once a stay."""

    def step(state, row):
        if state is None or state[0] != row["target"]:
            state = (row["target"], row["ms"], 0, False)
        target, since, n, told = state
        n += 1
        reached = not told and target is not None and row["ms"] - since >= min_ms and n >= min_samples
        return (target, since, n, told or reached), since if reached else None

    return step


def smooth(max_acc: float = 80.0, max_speed: float = 12.0, chi2: float = 9.0, streak: int = 3, teleport: float = 2500.0) -> Step:
    """Constant-velocity Kalman filter on a plane at the first fix; both axes share one covariance (p, c, v).

    A fix is rejected if its accuracy is over max_acc, it lies farther than max_speed allows from the last estimate,
    or its squared Mahalanobis distance is over chi2; after `streak` rejections in a row the next one counts.  A
    jump over `teleport` metres, or a manual fix, starts anew.  A rejection for speed has moved the filter on but not
    its clock.  The verdict is "lat,lng" of the estimate, with a trailing "!" where the fix was rejected.
    """
    degree, least_acc, usual_acc, speed_variance, drift, push, least_s = 111320.0, 4.0, 25.0, 4.0, 0.6, 0.8, 0.2  # fixed values

    def said(out, rejected=False):
        return f"{out[0]:.6f},{out[1]:.6f}{'!' if rejected else ''}"

    def start(row, acc):
        anchor = (row["lat"], row["lng"], degree * max(math.cos(math.radians(row["lat"])), 0.01))
        out = (row["lat"], row["lng"])
        return (anchor, (0.0, 0.0, 0.0, 0.0), (acc * acc, 0.0, speed_variance), row["ms"], 0, out), said(out)

    def step(state, row):
        if not _located(row) or row["ms"] is None:
            return state, None
        if row.get("manual"):
            return None, said((row["lat"], row["lng"]))
        acc = max(least_acc, row["acc"] if row["acc"] is not None and math.isfinite(row["acc"]) else usual_acc)
        if state is None:
            return start(row, acc)
        anchor, (x, y, vx, vy), (p, c, v), ms, rejected, out = state
        if acc > max_acc and rejected < streak:
            return (anchor, (x, y, vx, vy), (p, c, v), ms, rejected + 1, out), said(out, True)
        far = _metres(*out, row["lat"], row["lng"])
        if far > teleport:
            return start(row, acc)
        dt = max((row["ms"] - ms) / 1000, least_s)
        x, y = x + vx * dt, y + vy * dt
        p, c, v = p + 2 * dt * c + dt * dt * v + (drift * dt) ** 2, c + dt * v, v + push * dt
        if far / dt > max_speed and rejected < streak:
            return (anchor, (x, y, vx, vy), (p, c, v), ms, rejected + 1, out), said(out, True)
        s = p + acc * acc
        dx, dy = (row["lng"] - anchor[1]) * anchor[2] - x, (row["lat"] - anchor[0]) * degree - y
        if (dx * dx + dy * dy) / s > chi2 and rejected < streak:
            return (anchor, (x, y, vx, vy), (p, c, v), row["ms"], rejected + 1, out), said(out, True)
        k, kv = p / s, c / s
        x, y, vx, vy = x + k * dx, y + k * dy, vx + kv * dx, vy + kv * dy
        p, c, v = (1 - k) * p, (1 - k) * c, v - kv * c
        out = (anchor[0] + y / degree, anchor[1] + x / anchor[2])
        return (anchor, (x, y, vx, vy), (p, c, v), row["ms"], 0, out), said(out)

    return step


def plain_rows(rows: pd.DataFrame) -> Iterator[dict[str, Any]]:
    """The rows as dicts of Python values; a table's columns are turned once, not cell by cell."""
    columns = [rows[c].astype(object).where(rows[c].notna(), None).tolist() for c in rows.columns]
    return (dict(zip(rows.columns, values, strict=True)) for values in zip(*columns, strict=True))


def applied(step: Step, state: tuple | None, rows: pd.DataFrame) -> tuple[tuple | None, list[Any]]:
    verdicts = []
    for row in plain_rows(rows):
        state, verdict = step(state, row)
        verdicts.append(verdict)
    return state, verdicts


def with_verdict(rows: pd.DataFrame, verdicts: list[Any], name: str) -> pd.DataFrame:
    out = rows[[v is not None for v in verdicts]].assign(**{name: [v for v in verdicts if v is not None]})
    return out.astype({c: object for c in out.columns if isinstance(out[c].dtype, pd.StringDtype)})  # text in chunks can't be handed to Arrow


def fold(df: DataFrame, keys: list[str], order: list[str], step: Step, name: str, kind: str) -> DataFrame:
    """Rows of df that the step tells something about, with that in column `name` of type `kind`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            verdicts = []
            for row in plain_rows(batch):  # the rows of a key come one after the other
                if (key := tuple(row[k] for k in keys)) != now:
                    now, state = key, None
                state, verdict_of_row = step(state, row)
                verdicts.append(verdict_of_row)
            if len(told := with_verdict(batch, verdicts, name)):
                yield told

    schema = ", ".join(f"`{c}` {t}" for c, t in [*df.dtypes, (name, kind)])
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
