"""Keyed state of the monitors: panes of sliding windows and rings of hourly baselines.

Both need the RocksDB state store (``streams.rocksdb``) and event-time timers. State is read and written as whole lists, a
round trip each, and the numbers are worked out in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ListState

from tradelens.operators.market import HALF_HOUR

HOUR = 3600


def replace(state: ListState, frame: pd.DataFrame) -> None:
    """The rows of ``frame``, whole numbers, as all that ``state`` holds."""
    if frame.empty:
        state.clear()  # a list must not be empty
    else:
        state.put([tuple(map(int, r)) for r in frame.itertuples(index=False)])


class Panes(StatefulProcessor):
    """Per market the wallet sums of each slice of time, from which all windows are added up that the watermark has closed.

    One state row a slice and wallet. A slice leaves when the last window that holds it has been sent; until then one timer
    stands at the end of the next window.
    """

    def __init__(self, size: int, slide: int):
        self.size, self.slide = size, slide

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("panes", "pane long, wallet long, v long, buy long, n long")
        self.sent = handle.getValueState("sent", "end long")

    def _due(self, key, rows: pd.DataFrame, watermark: int) -> Iterator[pd.DataFrame]:
        """The windows that end after those sent and not after the watermark, and the state and timer for the rest."""
        before = self.sent.get()[0] if self.sent.exists() else None
        each = pd.concat([rows.assign(end=rows["pane"] + k) for k in range(self.slide, self.size + 1, self.slide)])
        open_ = each if before is None else each[each["end"] > before]
        closed = open_[open_["end"] <= watermark]
        if len(closed):
            self.sent.update((int(closed["end"].max()) if before is None else max(before, int(closed["end"].max())),))
        left = rows[rows["pane"] + self.size > watermark]
        replace(self.rows, left)
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if len(left):
            self.handle.registerTimer(int(open_.loc[open_["end"] > watermark, "end"].min()) * 1000)
        if len(closed):
            own = closed.groupby(["end", "wallet"], as_index=False)[["v", "buy", "n"]].sum().sort_values(["end", "v"])
            own["ranked"] = own["v"] * (own.groupby("end").cumcount() + 1)
            own["square"] = own["v"].astype(float) ** 2
            own["top"] = own["v"].where(own.groupby("end").cumcount(ascending=False) < 3, 0)
            out = own.groupby("end").agg(
                volume_c=("v", "sum"), buy_c=("buy", "sum"), traders=("v", "size"), trades=("n", "sum"), square=("square", "sum"), ranked=("ranked", "sum"), top_c=("top", "sum")
            ).reset_index()
            out = out.assign(condition_id=int(key[0]), w=out["end"] - self.size, sell_c=out["volume_c"] - out["buy_c"])
            yield out[[x.split()[0] for x in PANE_ROWS.split(", ")]]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))[NAMES]
        yield from self._due(key, pd.concat([self._held(), new]), timerValues.getCurrentWatermarkInMs() // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._due(key, self._held(), timerValues.getCurrentWatermarkInMs() // 1000)

    def _held(self) -> pd.DataFrame:
        return pd.DataFrame(list(self.rows.get()), columns=NAMES, dtype="int64")

    def close(self) -> None:
        pass


NAMES = ["pane", "wallet", "v", "buy", "n"]
PANE_ROWS = (
    "condition_id int, w long, volume_c long, buy_c long, sell_c long, traders long, trades long, square double, ranked long, top_c long"
)


class Ring(StatefulProcessor):
    """Per market the points of the last hours; each closed window is judged by the hours before its own.

    The point of an hour is its last half hour, and hours without trades are points of zero, which need no rows. Points leave the
    state when they are too old for any window to come; the market's first hour stays.
    """

    NAMES = ("volume_c", "traders", "trades")

    def __init__(self, points: int):
        self.points = points

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "hour long")
        self.ring = handle.getListState("ring", "hour long, volume_c long, traders long, trades long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("w", ignore_index=True)
        hours = new["w"] // HOUR * HOUR
        first = min(int(hours.iloc[0]), self.first.get()[0] if self.first.exists() else int(hours.iloc[0]))
        self.first.update((first,))
        old = pd.DataFrame(list(self.ring.get()), columns=["hour", *self.NAMES])
        last_half = new[new["w"] - hours == HALF_HOUR]
        now = pd.concat([old, last_half[list(self.NAMES)].assign(hour=hours[last_half.index])[["hour", *self.NAMES]]]).sort_values("hour")
        keep = now[now["hour"] >= int(hours.iloc[-1]) - HOUR * self.points]
        replace(self.ring, keep)
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer((int(hours.iloc[-1]) + HOUR * (self.points + 2)) * 1000)
        at = now["hour"].to_numpy(dtype=np.int64)
        low, high = np.searchsorted(at, hours - HOUR * self.points), np.searchsorted(at, hours)
        n = np.minimum(self.points, (hours - first) // HOUR).astype(int)
        out = new.assign(points=n)
        for name, z in zip(self.NAMES, ("volume_z", "trader_z", "velocity_z")):
            # whole numbers of any size, as in the batch form
            point = np.array([0, *map(int, now[name])], dtype=object)
            sums, squares = np.cumsum(point), np.cumsum(point * point)
            s, square, v = sums[high] - sums[low], squares[high] - squares[low], np.array(list(map(int, new[name])), dtype=object)
            over, spread = n.to_numpy().astype(object) * v - s, n.to_numpy().astype(object) * square - s * s
            out[z] = [float(a) / float(b) ** 0.5 if b > 0 else 0.0 for a, b in zip(over, spread)]
        yield out.drop(columns=["at"], errors="ignore")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.ring.clear()
        yield from ()

    def close(self) -> None:
        pass
