"""Replay of a project's edit log: order of pages, what is shown, undo and redo."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

#: Steps that can be undone.
HISTORY = 30


class Project:
    """Pages in order with those switched off, and two stacks of earlier states."""

    def __init__(self, order: list[int], off: set[int], spread: dict[int, int]):
        self.order, self.off, self.spread = list(order), frozenset(off), spread
        self.undo: list[tuple] = []
        self.redo: list[tuple] = []

    def _state(self) -> tuple:
        return tuple(self.order), self.off

    def _restore(self, source: list[tuple], target: list[tuple]) -> str:
        if not source:
            return "unchanged"
        order, off = source[-1]
        if set(order) != set(self.order):
            return "rejected"
        source.pop()
        target.append(self._state())
        del target[:-HISTORY]
        self.order, self.off = list(order), off
        return "applied"

    def _set(self, order: list[int], off: frozenset) -> str:
        """A new state; what was undone before can't be redone any more."""
        if order == self.order and off == self.off:
            return "unchanged"
        self.undo.append(self._state())
        del self.undo[:-HISTORY]
        self.redo.clear()
        self.order, self.off = order, off
        return "applied"

    def apply(self, action: str, page, number, pages) -> str:
        """``applied``, ``unchanged`` or ``rejected``; a rejected edit changes nothing."""
        if action == "undo":
            return self._restore(self.undo, self.redo)
        if action == "redo":
            return self._restore(self.redo, self.undo)
        if action == "reorder":
            asked = [int(p) for p in pages] if pages is not None else []
            return self._set(asked, self.off) if sorted(asked) == sorted(self.order) else "rejected"
        if action == "swap":
            own = [i for i, p in enumerate(self.order) if self.spread[p] == number]
            if len(own) != 2:
                return "rejected"
            order = list(self.order)
            order[own[0]], order[own[1]] = order[own[1]], order[own[0]]
            return self._set(order, self.off)
        if action == "add":
            # Pages come and go with their history.
            if page in self.spread:
                return "rejected"
            at = len(self.order) if number is None else max(0, min(len(self.order), int(number)))
            self.order.insert(at, page)
            self.spread[page] = page
            self.undo.clear()
            self.redo.clear()
            return "applied"
        if page not in self.spread:
            return "rejected"
        if action == "toggle":
            return self._set(list(self.order), self.off ^ {page})
        if action == "move":
            rest = [p for p in self.order if p != page]
            at = max(0, min(len(rest), self.order.index(page) + int(number)))
            return self._set([*rest[:at], page, *rest[at:]], self.off)
        return "rejected"


def replay(pages: DataFrame, events: DataFrame, statuses: bool = False) -> DataFrame:
    """Pages of each project after its events, or with ``statuses`` the events and what became of them.

    ``pages`` has ``project, page, position, spread, enabled``, ``events``
    ``project, seq, action, page, number, pages``. Actions are toggle (page),
    move (page by number), swap (the two pages of the spread number), reorder
    (to pages, which must list every page once), add (page at number, which
    clears the history), undo and redo over at most ``HISTORY`` steps. A
    project and its log are one person's work and meet in one task.
    """

    def run(rows: pd.DataFrame, log: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position")
        off = set(rows.loc[~rows["enabled"], "page"])
        state = Project(rows["page"].tolist(), off, dict(zip(rows["page"], rows["spread"], strict=True)))
        name = (rows if len(rows) else log)["project"].iloc[0]
        said = []
        for seq, action, page, number, asked in log.sort_values("seq")[["seq", "action", "page", "number", "pages"]].itertuples(index=False):
            value = lambda x: None if pd.isna(x) else int(x)
            said.append((name, seq, action, state.apply(action, value(page), value(number), asked)))
        if statuses:
            return pd.DataFrame(said, columns=["project", "seq", "action", "status"])
        out = [(name, p, i, p not in state.off) for i, p in enumerate(state.order)]
        return pd.DataFrame(out, columns=["project", "page", "position", "enabled"])

    kind = "project string, seq long, action string, status string" if statuses else "project string, page long, position long, enabled boolean"
    return pages.groupBy("project").cogroup(events.groupBy("project")).applyInPandas(run, kind)
