"""Wagner-Fischer alignment of turns with the alternating grammar ``(s?(ua)+)?``.

Turns are codes: ``U``, ``A``, ``S`` or any other number. The target strings of all feasible lengths end alike, so one
table of costs from a turn and a rest of the target to their ends serves every length.
A stretch of a longer conversation is aligned from one state of the grammar to another.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

U, A, S, OTHER = range(4)
#: States of the grammar: nothing yet, after the system turn, expecting a user, expecting an assistant; and its end.
START, SYSTEM, USER, ASSISTANT, END = range(5)
DELETE, CHANGE, INSERT, TRUNCATED = 3, 2, 2, 1
FAR = 1 << 29


@dataclass
class Turns:
    """Turns that may stay, and how many that must go stand before each of them and at the end."""

    codes: list[int]
    cut: list[int]
    before: list[int]

    @staticmethod
    def of(codes: list[int], cut: list[int], gone: list[bool]) -> Turns:
        turns = Turns([], [], [0])
        for code, short, out in zip(codes, cut, gone):
            if out:
                turns.before[-1] += 1
            else:
                turns.codes.append(code)
                turns.cut.append(short)
                turns.before.append(0)
        return turns


def incumbent(turns: Turns, state: int, phase: int, least: int, last: bool) -> int:
    """The cost of a plain repair: up to three turns put in front, up to two left out, the rest renamed."""
    codes, best = np.array(turns.codes, np.int64), FAR
    for put in range(4):
        for out in range(min(2, len(codes)) + 1):
            rest = len(codes) - out
            if put + rest < least or (state + put + rest - phase) % 2 or (put and not rest and not last):
                continue
            wanted = (state + put + np.arange(rest)) % 2
            best = min(best, INSERT * put + DELETE * out + sum(turns.cut[out:]) + CHANGE * int((codes[out:] != wanted).sum()))
    return best


class Table:
    """Costs from turn ``i`` and ``r`` symbols left up to the end, which expects ``phase``.

    Whoever has ``r`` symbols left for ``n - i`` turns pays for the difference, so no alignment that costs
    ``most`` or less leaves the band of differences that ``most`` pays for. Unless the stretch
    is the last one, insertions stand before a turn and never at its end.
    """

    def __init__(self, turns: Turns, phase: int, last: bool, most: int):
        n = len(turns.codes)
        self.turns, self.phase, self.last, self.n = turns, phase, last, n
        self.down = most // DELETE
        gaps = np.arange(-self.down, most // INSERT + 1)
        row = np.where(gaps == 0, 0, np.where((gaps > 0) & last, INSERT * gaps, FAR)).astype(np.int32)
        rows = [row]
        for i in range(n - 1, -1, -1):
            left = n - i + gaps
            same = (phase - left) % 2 == turns.codes[i]
            kept = row + np.where(same, 0, CHANGE) + turns.cut[i]
            deleted = np.append(row[1:], FAR) + DELETE
            row = np.where(left > 0, np.minimum(kept, deleted), np.where(left == 0, deleted, FAR))
            row = np.minimum(np.minimum.accumulate(row - INSERT * gaps) + INSERT * gaps, FAR).astype(np.int32)
            rows.append(row)
        self.rows = [r.tolist() for r in reversed(rows)]
        self.width = len(gaps)

    def cost(self, i: int, left: int) -> int:
        at = left - (self.n - i) + self.down
        return self.rows[i][at] if 0 <= at < self.width and left >= 0 else FAR

    def lengths(self, i: int, parity: int, least: int) -> range:
        """Rests of the target that the band holds at turn ``i``."""
        low = max(least, self.n - i - self.down)
        return range(low + (low - parity) % 2, self.n - i - self.down + self.width, 2)

    def audit(self, i: int, left: int) -> str:
        """The ASCII-least of the cheapest edits from here on; deletions that are due come first."""
        turns, out = self.turns, ["D" * self.turns.before[i]]
        while i < self.n or left:
            cost = self.cost(i, left)
            if i < self.n and self.cost(i + 1, left) + DELETE == cost:
                i, edit = i + 1, "D"
            elif left and (i < self.n or self.last) and self.cost(i, left - 1) + INSERT == cost:
                out.append("I")
                left -= 1
                continue
            else:
                edit = "K" if (self.phase - left) % 2 == turns.codes[i] else "R"
                i, left = i + 1, left - 1
            out.append(edit + "D" * turns.before[i])
        return "".join(out)


def all_deleted(turns: Turns) -> str:
    return "D" * (len(turns.codes) + sum(turns.before))


def system_kept(turns: Turns, i: int) -> str:
    """Everything before turn ``i`` goes, turn ``i`` stays."""
    return "D" * (i + sum(turns.before[:i + 1])) + "K"


def through(turns: Turns, table: Table, state: int, goal: int) -> tuple[int, str] | None:
    """The cheapest edits from ``state`` to ``goal``, one of USER, ASSISTANT or END, over all lengths."""
    phase = 1 if goal == ASSISTANT else 0
    if state in (USER, ASSISTANT):
        options = [(table.cost(0, r), 0, r) for r in table.lengths(0, phase - (state == ASSISTANT), 0)]
    else:
        options = [(table.cost(0, r), 0, r) for r in table.lengths(0, phase, 2 - phase)]
    if state == START:
        if goal == END:
            options.append((table.cost(0, 0), 0, 0))
        for i, code in enumerate(turns.codes):
            if code == S:
                paid = DELETE * i + turns.cut[i]
                options += [(paid + table.cost(i + 1, r), i + 1, r) for r in table.lengths(i + 1, phase, 2 - phase)]
    least = min((o[0] for o in options), default=FAR)
    if least >= FAR:
        return None
    audits = [(system_kept(turns, i - 1) if i else "") + table.audit(i, r) for cost, i, r in options if cost == least]
    return least + DELETE * sum(turns.before), min(audits)


def stretches(turns: Turns, first: bool, last: bool) -> list[tuple[int, int, int, str]]:
    """(state, goal, cost, audit) of every way through a stretch of a conversation.

    Of the audits from one state, none is the beginning of another, so that comparing them settles the order of
    whole audits, whatever follows.
    """
    states = [START] if first else [START, SYSTEM, USER, ASSISTANT]
    found = []
    for goal in [END] if last else [USER, ASSISTANT]:
        phase = 1 if goal == ASSISTANT else 0
        bounds = {}
        for state in states:
            least = 0 if state >= USER else 2 - phase
            bounds[state] = incumbent(turns, state == ASSISTANT, phase, least, last)
        most = max((b for b in bounds.values() if b < FAR), default=None)
        if most is None:
            continue
        table = Table(turns, phase, last, most)
        for state, bound in bounds.items():
            way = through(turns, table, state, goal) if bound < FAR else None
            if way:
                found.append((state, goal, *way))
    if not last:
        gone = DELETE * (len(turns.codes) + sum(turns.before))
        found += [(s, s, gone, all_deleted(turns)) for s in states if s <= SYSTEM]
        kept = [(turns.cut[i], -i) for i, code in enumerate(turns.codes) if code == S]
        if kept:
            cut, at = min(kept)
            audit = system_kept(turns, -at)
            found.append((START, SYSTEM, gone - DELETE + cut, audit + "D" * (len(all_deleted(turns)) - len(audit))))
    return found


def align(codes: list[int], cut: list[int], gone: list[bool]) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    return stretches(Turns.of(codes, cut, gone), True, True)[0][2:]


def chain(ways: list[list[tuple[int, int, int, str]]]) -> tuple[int, list[int]]:
    """The cost of the cheapest ways through all stretches in order, of equal ones the ASCII-least, and their places."""
    rest, choice = {END: 0}, []
    for stretch in reversed(ways):
        best: dict[int, tuple[int, str, int]] = {}
        for at, (state, goal, cost, audit) in enumerate(stretch):
            if goal in rest:
                best[state] = min(best.get(state, (FAR << 20, "", -1)), (cost + rest[goal], audit, at))
        rest = {s: b[0] for s, b in best.items()}
        choice.append({s: b[2] for s, b in best.items()})
    state, places = START, []
    for stretch, taken in zip(ways, reversed(choice)):
        places.append(taken[state])
        state = stretch[taken[state]][1]
    return rest[START], places


def symbols(audit: str, system: bool, phase: int) -> str:
    """The role initial that each edit gives, ``-`` for a deletion."""
    out = []
    for edit in audit:
        if edit == "D":
            out.append("-")
        elif system:
            out.append("s")
            system = False
        else:
            out.append("ua"[phase])
            phase = 1 - phase
    return "".join(out)


def by_turn(audit: str) -> list[str]:
    """The edits of each turn: the insertions before it and its own; the last turn's also has those after it."""
    parts = re.findall("I*[DKR]", audit)
    parts[-1] += audit[sum(map(len, parts)):]
    return parts
