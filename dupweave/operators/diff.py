"""Token diff by shortest edit scripts, and the tokens that an edit makes new."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..functions import constants as C


@dataclass
class TokenDiff:
    """is_new by token of `after`; target of each token of `before` in `after`, or -1; capped: the middle wasn't aligned."""

    is_new: np.ndarray
    target: np.ndarray
    capped: bool = False


def _equal_lead(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differs = np.flatnonzero(a[:n] != b[:n])
    return int(differs[0]) if len(differs) else n


def diff_tokens(after: np.ndarray, before: np.ndarray, most: int = C.MAX_DIFF_DISTANCE) -> TokenDiff:
    """Equal ends first, then a greedy shortest edit script of what is between, up to `most` edits.

    Where insertion and deletion reach equally far, the deletion goes first, as results depend on it.
    """
    diff = TokenDiff(np.zeros(len(after), bool), np.full(len(before), -1, np.int64))
    lead = _equal_lead(after, before)
    rest = min(len(after), len(before)) - lead
    tail = _equal_lead(after[len(after) - rest :][::-1], before[len(before) - rest :][::-1])
    diff.target[:lead] = np.arange(lead)
    diff.target[len(before) - tail :] = np.arange(len(after) - tail, len(after))
    old, new = before[lead : len(before) - tail].tolist(), after[lead : len(after) - tail].tolist()
    if old and new:
        steps = _edit_script(old, new, most)
        if steps is not None:
            _apply(steps, lead, diff)
            return diff
        diff.capped = True
    diff.is_new[lead : len(after) - tail] = True
    return diff


def _edit_script(old: list[int], new: list[int], most: int) -> list[dict[int, int]] | None:
    """Furthest old index by diagonal (old - new index) after 0, 1, ... edits, until both ends are reached."""
    n, m = len(old), len(new)
    reached = {1: 0}
    history = []
    for edits in range(min(n + m, most) + 1):
        current: dict[int, int] = {}
        for diagonal in range(-edits, edits + 1, 2):
            down, right = reached.get(diagonal + 1, 0), reached.get(diagonal - 1, 0)
            x = down if diagonal == -edits or (diagonal != edits and right < down) else right + 1
            while x < n and x - diagonal < m and old[x] == new[x - diagonal]:
                x += 1
            current[diagonal] = x
            if x >= n and x - diagonal >= m:
                history.append(current)
                return history
        history.append(current)
        reached = current
    return None


def _apply(history: list[dict[int, int]], lead: int, diff: TokenDiff) -> None:
    """Walk the script back from its end: snakes map tokens, insertions make them new."""
    edits = len(history) - 1
    diagonal = next(reversed(history[-1]))
    x = history[-1][diagonal]
    while edits:
        before = history[edits - 1]
        down, right = before.get(diagonal + 1, 0), before.get(diagonal - 1, 0)
        inserts = diagonal == -edits or (diagonal != edits and right < down)
        start = down if inserts else right + 1
        while x > start:
            x -= 1
            diff.target[lead + x] = lead + x - diagonal
        if inserts:
            diff.is_new[lead + x - diagonal - 1] = True
            diagonal += 1
        else:
            x -= 1
            diagonal -= 1
        edits -= 1
    while x > 0:
        x -= 1
        diff.target[lead + x] = lead + x
