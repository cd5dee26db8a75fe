"""Sliding-window admission of ordered times."""

from __future__ import annotations

import numpy as np


def admit(times: np.ndarray, held: np.ndarray, most: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the ascending ``times`` are admitted, and the admitted times that still count after them.

    ``held`` are admitted times before. A time is admitted while fewer than
    ``most`` admitted ones are at most ``window`` older. All free places are given
    at once, and refused times are skipped by a search for the first one after
    the oldest admitted time has left the window.
    """
    admitted = np.zeros(len(times), bool)
    if most <= 0:
        return admitted, held[:0]
    at = 0
    while at < len(times):
        held = held[np.searchsorted(held, times[at] - window) :]
        free = most - len(held)
        if free > 0:
            admitted[at : at + free] = True
            held = np.concatenate([held, times[at : at + free]])
            at += free
        else:
            at += int(np.searchsorted(times[at:], held[0] + window, "right"))
    return admitted, held
