"""Content-selected word positions: minimisers.

A gram is GRAM consecutive words of one document. Of every SPAN consecutive grams the one with the least hash is
selected, the leftmost of equals. So each run of SPAN + GRAM - 1 words selects a position inside itself by its content
alone, and equal runs, wherever they stand, select the same one. About two in SPAN + 1 positions are selected.
"""

from __future__ import annotations

import numpy as np

from heronry.llm import buffers as B

GRAM = 6
SPAN = 15
#: Words in which a selected gram is certain to lie.
REACH = SPAN + GRAM - 1


def minimisers(sums: B.Windows, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run of REACH words in one document: its start, and the start of the gram it selects."""
    runs = B.whole_windows(doc, REACH)
    if not len(runs):
        return runs, runs
    grams = sums.get(np.arange(len(doc) - GRAM + 1), GRAM)
    best = grams[: len(grams) - SPAN + 1].copy()
    at = np.arange(len(best))
    for k in range(1, SPAN):
        other = grams[k : k + len(best)]
        less = other < best
        best[less] = other[less]
        at[less] = np.flatnonzero(less) + k
    return runs, at[runs]
