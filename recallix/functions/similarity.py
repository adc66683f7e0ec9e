"""Likeness of two strings, for the Python side of Arrow-batched functions."""

from __future__ import annotations


def common_subsequence(a: str, b: str) -> int:
    """The length of the longest common subsequence, by bit-parallel addition."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = s = (1 << len(a)) - 1
    for c in b:
        u = s & at.get(c, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths; 0 if either is empty."""
    return 2 * common_subsequence(a, b) / (len(a) + len(b)) if a and b else 0.0
