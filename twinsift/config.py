"""Modes and constants of hashing and querying; both sides of a lookup must use the same mode."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Mode:
    name: str
    samples: int
    tables: int
    band: int
    threshold: float
    identifiers: int
    graphlet: int
    literals: int | None
    sequences: int | None
    sequence_lengths: tuple[int, ...] = (3,)
    sequence_stride: int = 1
    min_size: int | None = None
    stem: bool = False  # identifiers as stems
    least_docs: int = 1  # documents that a feature must have to be kept at extraction


# Results depend on them.
FILE = Mode("file", 160, 20, 8, 0.6456707644812872, 194, 548, 264, None, min_size=500)
FUNC = Mode("func", 256, 32, 8, 0.592, 535, 5707, None, 369)


def mode(name: str) -> Mode:
    for m in (FILE, FUNC):
        if m.name == name:
            return m
    raise ValueError(f"unknown mode {name!r}: file or func")
