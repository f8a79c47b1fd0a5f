"""Settings, passed to the plans as one frozen value."""

from __future__ import annotations

from dataclasses import dataclass, field

# Attribute names, range edges and labels.
ATTRS = (
    "toxicity",
    "severe_toxicity",
    "identity_attack",
    "insult",
    "threat",
    "profanity",
    "sexually_explicit",
    "flirtation",
)
EDGES = (0.0, 0.25, 0.5, 0.75, 1.0)
LABELS = ("0-0.25", "0.25-0.5", "0.5-0.75", "0.75-1.0")


@dataclass(frozen=True)
class Retry:
    """Back-off on a busy service: ``base * 2**attempt`` seconds between attempts."""

    attempts: int = 5
    base: float = 1.0


@dataclass(frozen=True)
class Pace:
    """At most one request per ``interval`` seconds over all ``lanes`` together.

    The work is spread over ``lanes`` partitions, each waiting ``interval * lanes``
    after a request, so the rate holds however many lanes run at a time. With a ``start``
    (seconds since 1970) every request has a slot of its own, counted from there.
    """

    interval: float = 1.05
    lanes: int = 4
    start: float | None = None


@dataclass(frozen=True)
class Config:
    edges: tuple[float, ...] = EDGES
    labels: tuple[str, ...] = LABELS
    attributes: tuple[str, ...] = ATTRS
    range_size: int = 6250  # rows per range; 0 means all rows
    class_threshold: float = 0.5
    seed: int = 42
    chunk_chars: int = 512
    sequence_length: int = 512
    new_tokens: int = 20
    batch_size: int = 16
    concurrency: int = 5  # collector calls running at a time
    in_flight: int = 5  # of these, calls running in one task
    rounds: int = 3  # tries of the collector for a prompt that fails
    slice_rows: int = 1000  # replies and scores committed at a time where calls are slow
    commit_seconds: float = 60.0  # time between commits where they are fast
    retry: Retry = field(default_factory=Retry)
    pace: Pace | None = field(default_factory=Pace)
