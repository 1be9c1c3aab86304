"""Options of a scan, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class Reading:
    """Which reads count, and what makes a signal."""

    min_mapq: int = 20
    include_duplicates: bool = False
    min_clip_len: int = 20
    min_short_clip_len: int = 15
    min_clip_quality: int = 20
    polya_min_len: int = 10
    polya_min_frac: float = 0.8

    def __post_init__(self) -> None:
        _check(0 <= self.min_mapq <= 255, "min_mapq lies within 0 and 255")
        _check(self.min_clip_len >= 1 and self.min_short_clip_len >= 1 and self.polya_min_len >= 1, "lengths are 1 at least")
        _check(0 < self.polya_min_frac <= 1, "polya_min_frac lies above 0, at most 1")

    @property
    def overhang(self) -> int:
        return min(self.min_clip_len, self.min_short_clip_len)


@dataclass(frozen=True)
class Calling:
    """How signals are clustered, and which candidates pass."""

    window: int = 100
    min_support: int = 3
    min_clips: int = 2
    require_tail: bool = False
    min_typed_clips: int = 2
    min_mei_mate_fraction: float = 0.3
    min_signal_ratio: float = 0.05
    profile: str = "exome"
    min_qual: int | None = None
    probe_edge_tolerance: int = 2
    keep_filtered: bool = False

    def __post_init__(self) -> None:
        _check(self.window >= 1 and self.min_support >= 1 and self.min_clips >= 1, "window, min_support and min_clips are 1 at least")
        _check(0 <= self.min_mei_mate_fraction <= 1, "min_mei_mate_fraction lies within 0 and 1")
        _check(0 <= self.min_signal_ratio < float("inf"), "min_signal_ratio is 0 or more")
        _check(self.profile in ("exome", "discovery"), "profile is exome or discovery")

    @property
    def least_quality(self) -> int:
        """An explicit minimum wins over that of the profile."""
        return self.min_qual if self.min_qual is not None else {"exome": 10, "discovery": 0}[self.profile]


@dataclass(frozen=True)
class Options:
    """All of a scan. ``allow_no_reference`` lets the profile exome go without one."""

    padding: int = 300
    region: str | None = None
    allow_no_reference: bool = False
    reading: Reading = field(default_factory=Reading)
    calling: Calling = field(default_factory=Calling)

    def __post_init__(self) -> None:
        _check(self.padding >= 0, "padding is 0 or more")
        if self.region is not None:
            parse_region(self.region)


def examples(names: list[str], most: int = 5) -> str:
    """The first few names, for a message; a mark stands for the others."""
    return ", ".join(names[:most]) + (", ..." if len(names) > most else "")


def parse_region(text: str) -> tuple[str, int | None, int | None]:
    """``chr`` or ``chr:a-b`` (1-based, inclusive, commas allowed) as contig and 0-based half-open span.

    A suffix without a hyphen is part of the name.
    """
    name, colon, span = text.rpartition(":")
    if not colon or "-" not in span:
        _check(bool(text), "a region has a name")
        return text, None, None
    low, _, high = span.replace(",", "").partition("-")
    _check(low.isdigit() and high.isdigit(), f"{text}: not a region")
    start, end = int(low), int(high)
    _check(bool(name) and 1 <= start <= end, f"{text}: a region begins at 1 at least, and not after its end")
    return name, start - 1, end
