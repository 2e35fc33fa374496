"""Options of the operators, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class IndexOptions:
    """epsilon: largest error of a predicted position; values below 1 count as 1. exact: the
    segments are those of a single greedy pass over all keys, block after block."""

    epsilon: int = 32
    exact: bool = False

    def __post_init__(self):
        object.__setattr__(self, "epsilon", max(1, int(self.epsilon)))


@dataclass(frozen=True)
class SequenceOptions:
    """block: values in a block. penalty: weight of an exception against 64 bits, 1 to 255."""

    block: int = 128
    penalty: int = 2

    def __post_init__(self):
        if self.block < 1:
            raise ValueError("block must be at least 1")
        if not 1 <= self.penalty <= 255:
            raise ValueError("penalty must be from 1 to 255")


@dataclass(frozen=True)
class MapOptions:
    """group: addresses in a group. epsilon: tolerance of the line fit. direct: groups of so many entries or fewer are
    stored without segments. capacity: addresses from it on do not exist, None for no limit. unsigned: encoded values
    are unsigned 64-bit numbers, DECIMAL columns, instead of LONGs from 0 up."""

    group: int = 4096
    epsilon: int = 512
    direct: int = 8
    skip: int = 4
    capacity: int | None = None
    unsigned: bool = False
