"""Choice of a join strategy from sizes and observed skew."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.radix import lg_ceil

STRATEGIES = ("broadcast", "shuffle_hash", "merge", "skew", "salt")
#: Bytes of the primary side that a worker may hold, unless the caller says otherwise.
DEFAULT_BUDGET = 64 << 20
#: Bytes that are never broadcast, whoever asks: Spark's own limit is 8 GB.
BROADCAST_LIMIT = 2 << 30
#: Bytes of a row of the primary side that stay in memory.
ROW_BYTES = 16
#: Heap that ROW_BYTES of a broadcast take at most: the rows collected, a hash table that doubles as it grows, and its
#: blocks, in half of the heap.
HEAP_A_BYTE = 16
#: Foreign rows for each primary row from which skew is worth handling.
SKEW_RATIO = 3


@dataclass(frozen=True)
class Decision:
    strategy: str
    radix: int
    primary_bytes: int
    skewed: bool

    def describe(self) -> str:
        return f"strategy={self.strategy} partitions={1 << self.radix} primary_bytes={self.primary_bytes} skewed={self.skewed}"


def size_radix(primary_bytes: int, budget: int) -> int:
    """Bits of the partitioning: 0 as long as the primary side is under about 4/3 of the budget."""
    if primary_bytes * 5 < budget * 6:
        return 0
    return lg_ceil(max(1, primary_bytes * 3 // (budget * 2)))


def choose(primary_rows: int, foreign_rows: int, budget: int = DEFAULT_BUDGET, skewed: bool = False, strategy: str = "auto", row_bytes: int = ROW_BYTES, limit: int = BROADCAST_LIMIT, radix: int | None = None) -> Decision:
    """A named strategy skips both checks, but for the limit of a broadcast. A given radix is left as it is."""
    size = primary_rows * row_bytes
    bits = size_radix(size, budget) if radix is None else radix
    if strategy != "auto":
        if strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {strategy!r}: {', '.join(('auto', *STRATEGIES))}")
        if strategy == "broadcast" and size > limit:
            raise ValueError(f"{size} bytes are over the broadcast limit of {limit}")
        return Decision(strategy, bits, size, skewed)
    if bits == 0 and size <= limit:
        return Decision("broadcast", 0, size, skewed)
    if skewed and radix is None and worth_sampling(primary_rows, foreign_rows):
        return Decision("broadcast" if size <= min(limit, 4 * budget) else "skew", bits + 1, size, True)
    return Decision("shuffle_hash", bits, size, skewed)


def worth_sampling(primary_rows: int, foreign_rows: int) -> bool:
    """Whether skew of the foreign side would change a partitioned join."""
    return primary_rows > 0 and foreign_rows // primary_rows >= SKEW_RATIO
