"""Band plans for Hamming radius joins.

Multi-index hashing (Norouzi, Punjani, Fleet, CVPR 2012) with the general
pigeonhole principle: cut the 64 bits into bands and give band i a limit t_i
with sum(t_i) = radius - bands + 1. Two hashes within the radius then agree to
within t_i bits in at least one band, for if every band differed by t_i + 1 or
more bits the total would exceed the radius.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

HASH_BITS = 64
# Shuffling one probe or index row costs about as much as testing this many pairs.
_ROW_COST = 30
_MOST_PROBES = 20_000


def _signed(bits: int) -> int:
    return bits - (1 << HASH_BITS) if bits >> (HASH_BITS - 1) else bits


@dataclass(frozen=True)
class BandPlan:
    """Widths and limits of the bands; a limit of -1 leaves its band unused."""

    radius: int
    widths: tuple[int, ...]
    limits: tuple[int, ...]

    def __post_init__(self) -> None:
        if sum(self.widths) != HASH_BITS:
            raise ValueError("bands must cover all 64 bits")
        capped = any(t >= w for t, w in zip(self.limits, self.widths))
        if not capped and sum(self.limits) < self.radius - len(self.widths) + 1:
            raise ValueError("limits too small: pairs within the radius would be missed")

    @classmethod
    def balanced(cls, radius: int, bands: int) -> BandPlan:
        width, wider = divmod(HASH_BITS, bands)
        limit, higher = divmod(radius - bands + 1, bands)
        widths = tuple(width + (i < wider) for i in range(bands))
        limits = tuple(max(-1, min(limit + (i < higher), widths[i])) for i in range(bands))
        return cls(radius, widths, limits)

    @classmethod
    def for_sizes(cls, radius: int, probing: int, indexed: int) -> BandPlan:
        """Cheapest balanced plan for so many hashes on either side."""
        if not 0 <= radius <= HASH_BITS:
            raise ValueError("radius must lie between 0 and 64")
        plans = [cls.balanced(radius, bands) for bands in range(1, min(radius, 15) + 2)]
        fitting = [p for p in plans if p.probes <= _MOST_PROBES] or [min(plans, key=lambda p: p.probes)]
        return min(fitting, key=lambda p: p.cost(probing, indexed))

    @property
    def used(self) -> list[int]:
        return [i for i, limit in enumerate(self.limits) if limit >= 0]

    def _probes_of(self, band: int) -> int:
        return sum(comb(self.widths[band], k) for k in range(self.limits[band] + 1))

    @property
    def probes(self) -> int:
        """Probe rows per hash."""
        return sum(self._probes_of(i) for i in self.used)

    @property
    def pair_share(self) -> float:
        """Share of all pairs tested when hashes are random."""
        return sum(self._probes_of(i) / 2 ** self.widths[i] for i in self.used)

    def cost(self, probing: int, indexed: int) -> float:
        rows = probing * self.probes + indexed * len(self.used)
        return rows * _ROW_COST + probing * indexed * self.pair_share

    def _offset(self, band: int) -> int:
        return sum(self.widths[:band])

    def mask(self, band: int) -> int:
        """Bits of a band, as a signed 64-bit value."""
        return _signed(((1 << self.widths[band]) - 1) << self._offset(band))

    def flips(self, band: int) -> list[int]:
        """Every change of at most the limit's number of bits within a band."""
        positions = range(self._offset(band), self._offset(band) + self.widths[band])
        return [
            _signed(sum(1 << p for p in chosen))
            for k in range(self.limits[band] + 1)
            for chosen in combinations(positions, k)
        ]
