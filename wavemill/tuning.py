"""Index tunings, query options with their defaults, and the choice of a tuning under a budget."""

from __future__ import annotations

from dataclasses import dataclass

from wavemill.errors import InvalidTuning

# Match classes by bit error rate (below the bound), and the number of each class.
CLASSES = (("strong", 0, 0.15), ("likely", 1, 0.25), ("weak", 2, 0.35), ("none", 3, float("inf")))
# Limits of the indexes.
MAX_BAND_BITS, MAX_QBITS, MAX_ORDINAL, MAX_VALUES = 32, 24, 255, 65535
# What a tuning is assumed to cost. Values of a fingerprint, bytes of a posting and of a bucket.
VALUES_EACH, POSTING_BYTES, BUCKET_BYTES = 120, 6, 12
STRATEGIES = ("manual", "speed", "low_ram", "balanced")


@dataclass(frozen=True)
class BandTuning:
    """A value is cut into ``num_bands`` bands of ``bits_per_band`` bits, the lowest first."""

    num_bands: int = 4
    bits_per_band: int = 8

    def __post_init__(self):
        if self.num_bands < 1 or self.bits_per_band < 1 or self.num_bands * self.bits_per_band > MAX_BAND_BITS:
            raise InvalidTuning(f"{self.num_bands} bands of {self.bits_per_band} bits")

    @property
    def buckets_per_band(self) -> int:
        return 1 << self.bits_per_band

    @property
    def total_buckets(self) -> int:
        return self.num_bands * self.buckets_per_band


@dataclass(frozen=True)
class PostingTuning:
    """Every ``stride``-th value is indexed without its ``qbits`` low bits; every ``skip_interval``-th bucket is in
    the skip directory."""

    stride: int = 8
    qbits: int = 2
    skip_interval: int = 64

    def __post_init__(self):
        if self.stride < 1 or not 0 <= self.qbits <= MAX_QBITS or self.skip_interval < 1:
            raise InvalidTuning(str(self))

    @classmethod
    def of(cls, stride: int = 0, qbits: int = 0, skip_interval: int = 0) -> PostingTuning:
        """As configured: a stride or skip interval of 0 means the default, 0 ``qbits`` mean none."""
        return cls(stride or cls.stride, qbits, skip_interval or cls.skip_interval)


def _or(value: float | None, default: float):
    return value if value is not None and value > 0 else default


@dataclass(frozen=True)
class QueryOptions:
    """Options of the band query; what isn't positive means the default. Metadata come without any options, and with
    options only if they are asked for."""

    max_candidates: int | None = None
    min_match_threshold: int | None = None
    max_bit_error_rate: float | None = None
    include_metadata: bool = False

    @property
    def candidates(self) -> int:
        return int(_or(self.max_candidates, 100))

    @property
    def threshold(self) -> int:
        """Matches a candidate needs; 0: adaptive, by the length of the query."""
        return int(_or(self.min_match_threshold, 0))

    @property
    def error_rate(self) -> float:
        return float(_or(self.max_bit_error_rate, 0.35))


#: What holds where no options are given.
DEFAULTS = QueryOptions(include_metadata=True)


@dataclass(frozen=True)
class HitOptions:
    """Options of the full query; what isn't positive means the default."""

    min_hits: int | None = None
    top_k: int | None = None

    @property
    def hits(self) -> int:
        return int(_or(self.min_hits, 3))

    @property
    def k(self) -> int:
        return int(_or(self.top_k, 100))


def grid(record_count: int) -> list[dict]:
    """Every allowed tuning with its estimated size, memory and scores, bits before bands."""
    out = []
    for bits in range(4, 17):
        for bands in range(1, 9):
            if bands * bits > MAX_BAND_BITS:
                continue
            ram = bands * (1 << bits) * BUCKET_BYTES
            size = ram + record_count * VALUES_EACH * bands * POSTING_BYTES
            scores = {"manual": -10 * abs(bands - 4) - 10 * abs(bits - 8), "speed": 100 * bands - 10 * bits, "low_ram": -bands * (1 << bits), "balanced": 50 * bands - (size >> 20)}
            out.append({"bands": bands, "bits": bits, "est_ram": ram, "est_size": size, **scores})
    return out


def auto_tune(record_count: int, strategy: str = "manual", available_ram: int = 0, storage_budget: int = 0) -> BandTuning:
    """The first tuning of the best score that keeps to the budgets (0: no limit); 4 bands of 8 bits if none does."""
    if strategy not in STRATEGIES:
        raise InvalidTuning(strategy)
    fits = [g for g in grid(record_count) if not (storage_budget and g["est_size"] > storage_budget) and not (available_ram and g["est_ram"] > available_ram)]
    best = max(fits, key=lambda g: g[strategy], default=None)
    return BandTuning(best["bands"], best["bits"]) if best else BandTuning()
