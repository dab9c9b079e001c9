"""The engine's 64-bit hash on the driver, to name a term's bucket without a job."""

from __future__ import annotations

import xxhash


def spark_xxhash64(data: bytes, seed: int = 42) -> int:
    """XXH64 of the bytes with Spark's seed, as a signed long."""
    value = xxhash.xxh64_intdigest(data, seed)
    return value - (1 << 64) if value >> 63 else value
