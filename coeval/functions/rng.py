"""Counter-based random numbers.

``uniform`` depends only on its arguments, so a draw is the same whatever the
partitioning, the number of executors or the number of retries. ``rand()``
gives no such promise and is not used anywhere in this package.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX_DIGITS = 12
_SCALE = float(16**_HEX_DIGITS)


def counter(*parts: object) -> Column:
    """48-bit integer derived from the ``|``-joined parts."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, _HEX_DIGITS), 16, 10).cast("bigint")


def uniform(*parts: object) -> Column:
    """Uniform double in [0, 1) for the given counter parts."""
    return counter(*parts).cast("double") / F.lit(_SCALE)


def permutation_domain(count: int) -> int:
    """Smallest power of four that holds ``count`` numbers: what ``permuted`` runs over."""
    return 1 << (2 * max(1, -(-max(1, count - 1).bit_length() // 2)))


def permuted(index: Column, domain: int, *parts: object) -> Column:
    """Number at ``index`` of a pseudorandom permutation of 0 .. domain - 1.

    Six Feistel rounds over the two halves of the number's bits, keyed by the
    parts. One to one for any round function, so no draw comes twice.
    """
    bits = (domain.bit_length() - 1) // 2
    mask = F.lit((1 << bits) - 1).cast("bigint")
    key = F.xxhash64(*[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    high, low = F.shiftright(index, bits), index.bitwiseAND(mask)
    for turn in range(6):
        high, low = low, high.bitwiseXOR(F.xxhash64(low, F.lit(turn), key).bitwiseAND(mask))
    return F.shiftleft(high, bits).bitwiseOR(low)


def derive_seed(*identity: object) -> int:
    """Stable unsigned 64-bit seed from a NUL-joined identity."""
    payload = "\0".join(str(part) for part in identity)
    return int.from_bytes(hashlib.sha256(payload.encode("utf-8")).digest()[:8], "little")
