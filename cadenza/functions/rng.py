"""Counter-based uniforms: draws depend on seed and key only, never on partitioning.

The distributions are those of a seeded generator, the draws are not any generator's.
"""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int | str, *keys: Column) -> Column:
    """A double in [0, 1) from the first 32 bits of md5(seed:key:key...)."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def above(share: float, seed: int | str, *keys: Column) -> Column:
    """Whether ``uniform`` of the key is above ``share`` in [0, 1): a comparison of hex digits, as their conversion costs more than the hash."""
    least = math.floor(share * 4294967296.0) + 1  # exact, a power of two only scales
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.substring(F.md5(text), 1, 8) >= f"{least:08x}" if least < 1 << 32 else F.lit(False)


def gumbel(u: Column) -> Column:
    """Gumbel noise of a uniform, clamped to [1e-6, 1 - 1e-6]."""
    u = F.least(F.greatest(u, F.lit(1e-6)), F.lit(1 - 1e-6))
    return -F.log(-F.log(u))


def uniform_sql(seed: int | str, *keys: str) -> str:
    """The same uniform as DuckDB SQL."""
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(f'({k})::VARCHAR' for k in keys)})), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE)"
