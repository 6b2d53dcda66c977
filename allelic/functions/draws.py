"""Counter-based draws: a uniform is a pure function of seed, stream and key, so any partitioning gives the same."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed: int, stream: str, *key: Column) -> Column:
    """An md5 whose order shuffles rows."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(stream), *[k.cast("string") for k in key]))


def uniform(seed: int, stream: str, *key: Column) -> Column:
    return F.conv(F.substring(order_key(seed, stream, *key), 1, 8), 16, 10).cast("double") / float(1 << 32)


def pick(u: Column, weights: dict[str, float]) -> Column:
    """A weighted choice by cumulated weights."""
    total, run, out = sum(weights.values()), 0.0, None
    names = list(weights)
    for name in names[:-1]:
        run += weights[name] / total
        out = F.when(u < run, name) if out is None else out.when(u < run, name)
    return out.otherwise(names[-1])
