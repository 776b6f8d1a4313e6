"""Column names, fold marks and keys that the operators of this folder share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import BATCH_BYTES as BATCH_BYTES
from ..session import small_batches as small_batches


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names close to ``names`` that no column of ``df`` has, whatever its upper and lower case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def column(name: str) -> Column:
    """A top-level column, also when its name holds dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def held_out(key: Column) -> Column:
    """True on the quarter of keys whose crc32 has remainder 2; null keys are in the training part."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def hash_order(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the md5 of the key and the seed, the same in every run."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")
