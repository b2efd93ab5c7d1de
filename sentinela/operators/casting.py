"""Apply a declared schema."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from sentinela.config import ColumnSpec
from sentinela.functions.casts import cast_to
from sentinela.functions.numeric import to_number


def cast_frame(
    df: DataFrame,
    columns: list[ColumnSpec],
    positional: Iterable[str] = (),
    partition_column: str | None = None,
    extra: Iterable[str] = (),
) -> DataFrame:
    """One projection that casts every declared column.

    Names are matched without regard to case and come out in lower case, in declared order,
    followed by the ``extra`` columns taken over as they are; the partition column goes last.
    """
    present = {f.name.lower(): f for f in df.schema.fields}
    untrimmed = {p.lower() for p in positional}
    out = {}
    for spec in columns:
        field = present.get(spec.source.lower())
        if field is None:
            raise ValueError(f"column {spec.source!r} is not in the data")
        out[spec.name] = cast_to(F.col(f"`{field.name}`"), field.dataType, spec.type, spec.mask,
                                 trim=spec.name not in untrimmed).alias(spec.name)
    for name in extra:
        out[name] = F.col(name)
    order = [name for name in out if name != partition_column]
    if partition_column:
        if partition_column not in out:
            raise ValueError(f"partition column {partition_column!r} is not among the columns")
        order.append(partition_column)
    return df.select(*[out[name] for name in order])


def coerce_numeric(df: DataFrame, columns: Iterable[str], fill: float | None = None) -> DataFrame:
    """Listed columns as doubles; what is no number becomes NULL or ``fill``."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: to_number(F.col(c), fill) for c in present})
