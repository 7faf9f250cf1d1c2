"""Fields derived from others: declared dependencies, sorted into layers, one projection a layer."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A field, the fields or columns that it is computed from, and how (SQL)."""

    name: str
    needs: tuple[str, ...]
    sql: str


def layers(fields: Sequence[Field], columns: Sequence[str]) -> list[list[Field]]:
    """The fields in layers, each needing only ``columns`` and fields of layers before it; in the given order within a layer.

    A name given twice, a need that is neither field nor column, and fields that need each
    other in a circle are refused, the last with the circle.
    """
    by_name = {f.name: f for f in fields}
    if len(by_name) < len(fields):
        raise ValueError(f"fields given twice: {sorted({f.name for f in fields if sum(g.name == f.name for g in fields) > 1})}")
    unknown = {f.name: lost for f in fields if (lost := [n for n in f.needs if n not in by_name and n not in columns])}
    if unknown:
        raise ValueError(f"unknown needs: {unknown}")
    depth: dict[str, int] = {}
    for f in fields:  # depth first, without recursion
        path = [f.name]
        while path:
            open_ = [n for n in by_name[path[-1]].needs if n in by_name and n not in depth]
            if not open_:
                name = path.pop()
                depth[name] = max((depth[n] + 1 for n in by_name[name].needs if n in by_name), default=0)
            elif open_[0] in path:
                raise ValueError("fields need each other: " + " -> ".join([*path[path.index(open_[0]) :], open_[0]]))
            else:
                path.append(open_[0])
    out: list[list[Field]] = [[] for _ in range(max(depth.values(), default=-1) + 1)]
    for f in fields:
        out[depth[f.name]].append(f)
    return out


def derive(df: DataFrame, fields: Sequence[Field], touched: str | None = None) -> DataFrame:
    """``df`` with the fields, each computed unless its name is in the row's array ``touched``: then the value that is there (null if none) stays.

    A field that depends on a touched one is computed from the value that stayed. Rows are
    never shuffled; a layer is one projection, and Spark merges layers where that repeats no work.
    """
    out = df
    for layer in layers(fields, df.columns):
        new = {}
        for f in layer:
            computed = F.expr(f.sql)
            if touched is not None:
                held = F.col(f.name) if f.name in out.columns else F.lit(None)
                computed = F.when(F.coalesce(F.array_contains(touched, f.name), F.lit(False)), held).otherwise(computed)
            new[f.name] = computed
        out = out.withColumns(new)
    return out
