"""Text lines for a result: k=v, k2=v2 count=N func(col)=x ..."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from decimal import Decimal

from pyspark.sql import Row

from tallyframe.model import AggSpec


def number(v: float) -> str:
    """Shortest digits; exponent form below 1e-4 and from 1e6 up."""
    if math.isnan(v):
        return "NaN"
    if math.isinf(v):
        return "+Inf" if v > 0 else "-Inf"
    sign, digits, power = Decimal(repr(float(v))).normalize().as_tuple()
    shown, exponent = "".join(map(str, digits)), len(digits) - 1 + power
    minus = "-" * sign
    if v == 0:
        return minus + "0"
    if exponent < -4 or exponent >= 6:
        return f"{minus}{shown[0]}{'.' * (len(shown) > 1)}{shown[1:]}e{'-' if exponent < 0 else '+'}{abs(exponent):02d}"
    return minus + format(Decimal((0, digits, power)), "f")


def lines(rows: Iterable[Row], spec: AggSpec) -> Iterator[str]:
    names = [n for _, _, n in spec.outputs()]
    show = lambda v: number(v) if isinstance(v, float) else str(v)
    for row in rows:
        keys = ", ".join(f"{k}={show(row[i])}" for i, k in enumerate(spec.group_by))
        at = len(spec.group_by)
        parts = [keys] * bool(keys) + [f"count={row[at]}"] + [f"{n.split('#')[0]}={show(row[at + 1 + j])}" for j, n in enumerate(names)]
        yield " ".join(parts)
