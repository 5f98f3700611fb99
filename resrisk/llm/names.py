"""Input columns that are called like an operator's own."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame


def shielded(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """`operator` with the input's columns that start with an underscore under other names.

    Operators call their own columns so. The input's have their names back in the result; arguments
    that name such a column follow.
    """
    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        hidden: dict[str, str] = {}
        for c in docs.columns:
            if c.startswith("_"):
                name = f"input{c}"
                while name in docs.columns or name in hidden.values():
                    name += "x"
                hidden[c] = name
        if not hidden:
            return operator(docs, *args, **kwargs)
        follow = lambda v: hidden.get(v, v) if isinstance(v, str) else v
        out = operator(docs.withColumnsRenamed(hidden), *map(follow, args), **{k: follow(v) for k, v in kwargs.items()})
        return out.withColumnsRenamed({name: c for c, name in hidden.items() if name in out.columns})
    return run
