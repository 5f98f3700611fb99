"""Operators of a training-data pipeline: filters, de-duplication, mixing, packing, formatting."""


def queries() -> dict:
    from .registry import QUERIES
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from .registry import ORACLE
    return dict(ORACLE)
