"""Contract queries and domain pipelines."""

from fieldglass.plans import (  # noqa: F401
    contract_aggregates, contract_boards, contract_io, contract_joins, contract_learn, contract_pipelines, contract_scalars,
    contract_windows,
)
from fieldglass.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
