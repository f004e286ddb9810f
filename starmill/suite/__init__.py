"""Queries over the test tables, one per operator, each paired with an independent SQL oracle."""

from starmill.suite import (  # noqa: F401  (importing registers the queries)
    cleansing,
    contracts,
    gold,
    governance,
    history,
    loads,
    logs,
    products,
    profiles,
    robust,
    shipped_star,
    storage,
)
from starmill.suite.registry import ORACLES, QUERIES  # noqa: F401
