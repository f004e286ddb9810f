"""Fingerprints of structure and rules; no data goes into them.

Everything that counts is put into one canonical JSON document, which is hashed once.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Mapping, Sequence
from typing import Any

Structure = Mapping[str, Sequence[str] | Mapping[str, str]]


def _digest(document: Any) -> str:
    canonical = json.dumps(document, sort_keys=True, separators=(",", ":"), default=str)
    return hashlib.sha256(canonical.encode("utf-8")).hexdigest()


def _structure(tables: Structure) -> dict[str, list[list[str]]]:
    """Per table its columns in order, with types where they are known."""
    return {
        table: [list(c) for c in columns.items()]
        if isinstance(columns, Mapping)
        else [[c] for c in columns]
        for table, columns in tables.items()
    }


def schema_fingerprint(tables: Structure) -> str:
    """Of tables and their columns (names, or names with types): new rows leave it alone, a
    renamed, moved or retyped column does not."""
    return _digest({"tables": _structure(tables)})


def governance_fingerprint(
    tables: Structure, contracts: Mapping[str, Any] | None = None, ddl: str = ""
) -> str:
    """Of structure plus rules. Contracts count by content (key order does not matter), DDL
    without comments and spacing."""
    statements = [" ".join(re.sub(r"--[^\n]*", " ", part).split()) for part in ddl.split(";")]
    return _digest(
        {
            "tables": _structure(tables),
            "contracts": contracts or {},
            "ddl": [statement for statement in statements if statement],
        }
    )
