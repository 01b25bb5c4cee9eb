"""Canonical JSON and its hash. Recursion over arbitrary JSON is beyond Catalyst: a small Arrow UDF has it."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


# What violations begin with.
FIELD, SCALAR = "forbidden field name status", "forbidden scalar type"


def canonical(text: str) -> str:
    """Keys sorted, no spaces, non-ASCII escaped."""
    return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def violations(text: str) -> list[str]:
    """What a sealed document must not hold, with its path: booleans, nulls, floats and fields named status."""
    out: list[str] = []
    todo = [("$", json.loads(text))]
    while todo:
        path, node = todo.pop()
        if isinstance(node, dict):
            for name, value in node.items():
                if name == "status":
                    out.append(f"{FIELD} at {path}")
                else:
                    todo.append((f"{path}.{name}", value))
        elif isinstance(node, list):
            todo += [(f"{path}[{i}]", value) for i, value in enumerate(node)]
        elif node is None or isinstance(node, (bool, float)):
            out.append(f"{SCALAR} {type(node).__name__} at {path}")
    return sorted(out)


FACTS = "canonical string, violations array<string>, deterministic boolean"


def facts(text: Column) -> Column:
    """struct(canonical, violations, deterministic) of a document, read once: its canonical form, what a sealed document must not hold, and whether canonicalising once more changes nothing.

    All null for a null or malformed document, and for one nested deeper than Python's parser goes (about a thousand levels).
    """

    @F.pandas_udf(FACTS)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            try:
                once = canonical(t) if t is not None else None
                rows.append((None, None, None) if once is None else (once, violations(t), canonical(once) == once))
            except (ValueError, RecursionError):
                rows.append((None, None, None))
        return pd.DataFrame(rows, columns=["canonical", "violations", "deterministic"], dtype=object)

    return run(text)


def canonical_json(text: Column) -> Column:
    """The canonical form; null where facts() has none."""
    return facts(text)["canonical"]


def canonical_sha256(text: Column) -> Column:
    """SHA-256, in hex, of the canonical form's UTF-8."""
    return F.sha2(canonical_json(text).cast("binary"), 256)


def domain_violations(text: Column) -> Column:
    """Sorted array of violations; empty for an admissible document, null where facts() has none."""
    return facts(text)["violations"]


def is_deterministic(text: Column) -> Column:
    """Whether canonicalising once more changes nothing; null where facts() has none."""
    return facts(text)["deterministic"]


def sha256_of(document: object) -> str:
    """The canonical hash of a document at hand."""
    return hashlib.sha256(canonical(json.dumps(document)).encode()).hexdigest()
