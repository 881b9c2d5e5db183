"""Canonical JSON text and the hashes built on it."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@pandas_udf(StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """Keys sorted, ``", "`` and ``": "`` between parts, ASCII escapes; null for text that is no JSON or nested too deeply."""

    def one(text):
        try:
            return json.dumps(json.loads(text), sort_keys=True)
        except (TypeError, ValueError, RecursionError):
            return None

    return texts.map(one)


def breadcrumb(registry_json: Column) -> Column:
    """Fingerprint of a registry document."""
    return F.sha2(canonical_json(registry_json), 256)


def proof(state_json: Column, secret: Column) -> Column:
    """Proof of a state given as canonical JSON text."""
    return F.sha2(F.concat(state_json, secret), 256)
