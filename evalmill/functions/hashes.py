"""Hashes of the settings that decide a data set's content."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalmill.functions.jsonx import dumps


def config_hash(settings: dict, without: tuple[str, ...] = ("output_dir", "output_path")) -> str:
    """SHA-256 of the canonical JSON of the settings; where output goes does not count."""
    return hashlib.sha256(dumps({k: v for k, v in settings.items() if k not in without}).encode()).hexdigest()


def mixed_revision(settings: dict, revisions: dict[str, str]) -> str:
    """A mix's revision: its settings and its sources' revisions."""
    return hashlib.sha256(dumps({"config": config_hash(settings), "sources": revisions}).encode()).hexdigest()


@F.pandas_udf(T.StringType())
def settings_hash(texts: pd.Series) -> pd.Series:
    """``config_hash`` of settings in a column of JSON objects."""
    return texts.map(lambda t: config_hash(json.loads(t)), na_action="ignore")
