"""Entropy providers (u01, u04, u08): what turns files into scored tokens. A provider takes (file_id, text) and returns tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..operators.tokens import deterministic_tokens

Provider = Callable[[DataFrame], DataFrame]
_FACTORIES: dict[str, Callable[[], Provider]] = {"deterministic": lambda: deterministic_tokens}
_MADE: dict[str, Provider | Exception] = {}
TOKEN_SCHEMA = "file_id long, idx long, start_byte long, end_byte long, entropy double"


def register(name: str, factory: Callable[[], Provider]) -> None:
    _FACTORIES[name] = factory
    _MADE.pop(name, None)


def provider(name: str) -> Provider:
    """Made once, on first use; a factory that failed fails again without another try."""
    if name not in _MADE:
        try:
            _MADE[name] = _FACTORIES[name]()
        except Exception as e:  # noqa: BLE001
            _MADE[name] = e
    if isinstance(_MADE[name], Exception):
        raise _MADE[name]
    return _MADE[name]


def from_scorer(score: Callable[[bytes], list[tuple[bytes, float | None]]]) -> Provider:
    """A provider from a function of one file's bytes (a model, loaded once per Python worker): Arrow batches of files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            rows = []
            for file_id, text in zip(files["file_id"], files["text"]):
                at = 0
                for i, (piece, entropy) in enumerate(score((text or "").encode())):
                    rows.append((file_id, i, at, at + len(piece), entropy))
                    at += len(piece)
            yield pd.DataFrame(rows, columns=["file_id", "idx", "start_byte", "end_byte", "entropy"])

    return lambda files: files.select("file_id", "text").mapInPandas(run, TOKEN_SCHEMA)
