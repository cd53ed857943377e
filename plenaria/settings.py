"""Settings of the command line programs, from the environment or a ``.env`` file, with defaults, read once."""

from __future__ import annotations

import importlib
import os
from dataclasses import dataclass
from functools import lru_cache


@dataclass(frozen=True)
class Settings:
    """Backends are named as ``package.module:Name``, a class or function that makes one in a worker; empty: the
    built-in rules. text_cap: characters of a speech that the graph keeps, 0: all."""

    data_dir: str = "data"
    graph_dir: str = "graph"
    output_dir: str = "output"
    batch_size: int = 100
    min_tokens: int = 20
    text_cap: int = 0
    entity_backend: str = ""
    entity_threshold: float = 0.5
    reply_backend: str = ""
    results_version: str = "1"
    least_words: int = 50
    embedder: str = ""
    embedding_model: str = ""
    embedding_dim: int = 256
    log_level: str = "INFO"


def named(path: str):
    """What ``package.module:Name`` names; None for an empty path."""
    if not path:
        return None
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def env_file(path: str = ".env") -> dict[str, str]:
    """NAME=value lines of a file, if there is one; what follows # in a line of its own is left out, quotes go."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        lines = [line.strip() for line in f]
    pairs = (line.removeprefix("export ").partition("=") for line in lines if line and line[0] != "#" and "=" in line)
    return {k.strip(): v.strip().strip("'\"") for k, _, v in pairs}


@lru_cache(maxsize=1)
def settings() -> Settings:
    """Each field from PLENARIA_<NAME> where that is set; the environment comes before the file."""
    given, found = env_file() | dict(os.environ), {}
    for name, field in Settings.__dataclass_fields__.items():
        value = given.get(f"PLENARIA_{name.upper()}")
        if value is not None:
            found[name] = type(field.default)(value)
    return Settings(**found)
