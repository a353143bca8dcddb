"""Configuration from TOML: an explicit file, else the environment's, the working folder's or the home folder's."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path

ENV = "FOLIOSCOPE_CONFIG"


@dataclass(frozen=True)
class Folders:
    paths: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ("pdf", "docx", "txt", "md")
    ignore: tuple[str, ...] = ("*/.git/*", "*/node_modules/*", "*/__pycache__/*")


@dataclass(frozen=True)
class Chunking:
    strategy: str = "fixed"
    similarity_threshold: float = 0.35
    max_sentences: int = 15
    max_chunk_tokens: int = 768

    def __post_init__(self) -> None:
        if self.strategy not in ("fixed", "semantic"):
            raise ValueError("chunking.strategy is fixed or semantic")
        if not 0 <= self.similarity_threshold <= 1 or not 128 <= self.max_chunk_tokens <= 2048:
            raise ValueError("chunking: a threshold from 0 to 1 and 128 to 2048 tokens")


@dataclass(frozen=True)
class Reranking:
    candidates: int = 30
    results: int = 10

    def __post_init__(self) -> None:
        if self.results > self.candidates:
            raise ValueError("reranking.results may not exceed reranking.candidates")


@dataclass(frozen=True)
class Watching:
    debounce: str = "2 seconds"
    batch: str = "10 seconds"


@dataclass(frozen=True)
class Config:
    store: str = "~/.folioscope"
    folders: Folders = field(default_factory=Folders)
    chunking: Chunking = field(default_factory=Chunking)
    reranking: Reranking = field(default_factory=Reranking)
    watching: Watching = field(default_factory=Watching)


def _filled(kind: type, given: dict):
    known = {f.name: f for f in fields(kind)}
    if unknown := set(given) - set(known):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    values = {}
    for name, value in given.items():
        default = known[name].default_factory() if callable(known[name].default_factory) else known[name].default
        values[name] = _filled(type(default), value) if is_dataclass(default) else tuple(value) if isinstance(value, list) else value
    return kind(**values)


def find(path: str | None = None) -> Path | None:
    """The file to read: ``path``, which must exist, else the first of the usual places that does."""
    if path is not None:
        return Path(path).expanduser()
    places = [os.environ.get(ENV), "folioscope.toml", "~/.folioscope/config.toml"]
    return next((p for x in places if x and (p := Path(x).expanduser()).is_file()), None)


def load(path: str | None = None) -> Config:
    """The configuration; all defaults where no file is found. Folder paths are made absolute."""
    at = find(path)
    config = _filled(Config, tomllib.loads(at.read_text()) if at else {})
    full = tuple(str(Path(p).expanduser().resolve()) for p in config.folders.paths)
    return Config(str(Path(config.store).expanduser()), Folders(full, config.folders.extensions, config.folders.ignore), config.chunking, config.reranking, config.watching)
