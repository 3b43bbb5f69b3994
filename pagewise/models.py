"""Model files: where they are kept, and whether they are the ones that were meant."""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass
from pathlib import Path


class ModelMissing(FileNotFoundError):
    pass


class ModelCorrupt(ValueError):
    pass


@dataclass(frozen=True)
class ModelSpec:
    name: str
    sha256: str


def cache_dir() -> Path:
    """PAGEWISE_HOME, else the user's cache folder."""
    if home := os.environ.get("PAGEWISE_HOME"):
        return Path(home)
    base = os.environ.get("XDG_CACHE_HOME")
    return Path(base or Path(os.environ.get("HOME", ".")) / ".cache") / "pagewise"


def model_path(spec: ModelSpec) -> Path:
    return cache_dir() / spec.name


def digest(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()


def file_digest(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def resolve(spec: ModelSpec) -> Path:
    """The model's file; nothing is ever downloaded."""
    path = model_path(spec)
    if not path.is_file():
        raise ModelMissing(f"model {spec.name} is not at {path}")
    if (found := file_digest(path)) != spec.sha256:
        raise ModelCorrupt(f"model {spec.name} has digest {found}, not {spec.sha256}")
    return path
