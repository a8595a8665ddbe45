"""What is set by environment variables: strings, bounded numbers, keys, and version comparison."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

DEFAULT_MODEL, DEFAULT_BATCH, DEFAULT_WINDOW = "hash-64", 360, 1300
STORAGES = ("int8", "float32")


def first_string(names: Sequence[str], default: str = "") -> str:
    """The first variable that is set and not empty."""
    return next((os.environ[n] for n in names if os.environ.get(n)), default)


def optional_int(names: Sequence[str], least: int) -> int | None:
    """The first variable that holds a whole number of at least ``least``."""
    for n in names:
        raw = os.environ.get(n, "")
        if re.fullmatch(r"[+-]?\d+", raw) and int(raw) >= least:
            return int(raw)
    return None


def bounded_int(name: str, default: int, least: int) -> int:
    found = optional_int([name], least)
    return default if found is None else found


def usable_key(value: str | None) -> bool:
    """Whether a key is a real one: not blank and no placeholder such as ``${NAME}`` or ``$NAME``."""
    return bool(value and value.strip()) and not re.fullmatch(r"\$\{?\w+\}?", value.strip())


def embedding_model() -> str:
    return first_string(["LODESTONE_EMBEDDING_MODEL"], DEFAULT_MODEL)


def embedding_dimensions(default: int | None = None) -> int | None:
    found = optional_int(["LODESTONE_EMBEDDING_DIMENSIONS"], 1)
    return default if found is None else found


def embedding_batch() -> int:
    return bounded_int("LODESTONE_EMBEDDING_BATCH", DEFAULT_BATCH, 1)


def window_chars() -> int:
    return bounded_int("LODESTONE_WINDOW_CHARS", DEFAULT_WINDOW, 256)


def embedding_url() -> str:
    return first_string(["LODESTONE_EMBEDDING_URL"]).rstrip("/")


def vector_storage() -> str:
    """``float32`` if that is set, else ``int8``."""
    return "float32" if first_string(["LODESTONE_VECTOR_STORAGE"]).lower() in ("float32", "f32", "float") else "int8"


def read_version(text: str) -> tuple[int, int, int] | None:
    """Major, minor and patch of ``1.2.3``, with or without a leading v or what follows a dash or plus."""
    m = re.fullmatch(r"v?(\d+)\.(\d+)\.(\d+)(?:[-+].*)?", text.strip())
    return (int(m[1]), int(m[2]), int(m[3])) if m else None


def is_newer(latest: str, current: str) -> bool:
    """Whether ``latest`` comes after ``current``; False if either is no version."""
    a, b = read_version(latest), read_version(current)
    return bool(a and b and a > b)
