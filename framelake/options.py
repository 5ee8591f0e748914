"""Process-wide options of the engine: defaults that callers may read; no operator reads them by itself."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Options:
    interpolation: str = "bilinear"
    background: tuple[int, int, int, int] = (0, 0, 0, 0)
    preserve_alpha: bool = True
    optimize_memory: bool = False


_options = Options()


def get() -> Options:
    return _options


def configure(**changes) -> Options:
    global _options
    _options = replace(_options, **changes)
    return _options
