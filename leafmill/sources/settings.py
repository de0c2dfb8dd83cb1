"""Settings from TOML: typed, checked when made, unknown keys refused."""

from __future__ import annotations

import os
import re
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, fields


def expand_variables(text: str, variable: Callable[[str], str | None]) -> str:
    """``%NAME%`` for known names; others stay, and a closing ``%`` may open the next reference."""
    out, at = [], 0
    while m := re.compile(r"%([^%]*)(?=%)").search(text, at):
        value = variable(m[1]) if m[1] and not re.search(r"\s", m[1]) else None
        out.append(text[at : m.start()] + ("%" if value is None else value))
        at = m.start() + 1 if value is None else m.end() + 1
    return "".join(out) + text[at:]


@dataclass(frozen=True)
class Settings:
    author: str = ""
    creator: str = ""
    auto_rotate: bool = False
    keep_icc: bool = False
    optimize: bool = False
    page_size: str = "A4"
    strip_metadata: bool = False
    bookmarks: bool = False
    recogniser: str = "auto"
    recogniser_language: str | None = None
    recogniser_model: str = ""
    recogniser_prompt: str = ""
    recogniser_endpoint: str = ""
    recogniser_key: str = ""
    recogniser_seconds: int = 120
    recogniser_jobs: int = 1
    recogniser_tokens: int = 4096
    cache: bool = True
    cache_folder: str = ""
    font_path: str = ""
    jpeg_quality: int = 95
    image_dpi: int = 150
    html_viewport: str = "1200x1600"

    #: Settings in which variables are expanded.
    EXPANDED = ("recogniser_key", "recogniser_endpoint", "cache_folder", "font_path")

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            kind = type(f.default) if f.default is not None else (str, type(None))
            if not isinstance(value, kind) or (kind is int and isinstance(value, bool)):
                raise ValueError(f"{f.name}: {value!r} is of the wrong type")
        if not 1 <= self.jpeg_quality <= 100:
            raise ValueError("jpeg_quality must be between 1 and 100")
        for name in ("recogniser_seconds", "recogniser_jobs", "recogniser_tokens"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")
        sides = re.fullmatch(r"\s*(\d+)\s*[xX×]\s*(\d+)\s*", self.html_viewport)
        if not sides or not all(1 <= int(s) <= 16384 for s in sides.groups()):
            raise ValueError(f"html_viewport: {self.html_viewport!r} is not WIDTHxHEIGHT")

    @classmethod
    def parse(cls, text: str, variable: Callable[[str], str | None] = os.environ.get) -> Settings:
        given = tomllib.loads(text)
        unknown = sorted(set(given) - {f.name for f in fields(cls)})
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return cls(**{k: expand_variables(v, variable) if k in cls.EXPANDED and isinstance(v, str) else v for k, v in given.items()})

    def cache_place(self) -> str | None:
        return self.cache_folder if self.cache and self.cache_folder else None
