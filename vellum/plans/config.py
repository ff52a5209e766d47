"""Settings: defaults, bounds, and repair of whatever was stored."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields, replace
from typing import Any

#: The least and most of each whole number.
BOUNDS = {
    "recent_days": (0, 365),
    "workset_size": (0, 500),
    "max_files": (10, 5_000),
    "max_file_bytes": (4_096, 2_000_000),
    "cache_max_mb": (1, 64),
    "excerpt_length": (40, 800),
    "max_hits_per_note": (1, 30),
    "max_candidate_notes": (5, 300),
    "auto_min_term_length": (2, 12),
    "auto_max_term_length": (4, 60),
    "ngram_min_length": (2, 10),
    "ngram_max_length": (2, 12),
    "max_auto_queries": (5, 200),
    "ngram_span_limit": (4, 30),
}
#: The words of each choice.
CHOICES = {
    "ui_language": ("ja", "en"),
    "scope_mode": ("all", "recent", "workset", "recent-workset"),
    "cache_mode": ("memory", "persistent"),
    "highlight_style": ("invert", "marker", "color", "underline"),
}
#: Words that are no terms.
STOP_WORDS = ("the", "a", "an", "and", "or", "but", "の", "に", "は", "を", "が", "と", "で", "も")
PAIRS = (("auto_min_term_length", "auto_max_term_length"), ("ngram_min_length", "ngram_max_length"))


@dataclass(frozen=True)
class EngineConfig:
    ui_language: str = "en"
    include_folders: tuple[str, ...] = ()
    exclude_folders: tuple[str, ...] = ()
    scope_mode: str = "all"
    recent_days: int = 30
    workset_size: int = 50
    max_files: int = 500
    max_file_bytes: int = 512_000
    case_sensitive: bool = False
    cache_mode: str = "persistent"
    cache_max_mb: int = 8
    excerpt_length: int = 160
    highlight_style: str = "invert"
    show_badge: bool = True
    clear_on_file_change: bool = True
    max_hits_per_note: int = 8
    max_candidate_notes: int = 80
    focused_extraction: bool = True
    normal_prose_phrases: bool = True
    broad_ngram: bool = False
    auto_min_term_length: int = 3
    auto_max_term_length: int = 32
    ngram_min_length: int = 2
    ngram_max_length: int = 6
    max_auto_queries: int = 40
    ngram_span_limit: int = 12
    auto_stop_words: tuple[str, ...] = field(default=STOP_WORDS)
    ignored_terms: tuple[str, ...] = ()

    @classmethod
    def load(cls, stored: Any, normal_path: Callable[[str], str] = lambda p: p.replace("\\", "/").strip("/")) -> EngineConfig:
        """Settings from stored data of any shape: each field is repaired on its own, then the pairs are ordered."""
        raw = stored if isinstance(stored, dict) else {}
        out = {f.name: _repair(f.name, getattr(cls(), f.name), raw.get(f.name), normal_path) for f in fields(cls)}
        out["ignored_terms"] = _first_spellings(out["ignored_terms"], out["case_sensitive"])
        for low, high in PAIRS:
            if out[low] > out[high]:
                only_high = _number(raw.get(high)) and not _number(raw.get(low))
                out[low if only_high else high] = out[high if only_high else low]
        return cls(**out)

    def change(self, name: str, value: Any) -> EngineConfig:
        """One field changed by hand: clamped, and the other one of its pair moved along."""
        out = replace(self, **{name: _repair(name, getattr(self, name), value, str)})
        for low, high in PAIRS:
            if name in (low, high) and getattr(out, low) > getattr(out, high):
                out = replace(out, **{high if name == low else low: getattr(out, name)})
        return out

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)


def _number(x: Any) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x)


def _repair(name: str, default: Any, value: Any, normal_path: Callable[[str], str]) -> Any:
    if name in BOUNDS:
        low, high = BOUNDS[name]
        return min(high, max(low, math.floor(value + 0.5))) if _number(value) else default
    if name in CHOICES:
        return value if isinstance(value, str) and value in CHOICES[name] else default
    if isinstance(default, bool):
        return value if isinstance(value, bool) else default
    if not isinstance(value, list | tuple):
        return default
    items = [x.strip() for x in value if isinstance(x, str)]
    if name.endswith("_folders"):
        items = list(dict.fromkeys(normal_path(x).strip() for x in items))
    return tuple(x for x in items if x)


def _first_spellings(terms: tuple[str, ...], case_sensitive: bool) -> tuple[str, ...]:
    seen: dict[str, str] = {}
    for t in terms:
        seen.setdefault(t if case_sensitive else t.lower().replace("ς", "σ"), t)
    return tuple(seen.values())
