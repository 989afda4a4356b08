"""Settings of the engine."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    threshold: float = 0.5
    ocr_threshold: float = 0.4
    number_persons: bool = True
    mask_initials: bool = True
    mask_organizations: bool = False
    mask_places: bool = False
    mask_cases: bool = False
    max_chars: int = 5_000_000
    max_terms: int = 150
    max_file_mb: int = 100
    max_ocr_images: int = 300

    @classmethod
    def from_env(cls, prefix: str = "REDACTLAKE_") -> EngineConfig:
        """Settings from the environment; a value that can't be read keeps the default and warns."""
        found = {}
        for name, field in cls.__dataclass_fields__.items():
            raw = os.environ.get(prefix + name.upper())
            if raw is None:
                continue
            try:
                found[name] = parse(raw, type(field.default))
            except ValueError:
                logging.getLogger(__name__).warning("%s%s can't be read; the default stays", prefix, name.upper())
        return cls(**found)


def parse(raw: str, kind: type):
    raw = raw.strip()
    if kind is bool:
        if raw.lower() in ("1", "true", "yes", "on", "oui"):
            return True
        if raw.lower() in ("0", "false", "no", "off", "non"):
            return False
        raise ValueError(raw)
    return kind(raw.replace(",", ".")) if kind is float else kind(raw)
