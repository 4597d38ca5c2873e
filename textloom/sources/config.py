"""Configuration files and their lookup from a folder up to the root."""

from __future__ import annotations

import tomllib
from pathlib import Path

from ..plans.rules import Settings
from .rule_files import discover_rule_files, merged

NAMES = (".textloom.toml", ".textloom.yaml", ".textloom.yml")


def find(start: str) -> Path | None:
    for folder in (Path(start).resolve(), *Path(start).resolve().parents):
        for name in NAMES:
            if (folder / name).is_file():
                return folder / name
    return None


def load(path: str | None = None, start: str = ".") -> dict:
    """The given file, which must exist, or the first found; {} if there is none."""
    found = Path(path) if path else find(start)
    if found is None:
        return {}
    if not found.is_file():
        raise FileNotFoundError(str(found))
    if found.suffix == ".toml":
        return tomllib.loads(found.read_text())
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("YAML configuration needs PyYAML") from missing
    return yaml.safe_load(found.read_text()) or {}


def settings(config: dict, start: str | None = None, **options) -> Settings:
    """Configuration over options for the profile; options over configuration for the confidence."""
    rules, disabled = merged(discover_rule_files(start)) if start else ([], [])
    given = lambda *values: next((v for v in values if v is not None), None)
    listed = lambda k: tuple(config.get(k, ()))
    return Settings(
        profile=given(config.get("profile"), options.get("profile"), "conservative"),
        extra_profiles=(*listed("extra_profiles"), *options.get("extra_profiles", ())),
        skip=(*listed("skip"), *options.get("skip", ())),
        fix=tuple(options.get("fix", ())),
        min_confidence=given(options.get("min_confidence"), config.get("min_confidence"), 0.6),
        lang=options.get("lang"),
        threshold=given(options.get("threshold"), config.get("threshold")),
        allow_symbols=listed("allow_symbols"),
        custom_phrases=listed("custom_phrases"),
        file_rules=tuple(rules),
        disabled=tuple(disabled),
    )
