"""All queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

MODULES = [
    "quality_rules",
    "url_filter",
    "pii",
    "substrings",
    "mixing",
    "licenses",
    "html_text",
    "quality_model",
    "jaccard_join",
    "decontaminate",
]

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
