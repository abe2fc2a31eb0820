"""Every registered query of this subpackage, with its SQL where SQL can express it."""

from __future__ import annotations

from . import decontaminate, html, langid, licenses, neardup, packing, quality, substrings, toxicity, urls

_MODULES = (html, packing, quality, neardup, urls, substrings, langid, decontaminate, toxicity, licenses)
QUERIES = {name: f for module in _MODULES for name, f in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
