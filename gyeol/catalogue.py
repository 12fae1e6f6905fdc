"""All queries of the engine by name, with equivalent SQL where SQL can express them."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

for _name in ("text", "search", "joins", "pages", "lexicon", "terms", "evidence", "usage", "reading", "dictionary", "concepts"):
    _module = importlib.import_module(f"gyeol.queries.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
