"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, chat, kdtree, language_id, line_dedup, media, mixing, sharding, simhash, warc

MODULES = (language_id, warc, bpe, sharding, kdtree, chat, mixing, simhash, line_dedup, media)


def queries() -> dict:
    return dict(m.QUERY for m in MODULES)


def oracle_sql() -> dict[str, str]:
    return {m.QUERY[0]: m.ORACLE for m in MODULES if m.ORACLE}
