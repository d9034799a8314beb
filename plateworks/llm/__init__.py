"""Operators for preparing training data: deduplication, quality, decontamination, tokens, sharding, clustering and conversation prefixes.

``queries()`` and ``oracle_sql()`` are what the entry module adds to the library's own; nothing else imports this package.
"""

from __future__ import annotations


def queries():
    from plateworks.llm.registered import QUERIES

    return dict(QUERIES)


def oracle_sql():
    from plateworks.llm.registered import ORACLES

    return dict(ORACLES)
