"""Import every query module so the registry is complete."""

from __future__ import annotations

from ledgerlake.plans import q_corpus, q_evaluate, q_identity, q_extract, q_misc, q_reuse, q_split_chat, q_stream  # noqa: F401
from ledgerlake.plans.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
