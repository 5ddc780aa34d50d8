"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, embedding_dedup, fingerprint, kneserney, langid, merkle, minhash, mixing, quality, secrets, tokenshards, toxicity, whitening

MODULES = [embedding_dedup, toxicity, minhash, tokenshards, langid, secrets, bpe, fingerprint, quality, mixing, merkle, whitening, kneserney]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in vars(m).items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in getattr(m, "SQL", {}).items()}
