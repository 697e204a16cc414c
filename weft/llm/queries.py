"""All registered queries of this subpackage."""

from __future__ import annotations

from weft.llm import bpe, fingerprint, html, langid, minhash, packing, quality, sharding, substrings, urls

_MODULES = (quality, bpe, packing, sharding, minhash, langid, html, fingerprint, urls, substrings)

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
