"""Importing this module registers the queries of every operator in ``common.QUERIES``."""

from lanewise.llm import alignment, common, embeddings, fingerprints, infilling, katz, mixing, near_dedup, packing, passages, quality, sharding, token_store, toxicity  # noqa: F401

QUERIES, ORACLES = common.QUERIES, common.ORACLES
