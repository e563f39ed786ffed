"""All queries of this package."""

from turnwise.llm import audio, decontamination, language, licenses, mixing, negatives, packing, phrases, quality, simhash, tokens, urls, warc  # noqa: F401
from turnwise.llm.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
