"""The operators' queries."""

from reelspark.llm import bpe, chat_format, exact_dedup, fingerprint, licenses, lm_scoring, near_dedup, packing, periodic, pii, quality, repair, toxicity

MODULES = [chat_format, lm_scoring, near_dedup, licenses, exact_dedup, fingerprint, pii, bpe, packing, quality, periodic, toxicity, repair]
