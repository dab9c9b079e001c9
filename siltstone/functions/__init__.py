"""Scalar functions as Column expressions."""

from .codec import crc32_hex, delta_decode, delta_encode, varint_decode, varint_encode, varint_size
from .text import extract_text, highlight, highlight_fields, levenshtein_bytes, normalize, occurrences, query_tokens, spaced, split_tokens, token_count, tokenize

__all__ = ["crc32_hex", "delta_decode", "delta_encode", "extract_text", "highlight", "highlight_fields", "levenshtein_bytes", "normalize", "occurrences", "query_tokens", "spaced", "split_tokens", "token_count", "tokenize", "varint_decode", "varint_encode", "varint_size"]
