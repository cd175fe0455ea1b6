"""Imports every corpus operator, so that the registry is complete."""

from . import (chat_format, decontamination, embedding_dedup, fill_in_middle, line_dedup, near_dedup, quality, secrets, sentencepiece, token_alignment, token_files, url_filters, warc)  # noqa: F401
from .common import ORACLES, QUERIES  # noqa: F401
