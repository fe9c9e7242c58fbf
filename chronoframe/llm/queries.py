"""Registers the subpackage's queries and their SQL."""

from __future__ import annotations

from .decontaminate import OP3_SQL, op3_decontamination
from .flac import op7_flac_media
from .html_extract import op4_html_extraction
from .pii import op10_pii
from .sentencepiece_codec import op5_sentencepiece
from .sharding import op2_sharding
from .simhash import op8_simhash
from .token_files import op9_token_files
from .toxicity import op6_toxicity
from .url_filter import OP1_SQL, op1_url_filter

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_sharding": op2_sharding,
    "op3_decontamination": op3_decontamination,
    "op4_html_extraction": op4_html_extraction,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_toxicity": op6_toxicity,
    "op7_flac_media": op7_flac_media,
    "op8_simhash": op8_simhash,
    "op9_token_files": op9_token_files,
    "op10_pii": op10_pii,
}
ORACLE_SQL = {
    "op1_url_filter": OP1_SQL,
    "op3_decontamination": OP3_SQL,
}
