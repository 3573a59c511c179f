"""The queries of this subpackage, and the SQL that checks them where SQL can express them."""

from __future__ import annotations

from .chat_format import OP2_SQL, op2_chat_format
from .exact_dedup import OP4_SQL, op4_exact_dedup
from .html_extract import op10_html_extract
from .line_dedup import OP8_SQL, op8_line_dedup
from .media import op9_media
from .packing import op6_packing
from .sentencepiece_bpe import op3_sentencepiece
from .simhash import op7_simhash
from .toxicity import op5_toxicity
from .url_filter import OP1_SQL, op1_url_filter

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_chat_format": op2_chat_format,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op7_simhash": op7_simhash,
    "op8_line_dedup": op8_line_dedup,
    "op9_media": op9_media,
    "op10_html_extract": op10_html_extract,
}

SQL = {
    "op1_url_filter": OP1_SQL,
    "op2_chat_format": OP2_SQL,
    "op4_exact_dedup": OP4_SQL,
    "op8_line_dedup": OP8_SQL,
}
