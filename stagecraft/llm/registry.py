"""Registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .language_id import op4_language_id
from .neighbours import op3_nearest
from .order_minhash import op8_order_minhash
from .packing import op10_packing
from .phrases import ORACLE as OP11_SQL
from .phrases import op11_phrases
from .piece_codec import op5_sentencepiece
from .simhash import op7_simhash_neardup
from .substring_dedup import ORACLE as OP6_SQL
from .substring_dedup import op6_substring_dedup
from .token_counts import op2_token_counts
from .token_store import op1_token_store
from .toxicity import op12_toxicity
from .warc import ORACLE as OP9_SQL
from .warc import op9_warc
from .whitening import op13_whitening

QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_token_counts": op2_token_counts,
    "op3_nearest": op3_nearest,
    "op4_language_id": op4_language_id,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_simhash_neardup": op7_simhash_neardup,
    "op8_order_minhash": op8_order_minhash,
    "op9_warc": op9_warc,
    "op10_packing": op10_packing,
    "op11_phrases": op11_phrases,
    "op12_toxicity": op12_toxicity,
    "op13_whitening": op13_whitening,
}

ORACLES: dict[str, str] = {
    "op6_substring_dedup": OP6_SQL,
    "op9_warc": OP9_SQL,
    "op11_phrases": OP11_SQL,
}
