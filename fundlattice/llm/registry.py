"""The queries of this subpackage and their SQL, for the driver's entry file."""

from __future__ import annotations

from .align import op11_alignment
from .bpe import op7_bpe
from .chat import OP5_SQL, op5_chat
from .fim import OP12_SQL, op12_fill_in_middle
from .langid import op1_language_id
from .lm_score import op4_lm_score
from .neighbours import OP2_SQL, op2_neighbours
from .packing import op3_packing
from .secrets import OP8_SQL, op8_secret_scan
from .shingle_join import OP10_SQL, op10_shingle_join
from .suffix_dedup import op13_suffix_dedup
from .url_filter import OP9_SQL, op9_url_filter
from .vector_dedup import OP6_SQL, op6_vector_dedup

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_neighbours": op2_neighbours,
    "op3_packing": op3_packing,
    "op4_lm_score": op4_lm_score,
    "op5_chat": op5_chat,
    "op6_vector_dedup": op6_vector_dedup,
    "op7_bpe": op7_bpe,
    "op8_secret_scan": op8_secret_scan,
    "op9_url_filter": op9_url_filter,
    "op10_shingle_join": op10_shingle_join,
    "op11_alignment": op11_alignment,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_suffix_dedup": op13_suffix_dedup,
}
ORACLE_SQL = {"op2_neighbours": OP2_SQL, "op5_chat": OP5_SQL, "op6_vector_dedup": OP6_SQL, "op8_secret_scan": OP8_SQL, "op9_url_filter": OP9_SQL, "op10_shingle_join": OP10_SQL, "op12_fill_in_middle": OP12_SQL}
