"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .decontaminate import op10_decontaminate
from .exact_dedup import OP5_SQL, op5_exact_dedup
from .html_extract import op4_html_extract
from .jaccard_join import op2_jaccard_join
from .language_id import op9_language_id
from .lexical_search import OP11_SQL, op11_block_max_search
from .packing import op3_packing
from .sketch_dedup import OP13_SQL, op13_sketch_dedup
from .suffix_dedup import op1_suffix_dedup
from .token_store import op8_token_store
from .toxicity import op7_toxicity
from .warc import op6_warc
from .whitening import op12_residue_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup,
        op2_jaccard_join,
        op3_packing,
        op4_html_extract,
        op5_exact_dedup,
        op6_warc,
        op7_toxicity,
        op8_token_store,
        op9_language_id,
        op10_decontaminate,
        op11_block_max_search,
        op12_residue_whitening,
        op13_sketch_dedup,
    )
}

ORACLES = {"op5_exact_dedup": OP5_SQL, "op11_block_max_search": OP11_SQL, "op13_sketch_dedup": OP13_SQL}
