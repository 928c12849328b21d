"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from helixframe.llm import mixing, suffix_dedup
from helixframe.llm.bpe import op3_byte_bpe
from helixframe.llm.language_id import op10_language_id
from helixframe.llm.media_ogg import op4_media_ogg
from helixframe.llm.mixing import op7_mixing
from helixframe.llm.pii import op9_pii
from helixframe.llm.quality_classifier import op2_quality_classifier
from helixframe.llm.quality_rules import op1_quality_rules
from helixframe.llm.simhash import op8_simhash
from helixframe.llm.suffix_dedup import op6_suffix_dedup
from helixframe.llm.token_counts import op5_token_counts

QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_quality_classifier,
        op3_byte_bpe,
        op4_media_ogg,
        op5_token_counts,
        op6_suffix_dedup,
        op7_mixing,
        op8_simhash,
        op9_pii,
        op10_language_id,
    )
}

ORACLE: dict[str, str] = {"op6_suffix_dedup": suffix_dedup.ORACLE_SQL, "op7_mixing": mixing.ORACLE_SQL}
