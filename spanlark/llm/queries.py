"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from spanlark.llm.exact_dedup import op5_exact_dedup
from spanlark.llm.mixing import op1_mixing
from spanlark.llm.near_dedup import op2_near_dedup
from spanlark.llm.pii import op9_pii
from spanlark.llm.pitman_yor import op7_pitman_yor
from spanlark.llm.prefix_bpe import op6_bpe
from spanlark.llm.quality import op8_quality
from spanlark.llm.sharding import op13_jump_shards
from spanlark.llm.spelling import op12_spelling_variants
from spanlark.llm.substring_dedup import op3_substring_dedup
from spanlark.llm.token_output import op10_token_files
from spanlark.llm.toxicity import op4_toxicity
from spanlark.llm.whitening import op11_whitening


def queries() -> dict:
    first = (op1_mixing, op2_near_dedup, op3_substring_dedup, op4_toxicity, op5_exact_dedup, op6_bpe, op7_pitman_yor, op8_quality, op9_pii)
    return {f.__name__: f for f in (*first, op10_token_files, op11_whitening, op12_spelling_variants, op13_jump_shards)}


EXACT_SQL = r"""
WITH rows AS (
    SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content FROM documents
), kept AS (
    SELECT doc_id, content, first_value(doc_id) OVER (PARTITION BY content ORDER BY chars DESC, doc_id ASC NULLS LAST) AS keep_id,
        count(*) OVER (PARTITION BY content) AS group_size FROM rows
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(content) AS text_sha256 FROM kept
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": EXACT_SQL}
