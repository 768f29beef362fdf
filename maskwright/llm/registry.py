"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import contamination, knn, licenses, lines, merkle, neardup, spelling, substrings
from .bpe import op5_bpe
from .contamination import op4_decontamination
from .knn import op6_voronoi_topk
from .language import op3_language_id
from .licenses import op7_license_scan
from .lines import op11_line_dedup
from .merkle import op13_merkle_manifest
from .neardup import op1_ngram_jaccard_join
from .pages import op8_html_extraction
from .sharding import op10_hilbert_sharding
from .spelling import op12_spelling_variants
from .substrings import op9_substring_dedup
from .toxicity import op2_toxicity


def queries() -> dict:
    found = (
        op1_ngram_jaccard_join, op2_toxicity, op3_language_id, op4_decontamination, op5_bpe, op6_voronoi_topk, op7_license_scan, op8_html_extraction, op9_substring_dedup, op10_hilbert_sharding,
        op11_line_dedup, op12_spelling_variants, op13_merkle_manifest,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": neardup.ORACLE_SQL, "op4_decontamination": contamination.ORACLE_SQL, "op6_voronoi_topk": knn.ORACLE_SQL, "op7_license_scan": licenses.ORACLE_SQL, "op9_substring_dedup": substrings.ORACLE_SQL,
        "op11_line_dedup": lines.ORACLE_SQL, "op12_spelling_variants": spelling.ORACLE_SQL, "op13_merkle_manifest": merkle.ORACLE_SQL,
    }
