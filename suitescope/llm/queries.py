"""The queries of this subpackage, for the registry at the top of the repository."""

from __future__ import annotations

from .decontaminate import op10_decontamination
from .licenses import op7_license_scan
from .mixing import OP1_SQL, op1_source_mix
from .media import op3_media_columns
from .near_dedup import op5_near_duplicates
from .pii import op8_pii_spans
from .quality import op2_quality_crf
from .suffix_array_dedup import op6_suffix_array_dedup
from .suffix_tree_dedup import op4_substring_dedup
from .tokens import op9_token_counts

QUERIES = {f.__name__: f for f in (op1_source_mix, op2_quality_crf, op3_media_columns, op4_substring_dedup, op5_near_duplicates, op6_suffix_array_dedup, op7_license_scan, op8_pii_spans, op9_token_counts, op10_decontamination)}

ORACLE_SQL: dict[str, str] = {"op1_source_mix": OP1_SQL}
