"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .op1_quality_rules import op1_quality_rules
from .op2_token_output import op2_token_output
from .op3_decontamination import OP3_SQL, op3_decontamination
from .op4_license_scan import OP4_SQL, op4_license_scan
from .op5_bpe import op5_bpe
from .op8_jaccard_join import op8_jaccard_join
from .op6_substring_dedup import op6_substring_dedup
from .op7_secret_scan import OP7_SQL, op7_secret_scan
from .op10_url_filter import OP10_SQL, op10_url_filter
from .op9_token_counts import op9_token_counts

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_token_output": op2_token_output,
    "op3_decontamination": op3_decontamination,
    "op4_license_scan": op4_license_scan,
    "op5_bpe": op5_bpe,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_token_counts": op9_token_counts,
    "op10_url_filter": op10_url_filter,
}

SQL = {
    "op3_decontamination": OP3_SQL,
    "op4_license_scan": OP4_SQL,
    "op7_secret_scan": OP7_SQL,
    "op10_url_filter": OP10_SQL,
}
