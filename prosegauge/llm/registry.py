"""Queries of this folder, and SQL where it can express them."""

from __future__ import annotations

from .bpe import op8_bpe
from .decontaminate import OP5_SQL, op5_decontaminate
from .language import op10_language
from .ledger import OP7_SQL, op7_ledger
from .licenses import OP2_SQL, op2_licenses
from .lm import op9_lm
from .simhash import op6_simhash
from .suffix_dedup import OP1_SQL, op1_suffix_dedup
from .urls import OP4_SQL, op4_urls
from .winnow import op3_winnow

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_licenses": op2_licenses,
    "op3_winnow": op3_winnow,
    "op4_urls": op4_urls,
    "op5_decontaminate": op5_decontaminate,
    "op6_simhash": op6_simhash,
    "op7_ledger": op7_ledger,
    "op8_bpe": op8_bpe,
    "op9_lm": op9_lm,
    "op10_language": op10_language,
}
ORACLE_SQL: dict[str, str] = {"op1_suffix_dedup": OP1_SQL, "op2_licenses": OP2_SQL, "op4_urls": OP4_SQL, "op5_decontaminate": OP5_SQL, "op7_ledger": OP7_SQL}
