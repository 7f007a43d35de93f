"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, jaccard, licenses, secrets
from .decontaminate import op5_decontamination
from .fingerprints import op9_fingerprint
from .idfiles import op13_token_files
from .language import op10_language_id
from .periods import op12_periodic_runs
from .pieces import op4_piece_encoding
from .quality import op2_quality
from .substrings import op8_substring_dedup
from .variants import op11_spelling_variants

QUERIES = {
    "op1_jaccard_join": jaccard.op1_jaccard_join,
    "op2_quality": op2_quality,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_piece_encoding": op4_piece_encoding,
    "op5_decontamination": op5_decontamination,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_chat_format": chat.op7_chat_format,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_fingerprint": op9_fingerprint,
    "op10_language_id": op10_language_id,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_token_files": op13_token_files,
}
ORACLES: dict[str, str] = {"op1_jaccard_join": jaccard.ORACLE, "op3_license_scan": licenses.ORACLE, "op6_secret_scan": secrets.ORACLE, "op7_chat_format": chat.ORACLE}
