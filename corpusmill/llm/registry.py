"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import decontaminate, fingerprints, langid, linededup, minhash, packing, quality, substrings, tokens, urlrules


def queries() -> dict:
    return {
        "op1_url_filter": urlrules.op1_url_filter,
        "op2_line_dedup": linededup.op2_line_dedup,
        "op3_packing": packing.op3_packing,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_language_id": langid.op5_language_id,
        "op6_fingerprints": fingerprints.op6_fingerprints,
        "op7_quality": quality.op7_quality,
        "op8_token_counts": tokens.op8_token_counts,
        "op9_near_duplicates": minhash.op9_near_duplicates,
        "op10_remove_repeats": substrings.op10_remove_repeats,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": linededup.OP2_SQL, "op4_decontaminate": decontaminate.OP4_SQL, "op10_remove_repeats": substrings.OP10_SQL}
