"""Queries of this subpackage for the driver, with their SQL where there is one."""

from __future__ import annotations

from . import bestfit, chat, decontam, exact_dedup, langid, packing, periodic, pii, quality, search, sharding, simhash, substring


def queries():
    return {
        "op10_pii": pii.op10_pii,
        "op11_ranked_search": search.op11_ranked_search,
        "op12_periodic_runs": periodic.op12_periodic_runs,
        "op13_best_fit_packing": bestfit.op13_best_fit_packing,
        "op1_quality_classifier": quality.op1_quality_classifier,
        "op2_packing": packing.op2_packing,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_chat_formatting": chat.op4_chat_formatting,
        "op5_substring_dedup": substring.op5_substring_dedup,
        "op6_language_id": langid.op6_language_id,
        "op7_sharding": sharding.op7_sharding,
        "op8_decontamination": decontam.op8_decontamination,
        "op9_simhash": simhash.op9_simhash,
    }


def oracle_sql():
    return {"op11_ranked_search": search.SQL, "op12_periodic_runs": periodic.SQL, "op3_exact_dedup": exact_dedup.SQL, "op4_chat_formatting": chat.SQL, "op5_substring_dedup": substring.SQL}
