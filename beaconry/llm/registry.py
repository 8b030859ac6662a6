"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from beaconry.llm import bpe, decontaminate, fim, jaccard, katz, language, negatives, pii, quality, repeats, token_counts, topk, warc


def queries() -> dict:
    return {
        "op1_pii_bootstrap": pii.op1_pii_bootstrap,
        "op2_katz_backoff": katz.op2_katz_backoff,
        "op3_suffix_decontamination": decontaminate.op3_suffix_decontamination,
        "op4_warc_revisits": warc.op4_warc_revisits,
        "op5_substring_dedup": repeats.op5_substring_dedup,
        "op6_language_id": language.op6_language_id,
        "op7_partenum_jaccard": jaccard.op7_partenum_jaccard,
        "op8_bpe_codec": bpe.op8_bpe_codec,
        "op9_maxscore_topk": topk.op9_maxscore_topk,
        "op10_token_counts": token_counts.op10_token_counts,
        "op11_rns_hard_negatives": negatives.op11_rns_hard_negatives,
        "op12_attention_mil": quality.op12_attention_mil,
        "op13_skip_list_fim": fim.op13_skip_list_fim,
    }


def oracle_sql() -> dict:
    return {
        "op2_katz_backoff": katz.ORACLE,
        "op3_suffix_decontamination": decontaminate.ORACLE,
        "op4_warc_revisits": warc.ORACLE,
        "op5_substring_dedup": repeats.ORACLE,
        "op7_partenum_jaccard": jaccard.ORACLE,
        "op9_maxscore_topk": topk.ORACLE,
        "op11_rns_hard_negatives": negatives.ORACLE,
        "op13_skip_list_fim": fim.ORACLE,
    }
