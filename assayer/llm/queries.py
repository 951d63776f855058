"""The registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import alignment, chat, convtrie, decontam, langid, linededup, minhash, pii, quality, secret_scan, sptok, tokenbin, toxicity


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_chat_format": chat.op2_chat_format,
        "op3_token_binary": tokenbin.op3_token_binary,
        "op4_quality_rules": quality.op4_quality_rules,
        "op5_language_id": langid.op5_language_id,
        "op6_minhash_near_dedup": minhash.op6_minhash_near_dedup,
        "op7_sentencepiece": sptok.op7_sentencepiece,
        "op8_secret_scan": secret_scan.op8_secret_scan,
        "op9_benchmark_decontamination": decontam.op9_benchmark_decontamination,
        "op10_pii": pii.op10_pii,
        "op11_token_alignment": alignment.op11_token_alignment,
        "op12_conversation_trie": convtrie.op12_conversation_trie,
        "op13_line_dedup": linededup.op13_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": chat.OP2_SQL, "op6_minhash_near_dedup": minhash.OP6_SQL, "op12_conversation_trie": convtrie.OP12_SQL, "op13_line_dedup": linededup.OP13_SQL}
