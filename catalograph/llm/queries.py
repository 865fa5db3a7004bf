"""Registered queries of the training-data operators, and the SQL that gives the same rows."""

from __future__ import annotations

from . import bpe, codes, counts, embeddings, gif, licences, lines, mixing, neardup, search, secrets, substrings, toxicity


def queries() -> dict:
    return {
        "op1_temperature_mix": mixing.op1_temperature_mix,
        "op2_secret_ledger": secrets.op2_secret_ledger,
        "op3_gif_media": gif.op3_gif_media,
        "op4_line_runs": lines.op4_line_runs,
        "op5_hyperminhash": neardup.op5_hyperminhash,
        "op6_itq_hamming": embeddings.op6_itq_hamming,
        "op7_template_join": licences.op7_template_join,
        "op8_seed_extend": substrings.op8_seed_extend,
        "op9_string_kernel": toxicity.op9_string_kernel,
        "op10_byte_bpe": bpe.op10_byte_bpe,
        "op11_ball_codes": codes.op11_ball_codes,
        "op12_aho_corasick_search": search.op12_aho_corasick_search,
        "op13_whole_token_counts": counts.op13_whole_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_temperature_mix": mixing.SQL,
        "op2_secret_ledger": secrets.SQL,
        "op4_line_runs": lines.SQL,
        "op6_itq_hamming": embeddings.SQL,
        "op7_template_join": licences.SQL,
        "op8_seed_extend": substrings.SQL,
        "op11_ball_codes": codes.SQL,
        "op12_aho_corasick_search": search.SQL,
    }
