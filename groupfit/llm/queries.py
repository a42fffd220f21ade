"""Queries of the operators in this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import chat, mixing, near_copies, packing, pseudo_likelihood, quality, secret_scan, substrings, top_k, url_rules

QUERIES = {
    "op1_min_cost_mixing": mixing.query,
    "op2_pseudo_likelihood": pseudo_likelihood.query,
    "op3_super_kmers": substrings.query,
    "op4_order_minhash": near_copies.query,
    "op5_weak_supervision": quality.query,
    "op6_sorted_lists": top_k.query,
    "op7_typed_chat": chat.query,
    "op8_best_two_fit": packing.query,
    "op9_url_rules": url_rules.query,
    "op10_randomness_battery": secret_scan.query,
}

ORACLES = {"op6_sorted_lists": top_k.SQL, "op7_typed_chat": chat.SQL, "op9_url_rules": url_rules.SQL}
