"""Queries of the corpus operators and their SQL."""
from . import exact_dedup, fill_middle, fingerprints, html_text, language, near_dedup, packing, periodic_runs, piece_scan, secrets, substring_dedup, token_counts, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        piece_scan.op1_piece_scan, exact_dedup.op2_exact_dedup, fingerprints.op3_fingerprints, toxicity.op4_toxicity, token_counts.op5_token_counts, near_dedup.op6_near_dedup,
        packing.op7_packing, language.op8_language, html_text.op9_html_text, secrets.op10_secrets, fill_middle.op11_fill_middle, periodic_runs.op12_periodic_runs,
        substring_dedup.op13_substring_dedup)
}
SQL = {"op2_exact_dedup": exact_dedup.SQL, "op11_fill_middle": fill_middle.SQL}
