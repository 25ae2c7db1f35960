"""The queries of this subpackage and the SQL that DuckDB can check them with."""

from __future__ import annotations

from docgraph.llm import archives, bpe, fim, jaccard, language, mixing, neighbours, pages, planes, quotes, repeats, runs, webp

QUERIES = {
    "op1_lossless_webp": webp.op1_lossless_webp,
    "op2_arc_to_warc": archives.op2_arc_to_warc,
    "op3_jaccard_join": jaccard.op3_jaccard_join,
    "op4_language_id": language.op4_language_id,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_main_text": pages.op6_main_text,
    "op7_substring_dedup": repeats.op7_substring_dedup,
    "op8_nearest": neighbours.op8_nearest,
    "op9_mixing": mixing.op9_mixing,
    "op10_quotation_linking": quotes.op10_quotation_linking,
    "op11_plane_files": planes.op11_plane_files,
    "op12_fill_in_middle": fim.op12_fill_in_middle,
    "op13_periodic_runs": runs.op13_periodic_runs,
}

ORACLES = {"op7_substring_dedup": repeats.ORACLE_SQL, "op10_quotation_linking": quotes.ORACLE_SQL, "op12_fill_in_middle": fim.ORACLE_SQL}
