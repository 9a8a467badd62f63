"""Registered queries of this folder and the SQL they are checked against."""

from __future__ import annotations

from sessionloom.llm.clustering import OP12_SQL, op12_clusters
from sessionloom.llm.extraction import op13_main_text
from sessionloom.llm.fingerprints import OP5_SQL, op5_fingerprints
from sessionloom.llm.language import op2_language
from sessionloom.llm.licenses import OP8_SQL, op8_licenses
from sessionloom.llm.lines import OP1_SQL, op1_line_dedup
from sessionloom.llm.mixing import op4_mixing
from sessionloom.llm.neardup import OP3_SQL, op3_near_duplicates
from sessionloom.llm.pieces import op6_pieces
from sessionloom.llm.quality import op10_quality
from sessionloom.llm.substrings import op7_substrings
from sessionloom.llm.vectors import OP9_SQL, op9_near_vectors
from sessionloom.llm.whitening import op11_whitening

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_language": op2_language,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_mixing": op4_mixing,
    "op5_fingerprints": op5_fingerprints,
    "op6_pieces": op6_pieces,
    "op7_substrings": op7_substrings,
    "op8_licenses": op8_licenses,
    "op9_near_vectors": op9_near_vectors,
    "op10_quality": op10_quality,
    "op11_whitening": op11_whitening,
    "op12_clusters": op12_clusters,
    "op13_main_text": op13_main_text,
}
ORACLES = {
    "op1_line_dedup": OP1_SQL,
    "op3_near_duplicates": OP3_SQL,
    "op5_fingerprints": OP5_SQL,
    "op8_licenses": OP8_SQL,
    "op9_near_vectors": OP9_SQL,
    "op12_clusters": OP12_SQL,
}
