"""The corpus queries and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from pagewright.llm.collocations import OP13_SQL, op13_collocations
from pagewright.llm.decontamination import OP5_SQL, op5_decontamination
from pagewright.llm.language import op7_language_id
from pagewright.llm.media import op3_audio_fingerprints
from pagewright.llm.mixing import OP1_SQL, op1_source_mix
from pagewright.llm.pages import op6_html_extraction
from pagewright.llm.simhash import op9_simhash_dedup
from pagewright.llm.substrings import OP8_SQL, op8_substring_dedup
from pagewright.llm.suffixes import op2_suffix_dedup
from pagewright.llm.token_files import op10_token_files
from pagewright.llm.token_alignment import op11_token_alignment
from pagewright.llm.toxicity import op4_toxicity
from pagewright.llm.url_filters import OP12_SQL, op12_url_filters

QUERIES = {
    "op3_audio_fingerprints": op3_audio_fingerprints,
    "op6_html_extraction": op6_html_extraction,
    "op4_toxicity": op4_toxicity,
    "op7_language_id": op7_language_id,
    "op5_decontamination": op5_decontamination,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op9_simhash_dedup": op9_simhash_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op1_source_mix": op1_source_mix,
    "op10_token_files": op10_token_files,
    "op11_token_alignment": op11_token_alignment,
    "op12_url_filters": op12_url_filters,
    "op13_collocations": op13_collocations,
}
ORACLES = {
    "op5_decontamination": OP5_SQL,
    "op8_substring_dedup": OP8_SQL,
    "op1_source_mix": OP1_SQL,
    "op12_url_filters": OP12_SQL,
    "op13_collocations": OP13_SQL,
}
