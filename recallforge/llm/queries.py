"""The queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from . import collocations, decontaminate, mixing, near_dups, quality_rules, substrings
from .alignment import op11_token_alignment
from .collocations import op13_phrase_collocations
from .decontaminate import op8_benchmark_decontamination
from .html_text import op6_html_extraction
from .mixing import op9_poisson_mix
from .near_dups import op2_minhash_near_dedup
from .quality_model import op4_quality_classifier
from .quality_rules import op7_quality_rules
from .secrets import op10_secret_scans
from .simhash import op12_simhash_near_dedup
from .substrings import op3_substring_dedup
from .tokens import op5_token_counts
from .toxicity import op1_toxicity

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_minhash_near_dedup, op3_substring_dedup, op4_quality_classifier, op5_token_counts, op6_html_extraction, op7_quality_rules, op8_benchmark_decontamination, op9_poisson_mix, op10_secret_scans, op11_token_alignment, op12_simhash_near_dedup, op13_phrase_collocations)}
ORACLES = {"op2_minhash_near_dedup": near_dups.ORACLE, "op3_substring_dedup": substrings.ORACLE, "op7_quality_rules": quality_rules.ORACLE, "op8_benchmark_decontamination": decontaminate.ORACLE, "op9_poisson_mix": mixing.ORACLE, "op13_phrase_collocations": collocations.ORACLE}
