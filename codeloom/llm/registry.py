"""Queries of this package, and DuckDB SQL for those that SQL can express."""

from .decontaminate import op7_decontaminate
from .filter_audit import OP12_SQL, op12_filter_audit
from .hard_negatives import OP13_SQL, op13_hard_negatives
from .html_extract import op3_html_extract
from .lm_scoring import op5_lm_scoring
from .mixing import OP2_SQL, op2_mix_sources
from .ngram_join import OP8_SQL, op8_jaccard_join
from .quality_classifier import op4_quality_classifier
from .quality_rules import op6_quality_rules
from .ring_shards import op11_ring_shards
from .secrets import op1_secret_scan
from .suffix_dedup import op10_suffix_dedup
from .token_counts import op9_token_counts

QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_mix_sources, op3_html_extract, op4_quality_classifier, op5_lm_scoring, op6_quality_rules, op7_decontaminate, op8_jaccard_join, op9_token_counts, op10_suffix_dedup, op11_ring_shards, op12_filter_audit, op13_hard_negatives)}
ORACLES: dict[str, str] = {"op2_mix_sources": OP2_SQL, "op8_jaccard_join": OP8_SQL, "op12_filter_audit": OP12_SQL, "op13_hard_negatives": OP13_SQL}
