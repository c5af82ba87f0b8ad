"""Registered queries of the corpus operators."""

from __future__ import annotations

from . import lexical_search, prefix_trie, quality_rules, topk_search
from .bpe import op7_bpe
from .fingerprints import op10_fingerprints
from .kneser_ney import op3_quality_classifier
from .lexical_search import op12_lexical_search
from .license_scan import op8_license_scan
from .lm_scoring import op5_lm_score
from .mixing import op9_mixture
from .prefix_trie import op13_prefix_trie
from .quality_rules import op6_quality_rules
from .secret_scan import op4_secret_scan
from .topk_search import op11_topk_search
from .url_filter import op1_url_filter
from .simhash_dedup import op2_simhash

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_simhash": op2_simhash,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_secret_scan": op4_secret_scan,
    "op5_lm_score": op5_lm_score,
    "op6_quality_rules": op6_quality_rules,
    "op7_bpe": op7_bpe,
    "op8_license_scan": op8_license_scan,
    "op9_mixture": op9_mixture,
    "op10_fingerprints": op10_fingerprints,
    "op11_topk_search": op11_topk_search,
    "op12_lexical_search": op12_lexical_search,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op6_quality_rules": quality_rules.ORACLE, "op11_topk_search": topk_search.ORACLE, "op12_lexical_search": lexical_search.ORACLE, "op13_prefix_trie": prefix_trie.ORACLE,
}
