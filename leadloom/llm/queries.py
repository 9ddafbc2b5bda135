"""The queries of the corpus operators, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from .dedup import op3_minhash_bayes
from .divergence import ORACLE as DIVERGENCE_ORACLE
from .divergence import op13_count_columns
from .hamming import ORACLE as HAMMING_ORACLE
from .hamming import op1_multi_index_hashing
from .langid import op6_crf_language
from .lexical import ORACLE as LEXICAL_ORACLE
from .lexical import op11_impact_postings
from .lm_score import op8_context_tree
from .mixing import ORACLE as MIXING_ORACLE
from .mixing import op12_capped_water_filling
from .nbest import op10_nbest_segmentation
from .packing import op9_best_two_fit
from .permutation_index import op5_permutation_index
from .quotes import op2_quotation_links
from .secret_scan import ORACLE as SECRETS_ORACLE
from .secret_scan import op7_ownership_frequency
from .url_lists import op4_temporal_list_join

QUERIES = {
    "op1_multi_index_hashing": op1_multi_index_hashing,
    "op2_quotation_links": op2_quotation_links,
    "op3_minhash_bayes": op3_minhash_bayes,
    "op4_temporal_list_join": op4_temporal_list_join,
    "op5_permutation_index": op5_permutation_index,
    "op6_crf_language": op6_crf_language,
    "op7_ownership_frequency": op7_ownership_frequency,
    "op8_context_tree": op8_context_tree,
    "op9_best_two_fit": op9_best_two_fit,
    "op10_nbest_segmentation": op10_nbest_segmentation,
    "op11_impact_postings": op11_impact_postings,
    "op12_capped_water_filling": op12_capped_water_filling,
    "op13_count_columns": op13_count_columns,
}
ORACLES: dict[str, str] = {
    "op1_multi_index_hashing": HAMMING_ORACLE,
    "op7_ownership_frequency": SECRETS_ORACLE,
    "op11_impact_postings": LEXICAL_ORACLE,
    "op12_capped_water_filling": MIXING_ORACLE,
    "op13_count_columns": DIVERGENCE_ORACLE,
}
