"""Queries of this subpackage and, where SQL can express one, its equivalent for DuckDB."""

from . import op1_fingerprints as op1
from . import op2_url_filter as op2
from . import op3_sentencepiece as op3
from . import op4_exact_dedup as op4
from . import op5_substring_dedup as op5
from . import op6_token_files as op6
from . import op7_quality as op7
from . import op8_ngram_join as op8
from . import op9_packing as op9
from . import op10_suffix_dedup as op10

QUERIES = {
    "op1_fingerprints": op1.query,
    "op2_url_filter": op2.query,
    "op3_sentencepiece": op3.query,
    "op4_exact_dedup": op4.query,
    "op5_substring_dedup": op5.query,
    "op6_token_files": op6.query,
    "op7_quality": op7.query,
    "op8_ngram_join": op8.query,
    "op9_packing": op9.query,
    "op10_suffix_dedup": op10.query,
}
SQL = {
    "op4_exact_dedup": op4.SQL,
}
