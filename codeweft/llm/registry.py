"""The operators' queries over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from codeweft.llm.exact_dedup import OP10_SQL, op10_exact_dedup
from codeweft.llm.fingerprints import op1_fingerprints
from codeweft.llm.licenses import op5_license_scan
from codeweft.llm.mixing import OP4_SQL, op4_mixing
from codeweft.llm.ngram_join import OP8_SQL, op8_ngram_jaccard
from codeweft.llm.packed_ids import op9_packed_ids
from codeweft.llm.piece_lattice import op6_sentencepiece
from codeweft.llm.quality import op7_quality
from codeweft.llm.secrets import op3_secret_scan
from codeweft.llm.substring_dedup import OP2_SQL, op2_substring_dedup

QUERIES = {
    f.__name__: f
    for f in (op1_fingerprints, op2_substring_dedup, op3_secret_scan, op4_mixing, op5_license_scan, op6_sentencepiece, op7_quality, op8_ngram_jaccard, op9_packed_ids, op10_exact_dedup)
}
SQL = {"op2_substring_dedup": OP2_SQL, "op4_mixing": OP4_SQL, "op8_ngram_jaccard": OP8_SQL, "op10_exact_dedup": OP10_SQL}
