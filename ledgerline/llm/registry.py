"""The queries of this subpackage."""

from __future__ import annotations

from .bwt import op11_suffix_array_dedup
from .infill import ORACLE_INFILL, op13_fill_in_middle
from .jaccard import op10_ngram_jaccard_join
from .licenses import ORACLE_LICENSES, op5_license_scan
from .merkle import ORACLE_MERKLE, op12_merkle_manifest
from .neighbours import op7_embedding_near_dedup
from .oracles import REPEATS, SIMILAR, VECTORS
from .packing import op1_harmonic_packing
from .pieces import op4_sentencepiece_roundtrip
from .sharding import op9_karmarkar_karp_sharding
from .substrings import op2_substring_dedup
from .topk import ORACLE_TOPK, op8_exact_topk
from .toxicity import op6_toxicity
from .warc import ORACLE_WARC, op3_warc_archive

QUERIES = {
    f.__name__: f
    for f in (
        op1_harmonic_packing,
        op2_substring_dedup,
        op3_warc_archive,
        op4_sentencepiece_roundtrip,
        op5_license_scan,
        op6_toxicity,
        op7_embedding_near_dedup,
        op8_exact_topk,
        op9_karmarkar_karp_sharding,
        op10_ngram_jaccard_join,
        op11_suffix_array_dedup,
        op12_merkle_manifest,
        op13_fill_in_middle,
    )
}
ORACLES: dict[str, str] = {
    "op2_substring_dedup": REPEATS,
    "op7_embedding_near_dedup": VECTORS,
    "op10_ngram_jaccard_join": SIMILAR,
    "op3_warc_archive": ORACLE_WARC,
    "op5_license_scan": ORACLE_LICENSES,
    "op8_exact_topk": ORACLE_TOPK,
    "op12_merkle_manifest": ORACLE_MERKLE,
    "op13_fill_in_middle": ORACLE_INFILL,
}
