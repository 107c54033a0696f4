"""The queries of the training-data operators and the SQL that some of them equal."""

from __future__ import annotations

from . import ann, dedup, minhash, packing, quality, segmentation, sharding, substring, toxicity, wavelet

QUERIES = {"op1_sharding": sharding.op1_sharding, "op2_wavelet": wavelet.op2_wavelet, "op3_exact_dedup": dedup.op3_exact_dedup, "op4_substring_dedup": substring.op4_substring_dedup, "op5_nbest": segmentation.op5_nbest, "op6_ann": ann.op6_ann, "op7_quality": quality.op7_quality, "op8_toxicity": toxicity.op8_toxicity, "op9_minhash": minhash.op9_minhash, "op10_packing": packing.op10_packing}
ORACLES = {"op3_exact_dedup": dedup.ORACLE, "op4_substring_dedup": substring.ORACLE, "op9_minhash": minhash.ORACLE}
