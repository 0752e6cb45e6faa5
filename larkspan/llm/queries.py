"""The queries of this subpackage, by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from . import gif, hmm, jaccard, langid, linedup, mixing, nbsvm, packing, passages, rules

QUERIES = {"op1_mixing": mixing.op1_mixing, "op3_rules": rules.op3_rules, "op2_langid": langid.op2_langid, "op4_hmm": hmm.op4_hmm, "op5_quality": nbsvm.op5_quality, "op6_packing": packing.op6_packing, "op7_jaccard": jaccard.op7_jaccard, "op8_lines": linedup.op8_lines, "op9_chaining": passages.op9_chaining, "op10_gif": gif.op10_gif}
ORACLE: dict[str, str] = {"op8_lines": linedup.OP8_SQL}
