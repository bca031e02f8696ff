"""Queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import fingerprints, langid, mixing, neardup, packing, quality_model, quality_rules, toxicity, urls, warc

QUERIES = {f.__name__: f for f in (packing.op1_packing, mixing.op2_mixing, warc.op3_warc, langid.op4_langid, urls.op5_url_filters, quality_model.op6_quality_classifier, fingerprints.op7_fingerprints, quality_rules.op8_quality_rules, toxicity.op9_toxicity, neardup.op10_near_duplicates)}

ORACLES = {"op2_mixing": mixing.ORACLE, "op3_warc": warc.ORACLE, "op8_quality_rules": quality_rules.ORACLE}
