"""The queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

import corpus_pipeline
from sdkatlas.llm import centroids, decontaminate, language, lm, packing, quality, rules, setsketch, tokenfile, toxicity, urls, warc, whitening

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_packing": packing.op2_packing,
    "op3_lm_score": lm.op3_lm_score,
    "op4_token_file": tokenfile.op4_token_file,
    "op5_warc": warc.op5_warc,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_url_filter": urls.op7_url_filter,
    "op8_language_id": language.op8_language_id,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_near_dedup": setsketch.op10_near_dedup,
    "op11_whitening": whitening.op11_whitening,
    "op12_centroid_clustering": centroids.op12_centroid_clustering,
    "op13_quality_classifier": rules.op13_quality_classifier,
    "pipeline": corpus_pipeline.run,
}
SQL = {"op5_warc": warc.SQL, "op6_quality_rules": quality.SQL, "op9_decontamination": decontaminate.SQL, "op10_near_dedup": setsketch.SQL,
       "op12_centroid_clustering": centroids.SQL}
