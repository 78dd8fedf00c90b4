"""Queries of this subpackage and their SQL twins."""

from __future__ import annotations

from gleanery.llm.archives import OP9_SQL, op9_warc
from gleanery.llm.block_labeller import op10_main_text
from gleanery.llm.cube import op6_mix
from gleanery.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from gleanery.llm.impact_index import OP8_SQL, op8_top_k
from gleanery.llm.merkle import OP12_SQL, op12_manifest
from gleanery.llm.packing import op11_packing
from gleanery.llm.personal_data import op3_personal_data
from gleanery.llm.preference import op1_quality
from gleanery.llm.simhash import op2_near_duplicates
from gleanery.llm.suffix_arrays import op5_decontaminate
from gleanery.llm.token_files import op7_token_files
from gleanery.llm.toxicity import op4_toxicity


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_quality": op1_quality,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_personal_data": op3_personal_data,
    "op4_toxicity": op4_toxicity,
    "op5_decontaminate": op5_decontaminate,
    "op6_mix": op6_mix,
    "op7_token_files": op7_token_files,
    "op8_top_k": op8_top_k,
    "op9_warc": op9_warc,
    "op10_main_text": op10_main_text,
    "op11_packing": op11_packing,
    "op12_manifest": op12_manifest,
    "op13_hard_negatives": op13_hard_negatives,
    "pipeline": pipeline,
}

ORACLE: dict[str, str] = {
    "op8_top_k": OP8_SQL,
    "op9_warc": OP9_SQL,
    "op12_manifest": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
