"""The corpus operators' queries and the SQL of those that SQL can express."""

from __future__ import annotations

from pairloom.llm import decontaminate, htmltext, licenses, mixing, quality, secrets, simhash, spotsigs, tokenfiles, toxicity

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_bm25_decontamination": decontaminate.op2_bm25_decontamination,
    "op3_simhash_near_dup": simhash.op3_simhash_near_dup,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_token_files": tokenfiles.op5_token_files,
    "op6_compression_toxicity": toxicity.op6_compression_toxicity,
    "op7_nbsvm_quality": quality.op7_nbsvm_quality,
    "op8_spotsigs_fingerprints": spotsigs.op8_spotsigs_fingerprints,
    "op9_line_block_text": htmltext.op9_line_block_text,
    "op10_pareto_mix": mixing.op10_pareto_mix,
}
ORACLE_SQL = {"op4_secret_scan": secrets.OP4_SQL, "op10_pareto_mix": mixing.OP10_SQL}
