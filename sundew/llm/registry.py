"""Queries of this package for the driver."""

from __future__ import annotations

import corpus_pipeline

from . import decontaminate, secrets
from .ann import op7_collision_counting
from .decontaminate import op5_containment
from .language import op10_ppm_language
from .lm_score import op4_deleted_interpolation
from .mixing import op1_cube_mix
from .near_dups import op3_bottom_k
from .pii import op8_lstm_crf
from .quality import op6_weak_quality
from .secrets import op9_trigram_secrets
from .token_files import op2_token_files

OPERATORS = (op1_cube_mix, op2_token_files, op3_bottom_k, op4_deleted_interpolation, op5_containment, op6_weak_quality, op7_collision_counting, op8_lstm_crf, op9_trigram_secrets, op10_ppm_language)


def queries():
    return {f.__name__: f for f in OPERATORS} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    """For the others there is no SQL: they learn, draw, tokenize or search; tests hold them against brute force."""
    return {"op5_containment": decontaminate.SQL, "op9_trigram_secrets": secrets.SQL}
