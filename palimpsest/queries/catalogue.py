"""Imports every module that registers queries."""

from palimpsest.queries import align_q, downstream_q, dumps_q, em_q, evidence_q, io_q, mining_q, score_q, script_q, synth_q, tokens_q, typed_q  # noqa: F401
