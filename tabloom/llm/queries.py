"""Registered queries of this subpackage and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tabloom.llm import bpe, chat, decontam, merkle, pii, prefixtrie, quality, rangejoin, secrets, simhash, tokenfiles, topk, urlfilter

QUERIES: dict[str, Callable[..., DataFrame]] = {
    "op1_url_equivalence": urlfilter.op1_url_equivalence,
    "op2_linked_secrets": secrets.op2_linked_secrets,
    "op3_byte_cnn": quality.op3_byte_cnn,
    "op4_bpe_rank_queue": bpe.op4_bpe_rank_queue,
    "op5_token_files": tokenfiles.op5_token_files,
    "op6_impact_topk": topk.op6_impact_topk,
    "op7_simhash": simhash.op7_simhash,
    "op8_prefix_targets": chat.op8_prefix_targets,
    "op9_information_pii": pii.op9_information_pii,
    "op10_pigeonhole_edits": decontam.op10_pigeonhole_edits,
    "op11_metric_join": rangejoin.op11_metric_join,
    "op12_merkle": merkle.op12_merkle,
    "op13_prefix_trie": prefixtrie.op13_prefix_trie,
}
ORACLES: dict[str, str] = {
    "op1_url_equivalence": urlfilter.OP1_SQL,
    "op6_impact_topk": topk.OP6_SQL,
    "op8_prefix_targets": chat.OP8_SQL,
    "op11_metric_join": rangejoin.OP11_SQL,
    "op12_merkle": merkle.OP12_SQL,
    "op13_prefix_trie": prefixtrie.OP13_SQL,
}
