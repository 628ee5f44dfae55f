"""The corpus operators' queries, and SQL where it can express them."""

from __future__ import annotations

from . import conversations, filter_audit, repeats
from .conversations import op12_conversation_repair
from .filter_audit import op13_filter_interactions
from .jaccard_join import op4_jaccard_join
from .langid import op6_language_id
from .licenses import op9_license_templates
from .media import op1_media_sequences
from .mixing import op3_entropy_mixing
from .neighbours import op8_learned_partitions
from .packing import op7_best_fit_packing
from .repeats import op11_repeated_spans
from .sharding import op2_label_propagation
from .token_files import op10_token_files
from .toxicity import op5_toxicity

QUERIES = {
    "op1_media_sequences": op1_media_sequences,
    "op2_label_propagation": op2_label_propagation,
    "op3_entropy_mixing": op3_entropy_mixing,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_toxicity": op5_toxicity,
    "op6_language_id": op6_language_id,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_learned_partitions": op8_learned_partitions,
    "op9_license_templates": op9_license_templates,
    "op10_token_files": op10_token_files,
    "op11_repeated_spans": op11_repeated_spans,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_filter_interactions": op13_filter_interactions,
}

#: The others' results cannot be told by SQL alone: they hash, learn, round or code. Tests hold them against brute
#: force, exact round trips and held-out accuracy.
ORACLE_SQL: dict[str, str] = {
    "op11_repeated_spans": repeats.ORACLE_SQL,
    "op12_conversation_repair": conversations.ORACLE_SQL,
    "op13_filter_interactions": filter_audit.ORACLE_SQL,
}
