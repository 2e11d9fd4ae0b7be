"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from . import op2_mixing, op3_warc, op4_chat, op10_exact, op11_phrases  # the modules, before names shadow them
from .op1_embeddings import op1_embedding_near_dedup
from .op2_mixing import op2_mixing as op2
from .op3_warc import op3_warc_revisits
from .op4_chat import op4_chat_examples
from .op5_secrets import op5_secret_scan
from .op6_language import op6_language_id
from .op7_minhash import op7_minhash_near_dedup
from .op8_pieces import op8_sentencepiece
from .op9_quality import op9_quality
from .op10_exact import op10_exact_dedup
from .op11_phrases import op11_collocations
from .op12_runs import op12_periodic_runs
from .op13_private import op13_personal_data

QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup,
        op2,
        op3_warc_revisits,
        op4_chat_examples,
        op5_secret_scan,
        op6_language_id,
        op7_minhash_near_dedup,
        op8_sentencepiece,
        op9_quality,
        op10_exact_dedup,
        op11_collocations,
        op12_periodic_runs,
        op13_personal_data,
    )
}

ORACLES = {
    "op2_mixing": op2_mixing.ORACLE_SQL,
    "op3_warc_revisits": op3_warc.ORACLE_SQL,
    "op4_chat_examples": op4_chat.ORACLE_SQL,
    "op10_exact_dedup": op10_exact.ORACLE_SQL,
    "op11_collocations": op11_phrases.ORACLE_SQL,
}
