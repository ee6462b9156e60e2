"""The queries of this subpackage and the SQL of those that SQL can express."""

from .chat import OP6_SQL, op6_chat
from .decontaminate import OP3_SQL, op3_decontaminate
from .embeddings import op8_embeddings
from .jaccard import OP2_SQL, op2_jaccard
from .language import op4_language
from .pieces import op5_pieces
from .pii import op7_pii
from .quality import op1_quality
from .sharding import op10_shards
from .toxicity import op9_toxicity

QUERIES = {f.__name__: f for f in (op1_quality, op2_jaccard, op3_decontaminate, op4_language, op5_pieces, op6_chat, op7_pii, op8_embeddings, op9_toxicity, op10_shards)}
SQL = {"op2_jaccard": OP2_SQL, "op3_decontaminate": OP3_SQL, "op6_chat": OP6_SQL}
