"""The queries of this subpackage, with SQL twins where SQL can say the same."""

from .alignment import op11_alignment
from .centroids import OP12_SQL, op12_drake
from .chat import OP2_SQL, op2_chat_roundtrip
from .exact_dedup import OP6_SQL, op6_exact_dedup
from .mixing import OP9_SQL, op9_mix_flow
from .packing import op13_sum_of_squares
from .quality import op1_quality_cnn
from .secrets import op5_secret_forest
from .simhash import op3_simhash
from .tiling import op10_decontaminate
from .token_planes import op4_token_planes
from .toxicity import op8_toxicity_kn
from .wordpiece import op7_wordpiece_counts

QUERIES = {f.__name__: f for f in (op1_quality_cnn, op2_chat_roundtrip, op3_simhash, op4_token_planes, op5_secret_forest, op6_exact_dedup, op7_wordpiece_counts, op8_toxicity_kn, op9_mix_flow, op10_decontaminate, op11_alignment, op12_drake, op13_sum_of_squares)}

ORACLES = {"op2_chat_roundtrip": OP2_SQL, "op6_exact_dedup": OP6_SQL, "op9_mix_flow": OP9_SQL, "op12_drake": OP12_SQL}
