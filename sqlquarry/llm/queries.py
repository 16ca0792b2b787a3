"""The subpackage's queries, and SQL for those that SQL can express."""

from .chat_repair import op6
from .decontaminate import ORACLE_OP10, op10
from .html_blocks import op3
from .media import op5
from .quality import op9
from .secrets import ORACLE_OP7, op7
from .sentencepiece_codec import op8
from .simhash import op4
from .token_counts import op1
from .url_rules import op2

QUERIES = {
    "op1_token_counts": op1,
    "op2_url_filters": op2,
    "op3_html_extraction": op3,
    "op4_simhash": op4,
    "op5_media_copies": op5,
    "op6_chat_repair": op6,
    "op7_secret_scan": op7,
    "op8_sentencepiece": op8,
    "op9_quality": op9,
    "op10_decontamination": op10,
}

ORACLES = {"op7_secret_scan": ORACLE_OP7, "op10_decontamination": ORACLE_OP10}
