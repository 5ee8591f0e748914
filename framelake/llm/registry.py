"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import oracle
from .op01_license import op1_licences
from .op02_packing import op2_packing
from .op03_chat import OP3_SQL, op3_chat_rotation
from .op04_langid import op4_language_id
from .op05_wavelet import op5_token_shards
from .op06_secrets import op6_secrets
from .op07_suffix import op7_repeats
from .op08_minhash import op8_near_duplicates
from .op09_decontaminate import op9_decontamination
from .op10_mpeg import op10_mpeg_audio

QUERIES = {f.__name__: f for f in (op1_licences, op2_packing, op3_chat_rotation, op4_language_id, op5_token_shards, op6_secrets, op7_repeats, op8_near_duplicates, op9_decontamination, op10_mpeg_audio)}
ORACLE_SQL: dict[str, str] = {"op3_chat_rotation": OP3_SQL, "op7_repeats": oracle.REPEATS, "op8_near_duplicates": oracle.NEAR_DUPLICATES}
