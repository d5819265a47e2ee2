"""The subpackage's queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, minhash, mixing, neighbours, quality, secrets, sharding, sstable, toxicity, urls
from .oracles import ORACLE_SQL

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_neighbours": neighbours.op2_neighbours,
    "op3_minhash": minhash.op3_minhash,
    "op4_secrets": secrets.op4_secrets,
    "op5_urls": urls.op5_urls,
    "op6_quality": quality.op6_quality,
    "op7_sharding": sharding.op7_sharding,
    "op8_sstable": sstable.op8_sstable,
    "op9_mixing": mixing.op9_mixing,
    "op10_toxicity": toxicity.op10_toxicity,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
