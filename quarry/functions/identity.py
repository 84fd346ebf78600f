"""Keys as pure hashes, so that recomputing them on any executor gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\x00"


def joined_key(*parts: Column, length: int = 64) -> Column:
    """SHA-256 of parts joined by NUL, cut to ``length`` hexadecimal digits; null if a part is."""
    text = parts[0].cast("string")
    for part in parts[1:]:
        text = F.concat(text, F.chr(F.lit(0)), part.cast("string"))
    return F.substring(F.sha2(text, 256), 1, length)


def record_id(conversation: Column, event: Column) -> Column:
    """Identity of a record; null unless both parts are there and not empty."""
    whole = (F.length(conversation.cast("string")) > 0) & (F.length(event.cast("string")) > 0)
    return F.when(whole, joined_key(conversation, event))


def candidate_id(claim_key: Column) -> Column:
    return F.substring(F.sha2(claim_key, 256), 1, 24)


def sample_rank(identifier: Column) -> Column:
    """A fixed random order."""
    return F.sha2(F.concat(F.lit("curate-sample:"), identifier), 256)
