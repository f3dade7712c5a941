"""Content credentials: facts of a JUMBF payload, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import cbor_after, latin

# Labels that every manifest has, and what speaks of generative AI.
STRUCTURAL = ("c2pa.claim", "c2pa.assertions", "c2pa.signature", "c2pa.manifest")
AI_HINTS = ("trainedalgorithmicmedia", "generative-ai", "generativeai", "c2pa.training-mining", "digitalsourcetype")
#: Bytes searched for labels and for hints, labels listed, and bytes of a generator's entry.
LABEL_WINDOW, HINT_WINDOW, LABELS, ENTRY = 1 << 20, 1 << 16, 12, 512


def c2pa_record(payload: Column) -> Column:
    """A struct of claim_generator, assertions, length, indicates_ai; null for a null or empty payload."""
    whole = latin(payload)
    text = F.substring(whole, 1, LABEL_WINDOW)
    labels = F.filter(F.regexp_extract_all(text, F.lit(r"(?i)c2pa\.[a-z0-9][a-z0-9._\-]{2,40}"), F.lit(0)), lambda x: ~F.lower(x).isin(*STRUCTURAL))
    info = F.substring(text, F.instr(text, "claim_generator_info"), F.lit(ENTRY))
    named = F.when(F.instr(text, "claim_generator_info") > 0, cbor_after(info, "name"))
    generator = F.trim(F.coalesce(named, cbor_after(whole, "claim_generator")))
    haystack = F.lower(F.concat_ws(" ", F.substring(text, 1, HINT_WINDOW), generator))
    hinted = F.exists(F.array(*map(F.lit, AI_HINTS)), lambda h: F.contains(haystack, h))
    record = F.struct(generator.alias("claim_generator"), F.slice(F.array_distinct(labels), 1, LABELS).alias("assertions"), F.octet_length(payload).alias("length"), hinted.alias("indicates_ai"))
    return F.when(F.octet_length(payload) > 0, record)
