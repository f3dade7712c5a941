"""The registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from .audio import documents_as_audio
from .bpe import round_trips
from .language import identify_languages
from .licenses import scan_licenses
from .mixing import mix
from .oracles import LICENSES, RESAMPLING, SEARCH, mixing
from .packing import pack_documents, public_vocabulary
from .passages import repeated_passages_and_runs
from .resampling import resample
from .search import search
from .secrets import find_secrets
from .sharding import shard_documents
from .shared import read
from .simhash import near_duplicates
from .sketches import fingerprint_versions

#: Words of a block of the mix: sources of ten thousand words come within a third of a percent of their targets.
MIX_BLOCK = 32


def op1_sharding(spark, sf_dir):
    return shard_documents(read(spark, sf_dir), shards=8)


def op2_secrets(spark, sf_dir):
    return find_secrets(read(spark, sf_dir))


def op3_language(spark, sf_dir):
    return identify_languages(read(spark, sf_dir))


def op4_fingerprints(spark, sf_dir):
    return fingerprint_versions(read(spark, sf_dir))


def op5_licenses(spark, sf_dir):
    return scan_licenses(read(spark, sf_dir))


def op6_packing(spark, sf_dir):
    return pack_documents(read(spark, sf_dir), capacity=2048)


def op7_passages(spark, sf_dir):
    return repeated_passages_and_runs(read(spark, sf_dir))


def op8_audio(spark, sf_dir):
    return documents_as_audio(read(spark, sf_dir), unit=576)


def op9_simhash(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir))


def op10_mixing(spark, sf_dir):
    return mix(read(spark, sf_dir), block=MIX_BLOCK)


def op11_search(spark, sf_dir):
    return search(read(spark, sf_dir), read(spark, sf_dir, "benchmark"))


def op12_resampling(spark, sf_dir):
    return resample(read(spark, sf_dir), read(spark, sf_dir, "benchmark"))


def op13_bpe(spark, sf_dir):
    return round_trips(read(spark, sf_dir), public_vocabulary())


_ALL = (op1_sharding, op2_secrets, op3_language, op4_fingerprints, op5_licenses, op6_packing, op7_passages, op8_audio, op9_simhash, op10_mixing, op11_search, op12_resampling, op13_bpe)
QUERIES = {f.__name__: f for f in _ALL}
#: The others are beyond SQL (automata, profiles, sketches, packing, decoders, iterated components); tests/llm holds each against a brute-force version.
ORACLE_SQL = {"op5_licenses": LICENSES, "op10_mixing": mixing(block=MIX_BLOCK), "op11_search": SEARCH, "op12_resampling": RESAMPLING}
