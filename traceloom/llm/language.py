"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

import functools
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import whole_text

#: N-grams of a profile, and of a document that are compared with it.
PROFILE = 400
#: Labelled documents of a language that the profiles are learnt from at most, chosen by a seeded hash.
LEARN_DOCS = 4000
#: Characters counted at a time.
CHUNK = 1 << 20


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the text's n-grams of 1 to 3 letters; all between letters is one blank."""
    letters, parts, tail = _letters(), [], np.array([32])
    text = text.lower() + " "
    for at in range(0, len(text), CHUNK):
        points = np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "replace"), "<u4").astype(np.int64)
        points = np.concatenate([tail, np.where(letters[points], points, 32)])
        points = points[np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])]
        # n-grams that end in this chunk; they may begin in the last two letters of the one before
        old = len(tail)
        one, two = points[old:], points[:-1] << 21 | points[1:]
        three = two[:-1] << 21 | points[2:]
        parts.append(np.unique(np.concatenate([one[one != 32], two[old - 1 :], three[max(0, old - 2) :]]), return_counts=True))
        tail = points[-2:]
    if len(parts) == 1:
        return parts[0]
    codes, place = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(place, np.concatenate([n for _, n in parts])).astype(np.int64)


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")), F.lit(3)) == 1


def learn_profiles(docs: DataFrame, lang_col: str, text_col: str, id_col: str, most: int = LEARN_DOCS, size: int = PROFILE) -> dict[str, list[int]]:
    """The most frequent n-grams of each language, most frequent first.

    Learnt from at most about `most` labelled documents of each language, which a seeded hash of the
    id picks from all of them; counted as a Spark aggregation. The languages, and as many counts, are
    held by the driver, as are their profiles: languages are a list that people keep, not data that grows.
    """
    labelled = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return {}
    # a filter, not a join: texts stay in their partitions, and only tallies of n-grams are shuffled
    part = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, most / n)]), F.col("lang"))
    sample = labelled.filter(F.pmod(F.xxhash64(F.lit(11), F.col("id").cast("string")), F.lit(1_000_000)) < F.lit(1_000_000.0) * part).select("lang", "text")

    def count(batches):
        for pdf in batches:
            tallies = defaultdict(lambda: defaultdict(int))
            for lang, text in zip(pdf["lang"], pdf["text"]):
                tally = tallies[lang]
                for code, n in zip(*map(np.ndarray.tolist, gram_counts(text))):
                    tally[code] += n
            for lang, tally in tallies.items():
                yield pd.DataFrame({"lang": lang, "code": tally.keys(), "n": tally.values()})

    grams = sample.mapInPandas(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    top = grams.withColumn("rank", rank).filter(F.col("rank") <= size).collect()
    profiles = defaultdict(list)
    for row in sorted(top, key=lambda r: (r["lang"], r["rank"])):
        profiles[row["lang"]].append(row["code"])
    return dict(profiles)


def _table(profiles: dict[str, list[int]]):
    """Languages, all their n-grams sorted, and the rank of each in each profile (-1: not in it)."""
    langs = sorted(profiles)
    codes = np.unique(np.concatenate([np.array(profiles[x], np.int64) for x in langs])) if langs else np.empty(0, np.int64)
    ranks = np.full((len(langs), len(codes)), -1)
    for k, lang in enumerate(langs):
        ranks[k, np.searchsorted(codes, profiles[lang])] = np.arange(len(profiles[lang]))
    return langs, codes, ranks


def classify(text: str | None, table, size: int) -> tuple[str, float]:
    """The language whose profile is least out of place, and 1 minus that distance's part of the worst."""
    langs, codes, ranks = table
    found, counts = gram_counts(text or "")
    letters = found != 32 << 21 | 32
    found, counts = found[letters], counts[letters]
    if not langs or not len(found):
        return "und", 0.0
    found = found[np.lexsort((found, -counts))[:size]]
    place = np.minimum(np.searchsorted(codes, found), len(codes) - 1)
    there = ranks[:, place]
    out = np.where((there >= 0) & (codes[place] == found), np.abs(there - np.arange(len(found))), size).sum(1)
    best = int(out.argmin())  # a tie goes to the first language by name
    return langs[best], float(1 - out[best] / (size * len(found)))


def predict(docs: DataFrame, profiles: dict[str, list[int]], columns: list[str], text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """docs' `columns` with lang_pred and score. Uses the text alone, which may be one of the columns."""
    place = columns.index(text_col) if text_col in columns else len(columns)
    kept = docs.select(*columns, *[F.col(text_col).alias("_text")][: place == len(columns)])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "_text")

    def run(batches):
        table = _table(profiles)
        for batch in batches:
            found = [classify(text.as_py(), table, size) for text in batch.column(place)]
            new = [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(batch.columns[: len(columns)] + new, names=[*columns, "lang_pred", "score"])

    return kept.mapInArrow(run, f"{schema}, lang_pred string, score double")


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document.

    Learns from documents that are not held out (crc32 of the id as text, modulo 3, is 1) and have a
    language. Null texts, and texts without a letter, are 'und' with score 0; so are all where no
    document is labelled. A null doc_id counts as not held out. Repeated rows each have a row; an empty
    table gives no rows.
    """
    out = F.coalesce(held_out(id_col), F.lit(False))
    profiles = learn_profiles(docs.filter(~out), lang_col, text_col, id_col)
    kept = docs.select(F.col(id_col).alias("doc_id"), out.alias("held_out"), F.col(text_col).alias("text"))
    return predict(kept, profiles, ["doc_id", "held_out"])
