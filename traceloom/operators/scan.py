"""Signals of a scanned file, by group, from what its records tell; lists and notes of a cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hidden import hidden_counts
from ..functions.texts import format_bytes, optional_value, sanitize_value
from ..plans.dims import generator_of, png_generator, signals
from .exif import orientation_label, show_position, turned
from .verify import status

#: Records named in a value, and characters of a record in which a generator is looked for.
NAMED, LOOKED_AT = 4, 2000
GROUPS = ("provenance", "metadata", "privacy", "hidden")


def generator(rows: str = "records") -> Column:
    """The generator that a file's records name first: XMP, EXIF software or make, the C2PA claim (as it stands if unknown), then texts by key or value."""
    claim = F.col("c2pa.claim_generator")
    texts = F.transform(rows, lambda r: F.coalesce(png_generator(F.lower(r["keyword"])), generator_of(F.substring(r["text"], 1, LOOKED_AT))))
    return F.coalesce(F.col("xmp.generator"), generator_of(F.col("exif.software")), generator_of(F.col("exif.make")), generator_of(claim), claim, F.get(F.array_compact(texts), F.lit(0)))


def signal(group: str, name: str, found: Column | str, value: Column | None = None) -> Column:
    """group, signal_id, status, value (display-safe, null if empty) of one signal."""
    shown = F.lit(None).cast("string") if value is None else F.nullif(sanitize_value(value), F.lit(""))
    state = F.lit(found) if isinstance(found, str) else status(F.coalesce(found, F.lit(False)))
    return F.struct(F.lit(group).alias("group"), F.lit(name).alias("signal_id"), state.alias("status"), shown.alias("value"))


def joined(*parts: Column) -> Column:
    """The parts that are there, with dots between; null if none is."""
    return F.nullif(F.concat_ws(" · ", *parts), F.lit(""))


def signal_rows(records: DataFrame) -> DataFrame:
    """item_id, group, ord, signal_id, status, value: the signals of image_records, group after group.

    Document formats may bring active_content and remote_refs (how many) and extra_text; where a
    column is missing or null, these signals have no row.
    """
    for name, kind in (("active_content", "int"), ("remote_refs", "int"), ("extra_text", "string")):
        if name not in records.columns:
            records = records.withColumn(name, F.lit(None).cast(kind))
    rows = records.withColumn("generator", generator())
    x = F.col
    told = F.filter("records", lambda r: (r["keyword"] != "") | (r["text"] != ""))
    names = F.array_join(F.transform(F.slice(told, 1, NAMED), lambda r: F.when(r["keyword"] != "", r["keyword"]).otherwise(r["source"])), ", ")
    has = lambda name: x(name).isNotNull()
    ai = F.coalesce(x("xmp.indicates_ai"), F.lit(False))
    first = lambda *names: F.coalesce(*[optional_value(x(n)) for n in names])
    plural = F.concat(x("exif.tag_count").cast("string"), F.when(x("exif.tag_count") == 1, " field").otherwise(" fields"))
    prose = F.concat_ws("\n", F.transform("records", lambda r: r["text"]), F.coalesce("xmp.description", F.lit("")), F.coalesce("xmp.title", F.lit("")), F.coalesce("exif.description", F.lit("")), F.coalesce("extra_text", F.lit("")))
    rows = rows.withColumns({
        "_time": first("exif.date_original", "exif.date_time", "xmp.create_date", "modified"), "_device": optional_value(F.concat_ws(" ", "exif.make", "exif.model")),
        "_software": first("exif.software", "xmp.creator_tool"), "_author": first("exif.artist", "xmp.creator", "exif.copyright", "xmp.rights"), "_hidden": hidden_counts(prose)["removable"],
    })
    c2pa = joined(F.concat(format_bytes(x("c2pa.length")), F.lit(" manifest")), x("c2pa.claim_generator"))
    every = [
        signal("provenance", "c2pa", has("c2pa"), F.when(has("c2pa"), c2pa)),
        signal("provenance", "ai-generator", has("generator") | ai, F.when(ai, joined(x("xmp.source_label"), x("generator"))).otherwise(x("generator"))),
        signal("provenance", "synthid", "unable_to_verify"),
        signal("metadata", "exif", has("exif"), plural),
        signal("metadata", "xmp", has("xmp"), F.when(has("xmp"), joined(format_bytes(x("xmp.length")), F.when(x("extended"), "extended")))),
        signal("metadata", "iptc", x("iptc")),
        signal("metadata", "embedded-text", F.size(told) > 0, names),
        signal("metadata", "icc", x("icc")),
        signal("privacy", "gps", x("exif.lat").isNotNull(), show_position(x("exif.lat"), x("exif.lon"))),
        *[signal("privacy", name, has(column), x(column)) for name, column in (("timestamp", "_time"), ("device", "_device"), ("software", "_software"), ("author", "_author"))],
        F.when(has("active_content"), signal("privacy", "active-content", x("active_content") > 0, F.when(x("active_content") > 0, F.concat(x("active_content").cast("string"), F.lit(" script or handler"))))),
        F.when(has("remote_refs"), signal("privacy", "remote-reference", x("remote_refs") > 0, F.when(x("remote_refs") > 0, F.concat(x("remote_refs").cast("string"), F.lit(" external URL"))))),
        signal("hidden", "hidden-unicode", x("_hidden") > 0, F.when(x("_hidden") > 0, F.concat(x("_hidden").cast("string"), F.lit(" in embedded text")))),
    ]
    return rows.select("item_id", F.posexplode(F.array_compact(F.array(*every))).alias("ord", "s")).select("item_id", "s.group", "ord", "s.signal_id", "s.status", "s.value")


def merge_embedded(carriers: DataFrame, item: str, order: str) -> DataFrame:
    """Records of images within a file, one row an item: the first EXIF, XMP and C2PA that is there, flags if any has them, all texts in order, and how many images tell anything."""
    tells = F.col("exif").isNotNull() | F.col("xmp").isNotNull() | F.col("c2pa").isNotNull() | F.col("iptc") | (F.size("records") > 0)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    texts = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, "records"))), lambda r: r["records"]))
    return carriers.groupBy(F.col(item).alias("item_id")).agg(*map(first, ("exif", "xmp", "c2pa", "modified")), *[F.bool_or(c).alias(c) for c in ("iptc", "icc", "extended")], texts.alias("records"), F.count_if(tells).alias("carriers"))


def found_per_group(rows: DataFrame) -> DataFrame:
    """item_id, group, found, total."""
    return rows.groupBy("item_id", "group").agg(F.count_if(F.col("status") == "detected").alias("found"), F.count("*").alias("total"))


def in_group_order(rows: DataFrame, focus: str | None = None) -> DataFrame:
    """Rows by group, the one in focus first, the others as they stand in GROUPS."""
    place = F.array_position(F.array(*map(F.lit, GROUPS)), F.col("group"))
    return rows.orderBy("item_id", F.when(F.col("group") == (focus or ""), 0).otherwise(place), "ord")


def notes(records: DataFrame) -> DataFrame:
    """item_id and what to tell beside the signals: a turned image, blocks that nothing here knows."""
    o = F.col("exif.orientation")
    orientation = F.when(turned(o), F.concat(F.lit("Orientation: "), orientation_label(o)))
    unknown = F.when(F.size("unknown") > 0, F.concat(F.lit("Unrecognised: "), F.array_join(F.col("unknown"), ", ")))
    return records.select("item_id", F.array_compact(F.array(orientation, unknown)).alias("notes"))


def outcome_lists(compared: DataFrame) -> DataFrame:
    """compare()'s rows, one an item: removed and remaining ids (in signal order), stubborn ones, and how many were detected before and removed."""
    ranked = compared.join(F.broadcast(signals(compared.sparkSession).select("signal_id", "ord")), "signal_id", "left")
    ids = lambda *outcomes: F.transform(F.array_sort(F.collect_list(F.when(F.col("outcome").isin(*outcomes), F.struct("ord", "signal_id")))), lambda s: s["signal_id"])
    return ranked.groupBy("item_id").agg(
        ids("removed").alias("removed"), ids("remaining", "unverifiable", "kept").alias("remaining"), ids("remaining").alias("stubborn"),
        F.count_if(F.col("before_status") == "detected").alias("before"), F.count_if(F.col("outcome") == "removed").alias("gone"),
    )
