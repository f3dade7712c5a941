"""Small constant tables: signals, formats, presets, generators, roles. Fixed values, as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.needles import Needles

# id, category, axis, detect, remove, verify
SIGNALS = [
    (s[0], s[1], s[2], *(x == "T" for x in s[3]))
    for s in (line.split() for line in """
c2pa provenance provenance TTT
ai-generator provenance provenance TTT
synthid provenance detector FFF
exif metadata privacy TTT
xmp metadata provenance TTT
iptc metadata privacy TTT
embedded-text metadata provenance TTT
gps privacy privacy TTT
timestamp privacy privacy TTT
device privacy privacy TTT
software privacy privacy TTT
author privacy privacy TTT
active-content privacy privacy TTT
remote-reference privacy privacy TTT
prior-revisions privacy privacy TFF
hidden-unicode hidden detector TTT
claude-watermark hidden detector FFF
icc metadata privacy TFT
""".split("\n") if line)
]
# format, label, mime, extension, kind, support
FORMATS = [
    ("jpeg", "JPEG", "image/jpeg", "jpg", "image", "clean"),
    ("png", "PNG", "image/png", "png", "image", "clean"),
    ("webp", "WebP", "image/webp", "webp", "image", "clean"),
    ("svg", "SVG", "image/svg+xml", "svg", "text", "clean"),
    ("markdown", "Markdown", "text/markdown", "md", "text", "clean"),
    ("pdf", "PDF", "application/pdf", "pdf", "document", "clean"),
]
PRESETS = [
    ("everything", ["exif", "iptc", "xmp", "c2pa", "embedded-text"]),
    ("privacy-safe", ["exif", "iptc"]),
    ("provenance-light", ["c2pa", "xmp", "embedded-text"]),
]
# name, needles in lower case; the first row with a needle in the text wins
GENERATORS = [
    ("ChatGPT / DALL·E (OpenAI)", ["chatgpt", "dall-e", "dall·e", "dalle", "openai", "gpt-image"]),
    ("Google Gemini / Imagen", ["gemini", "imagen", "made with google ai", "google ai studio"]),
    ("Midjourney", ["midjourney"]),
    ("Adobe Firefly", ["firefly", "adobe firefly"]),
    ("Stable Diffusion", ["stable diffusion", "stablediffusion", "sdxl", "automatic1111", "a1111"]),
    ("ComfyUI", ["comfyui", "comfy_ui"]),
    ("InvokeAI", ["invokeai", "invoke ai"]),
    ("NovelAI", ["novelai"]),
    ("FLUX (Black Forest Labs)", ["flux", "black forest labs"]),
    ("Grok / xAI", ["grok", "xai", "aurora"]),
    ("Ideogram", ["ideogram"]),
    ("Leonardo.Ai", ["leonardo.ai", "leonardo ai"]),
    ("Recraft", ["recraft"]),
    ("Meta AI", ["meta ai", "imagine with meta", "emu"]),
    ("Canva", ["canva"]),
    ("Freepik", ["freepik"]),
    ("Krea", ["krea"]),
    ("Runway", ["runway", "runwayml"]),
    ("Luma", ["luma ai", "dream machine"]),
    ("Bing Image Creator", ["bing image creator", "designer.microsoft"]),
]
PNG_KEYS = {
    "parameters": "Stable Diffusion (AUTOMATIC1111)", "prompt": "ComfyUI", "workflow": "ComfyUI", "sd-metadata": "InvokeAI", "invokeai_metadata": "InvokeAI",
    "invokeai_graph": "InvokeAI", "dream": "InvokeAI (legacy)", "aigc-meta": "AIGC metadata", "generation_data": "AI image generator",
}
ROLES = {
    "ai": "ai ai_generated ai-generated aigenerated ai_model generated_by generated-by generatedby model prompt prompts negative_prompt system_prompt llm assistant chatgpt claude gpt copilot midjourney stable_diffusion seed sampler cfg_scale",
    "tool": "generator tool software engine exported_by exported-by editor",
    "author": "author authors creator creators byline contributor copyright rights",
    "timestamp": "date created created_at createdat updated updated_at modified lastmod publishdate published pubdate datepublished datemodified",
}
ROLE_OF = {key: role for role, keys in ROLES.items() for key in keys.split()}
REMOVED_ROLES = ("ai", "tool", "author", "timestamp")


def signals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*s, i) for i, s in enumerate(SIGNALS)], "signal_id string, category string, axis string, detect boolean, remove boolean, verify boolean, ord int")


def formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FORMATS, "format string, label string, mime string, extension string, kind string, support string")


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRESETS, "preset string, blocks array<string>")


def verdict(detect: Column, remove: Column, verify: Column) -> Column:
    removable = F.when(verify, "removable_verified").otherwise("removable_unverified")
    return F.when(detect, F.when(remove, removable).otherwise("detect_only")).otherwise("unable_to_verify")


GENERATOR_NEEDLES = Needles([(needle, name) for name, needles in GENERATORS for needle in needles])


def generator_of(text: Column) -> Column:
    """The first generator one of whose needles the text holds, whatever the case."""
    return GENERATOR_NEEDLES.first_name(F.lower(text))


def role_of(key: Column) -> Column:
    """The role of a front-matter or meta key, 'other' if it has none."""
    lower, out = F.lower(key), F.lit("other")
    for role, keys in ROLES.items():
        out = F.when(lower.isin(*keys.split()), role).otherwise(out)
    return out


def png_generator(key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in PNG_KEYS.items() for x in kv]), key)
