"""Fixed tables against values written down here, so that a wrong table doesn't check itself."""

from traceloom.functions.hidden import CATEGORIES
from traceloom.functions.xmp import SOURCE_TYPES
from traceloom.plans import dims


def test_signals_and_formats():
    by = {s[0]: s[1:] for s in dims.SIGNALS}
    assert len(by) == 18
    assert by["synthid"] == ("provenance", "detector", False, False, False) and by["icc"] == ("metadata", "privacy", True, False, True)
    assert by["prior-revisions"] == ("privacy", "privacy", True, False, False) and by["gps"] == ("privacy", "privacy", True, True, True)
    assert [f[0] for f in dims.FORMATS] == ["jpeg", "png", "webp", "svg", "markdown", "pdf"]
    assert dict(dims.PRESETS)["privacy-safe"] == ["exif", "iptc"]


def test_generators_and_keys():
    names = [g[0] for g in dims.GENERATORS]
    assert len(names) == 20 and names[:3] == ["ChatGPT / DALL·E (OpenAI)", "Google Gemini / Imagen", "Midjourney"] and names[-1] == "Bing Image Creator"
    assert dims.PNG_KEYS["parameters"] == "Stable Diffusion (AUTOMATIC1111)" and dims.PNG_KEYS["workflow"] == "ComfyUI" and len(dims.PNG_KEYS) == 9
    assert dims.ROLE_OF["seed"] == "ai" and dims.ROLE_OF["byline"] == "author" and dims.ROLE_OF["lastmod"] == "timestamp" and dims.ROLE_OF["editor"] == "tool"
    assert SOURCE_TYPES["trainedAlgorithmicMedia"][1] and not SOURCE_TYPES["algorithmicMedia"][1] and len(SOURCE_TYPES) == 10
    assert set(CATEGORIES) == {"zero-width", "bidi-control", "control", "unusual-space", "variation-selector", "tag-character"}
