"""What is put into the driver's tables by key, for both sides."""

from __future__ import annotations

MARKERS = ["", "\u200b", "\u202e", "\u00a0", "\U000e0061\U000e0061", "\u2764\ufe0f", "\U0001f468\u200d\U0001f469", "x\ufe0f"]
MARKER_SQL = [" || ".join(f"chr({ord(c)})" for c in m) or "''" for m in MARKERS]
SIGNATURES = ["FFD8FFE000104A4649460001", "89504E470D0A1A0A0000000D", "524946460000000057454250", "474946383961000000000000", "255044462D312E370A000000", "424D00000000000000000000", "49492A000000000000000000", "4D4D002A0000000000000000", "000000186674797061766966", "000000186674797068656963", "3C7376672077696474683D22", "2320746974"]
GENERATOR_CYCLE = ["Midjourney", "hugo", "ComfyUI v2", "plain editor"]
