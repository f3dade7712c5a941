"""Files made from the driver's tables by key: guides, SVG, XMP packets, TIFF blocks, PNG and JPEG files, as expressions."""

from __future__ import annotations

import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A packet that declares generative AI, and a claim, both fixed texts.
PACKET = '<x:xmpmeta xmlns:x="adobe:ns:meta/" xmlns:dc="http://purl.org/dc/elements/1.1/"><rdf:Description xmp:CreatorTool="Midjourney v6"><dc:creator><rdf:Seq><rdf:li>A &amp; B</rdf:li></rdf:Seq></dc:creator><Iptc4xmpExt:DigitalSourceType rdf:resource="http://cv.iptc.org/newscodes/digitalsourcetype/trainedAlgorithmicMedia"/></rdf:Description></x:xmpmeta>'
CLAIM = b"jumbc2pa.assertions c2pa.actions.v2 c2pa.hash.data c2pa.actions.v2 claim_generator_info\x81\xa1\x64name\x6dAdobe_Firefly"
PARAMETERS = b"Steps: 20, Sampler: Euler a, Seed: 7"
PACKED = zlib.compress(PARAMETERS)


def raw(data: bytes) -> Column:
    return F.unhex(F.lit(data.hex()))


def big(value: Column | int, size: int) -> Column:
    """A whole number as `size` bytes, the largest first."""
    return F.unhex(F.lpad(F.hex((F.lit(value) if isinstance(value, int) else value).cast("long")), 2 * size, "0"))


def little(value: Column | int, size: int) -> Column:
    value = (F.lit(value) if isinstance(value, int) else value).cast("long")
    return F.concat(*[big(F.shiftright(value, 8 * k).bitwiseAND(255), 1) for k in range(size)])


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def when(mod: Column, n: int, text) -> Column:
    """text where the id is a multiple of n, else nothing of its kind."""
    value = raw(text) if isinstance(text, bytes) else F.lit(text) if isinstance(text, str) else text
    return F.when(F.pmod(mod, F.lit(n)) == 0, value).otherwise(raw(b"") if isinstance(text, bytes) else F.lit(""))


def prose(text: str = "text") -> Column:
    """A text without what markup could mistake."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), "<&", "()")


def guide(i: Column) -> Column:
    """Markdown with front matter, whose lines end in CRLF for every 13th, nested keys, comments, a script and meta tags by id."""
    front = F.concat(F.lit("---\ntitle: Doc "), i.cast("string"), F.lit("\n"), when(i, 2, "author:\n  name: someone\n  mail: x@example.org\n"), F.lit("meta:\n  date: 2026-01-01\n  layout: post\n"), when(i, 7, "prompt: |\n  a line\n"), F.lit("---\n"))
    body = F.concat(F.lit("# Head\n"), when(i, 3, "<!-- exported by a tool -->"), when(i, 6, "<!-- a plain remark -->"), when(i, 4, '<script id="s" type="application/ld+json">{"a": 1}</script>'), when(i, 5, "<meta content='G' name=generator>"), F.lit('<meta name="viewport" content="w">'), prose(), when(i, 9, "a​b"))
    return F.when(F.pmod(i, F.lit(13)) == 0, F.concat(F.replace(front, F.lit("\n"), F.lit("\r\n")), body)).otherwise(F.concat(front, body))


def svg(i: Column) -> Column:
    parts = [F.lit('<?xml version="1.0" encoding="UTF-8"?>\n'), when(i, 2, "<!-- Generator: X -->"), F.lit('<svg xmlns="http://www.w3.org/2000/svg"'), when(i, 3, ' xmlns:inkscape="http://i" inkscape:version="1 > 0"'), when(i, 5, ' onload="go()"'), F.lit(' width="10">'), when(i, 4, "<title>A<title>B</title></title>"), F.lit('<rect style="a > b" width="10" /><![CDATA[<title>]]>'), when(i, 7, '<image href="https://t.example/a.png" width="1"/>'), when(i, 6, "<metadata><rdf:RDF>x</rdf:RDF></metadata>"), when(i, 8, "<script>alert(1)</script>"), F.lit("<text>"), prose(), F.lit("</text></svg>")]
    return utf8(F.concat(*parts))


def tiff(i: Column) -> Column:
    """A little-endian block: make, orientation, and a position by id."""
    entry = lambda tag, kind, count, value: F.concat(little(tag, 2), little(kind, 2), little(count, 4), value)
    ratios = lambda *pairs: F.concat(*[little(x, 4) for pair in pairs for x in pair])
    make = F.concat(utf8(F.lpad(F.pmod(i, F.lit(1000)).cast("string"), 4, "0")), raw(b"cam\0"))
    letter = lambda n, yes, no: F.concat(utf8(F.when(F.pmod(i, F.lit(n)) == 0, yes).otherwise(no)), raw(b"\0\0\0"))
    main = F.concat(little(3, 2), entry(0x010F, 2, 8, little(50, 4)), entry(0x0112, 3, 1, little(F.pmod(i, F.lit(9)), 4)), entry(0x8825, 4, 1, little(58, 4)), little(0, 4))
    place = F.concat(little(4, 2), entry(1, 2, 2, letter(2, "S", "N")), entry(2, 5, 3, little(112, 4)), entry(3, 2, 2, letter(3, "W", "E")), entry(4, 5, 3, little(136, 4)), little(0, 4))
    return F.concat(raw(b"II*\0\x08\0\0\0"), main, make, place, ratios((F.pmod(i, F.lit(90)), 1), (60, 2), (0, 1)), ratios((F.pmod(i, F.lit(180)), 1), (15, 1), (0, 7)))


def chunk(kind: bytes, data: Column) -> Column:
    typed = F.concat(raw(kind), data)
    return F.concat(big(F.octet_length(data), 4), typed, big(F.crc32(typed), 4))


def png(i: Column) -> Column:
    """Title, packed parameters, XMP and time by id, and the text as image data."""
    nothing = raw(b"")
    some = lambda n, c: F.when(F.pmod(i, F.lit(n)) == 0, c).otherwise(nothing)
    return F.concat(
        raw(b"\x89PNG\r\n\x1a\n"), chunk(b"IHDR", F.concat(big(F.pmod(i, F.lit(100)) + 1, 4), big(7, 4), raw(b"\x08\x06\0\0\0"))), some(2, chunk(b"tEXt", F.concat(raw(b"Title\0"), utf8(F.coalesce("source", F.lit("")))))),
        some(3, chunk(b"zTXt", raw(b"parameters\0\0" + PACKED))), some(5, chunk(b"iTXt", raw(b"XML:com.adobe.xmp\0\0\0\0\0" + PACKET.encode()))), some(7, chunk(b"tIME", F.concat(big(2026, 2), raw(bytes([3, 4, 5, 6, 7]))))),
        some(11, chunk(b"eXIf", tiff(i))), some(4, chunk(b"prVt", raw(b"?"))), chunk(b"IDAT", utf8(F.coalesce("text", F.lit("")))), chunk(b"IEND", nothing),
    )


def jpeg(i: Column) -> Column:
    """EXIF, XMP in two parts, a comment and a claim by id, and the text as scan."""
    segment = lambda marker, data: F.concat(raw(bytes([0xFF, marker])), big(F.octet_length(data) + 2, 2), data)
    some = lambda n, c: F.when(F.pmod(i, F.lit(n)) == 0, c).otherwise(raw(b""))
    half = len(PACKET) // 2
    first, second = PACKET[:half].encode(), PACKET[half:].encode()
    more = lambda data, at: segment(0xE1, raw(b"http://ns.adobe.com/xmp/extension/\0" + b"0" * 32 + len(PACKET).to_bytes(4, "big") + at.to_bytes(4, "big") + data))
    xmp = F.concat(segment(0xE1, raw(b"http://ns.adobe.com/xap/1.0/\0")), more(second, half), more(first, 0))
    return F.concat(
        raw(b"\xff\xd8"), segment(0xE0, raw(b"JFIF\0" + bytes(9))), some(2, segment(0xE1, F.concat(raw(b"Exif\0\0"), tiff(i)))), some(3, xmp), some(4, segment(0xFE, utf8(F.lit("Made with Google AI ​")))), some(5, segment(0xEB, raw(b"JP" + bytes(8) + CLAIM))),
        segment(0xC0, F.concat(big(8, 1), big(F.pmod(i, F.lit(50)) + 1, 2), big(9, 2), raw(b"\x01"))), raw(b"\xff\xda\0\x02"), utf8(F.coalesce("text", F.lit(""))), raw(b"\xff\xd9"),
    )


def ruled_guide(i: Column) -> Column:
    """A guide in which each rule of lint_guides fires or not by id."""
    pick = lambda n, yes, no="": F.when(F.pmod(i, F.lit(n)) == 0, yes).otherwise(no)
    lines = [
        F.lit("---\ntitle: Doc\n"), pick(2, "description: " + "d" * 120 + "\n", "description: short\n"), pick(3, "summary: short\n", "summary: other\n"), pick(5, "", "publishDate: 2026-01-02\n"), F.lit("order: 3\n"),
        pick(7, "contentType: lab\n", pick(11, "contentType: essay\n")), pick(4, "metaTitle: " + "m" * 66 + "\n"), pick(6, "faq:\n  - q: one\n    a: yes\n"), pick(9, "note: a: b\n"), pick(10, "quote: 'it's'\n"), pick(8, "?? odd\n"), pick(12, "relatedTools: ['a, b', c]\n"),
        F.lit("---\n"), pick(2, "See [there](/x).\n", "See [/x](/x).\n"), pick(3, "This behavior is undetectable.\n", "No tool is undetectable.\n"), F.lit("At https://color.example/color and ![c](color.png).\n"),
    ]
    return F.when(F.pmod(i, F.lit(17)) == 0, F.lit("no fence\n")).otherwise(F.concat(*lines))


def revised(i: Column) -> Column:
    """A file of the text and 1 to 4 revisions, each with two objects, a section and a pointer; a loop for every 5th, a wrong pointer for every 7th."""
    line = lambda *parts: utf8(F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))
    place = lambda n: F.lpad(n.cast("string"), 10, "0")

    def revision(state, r):
        at, n = F.octet_length(state["b"]), r.cast("string")
        body = line("1 0 obj\n(r", n, ")\nendobj\n", (r + 1), " 0 obj\n(r", n, ")\nendobj\n")
        listed = line("xref\n0 2\n0000000000 65535 f \n", place(at), " 00000 n \n", (r + 1), " 1\n", place(at + 20), " 00000 n \n")
        back = F.when(r > 1, F.concat(F.lit(" /Prev "), state["x"].cast("string"))).when(F.pmod(i, F.lit(5)) == 0, F.concat(F.lit(" /Prev "), (at + 40).cast("string"))).when(F.pmod(i, F.lit(7)) == 0, F.lit(" /Prev 3")).otherwise("")
        end = line("trailer\n<< /Size 9 /Root 1 0 R", back, " >>\nstartxref\n", (at + 40), "\n%%EOF\n")
        return F.struct(F.concat(state["b"], body, listed, end).alias("b"), (at + 40).alias("x"))

    start = F.struct(line("%PDF-1.4\n", F.coalesce("text", F.lit("")), "\n").alias("b"), F.lit(0).alias("x"))
    return F.aggregate(F.sequence(F.lit(1), (F.pmod(i, F.lit(4)) + 1).cast("int")), start, revision)["b"]


def boxed(i: Column) -> Column:
    """The text, then a box of boxes: well formed, with a child too long, with too little left for a header, or with a child too short, by id."""
    box = lambda kind, data, size=None: (size or len(data) + 8).to_bytes(4, "big") + kind + data
    told = box(b"jumd", b"c2pa-box")
    whole = box(b"jumb", told + box(b"jumb", told) + box(b"cbor", b"data"))
    kinds = [whole, box(b"jumb", told + box(b"cbor", b"too-long", 99)), box(b"jumb", told + b"\0" * 6), box(b"jumb", told + box(b"json", b"too-shor", 5))]
    tail = F.lit(None).cast("binary")
    for m, data in enumerate(kinds):
        tail = F.when(F.pmod(i, F.lit(4)) == m, raw(data)).otherwise(tail)
    return F.concat(utf8(F.coalesce("text", F.lit(""))), tail, raw(b"after"))


def carrier(i: Column) -> Column:
    """An SVG with a title, a script, an editor's attribute and a JPEG by id."""
    image = F.concat(F.lit('<image href="data:image/jpeg;base64,'), F.base64(jpeg(i)), F.lit('"/>'))
    parts = [F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="10"'), when(i, 7, ' inkscape:version="1"'), F.lit(">"), when(i, 2, "<title>T <b>x</b></title>"), when(i, 3, image), when(i, 5, "<script>go()</script>"), F.lit("<text>"), prose(), F.lit("</text></svg>")]
    return utf8(F.concat(*parts))


def signed_guide(i: Column) -> Column:
    """Markdown that tells its author, time, tool and model, in front matter and in its body, by id."""
    front = F.concat(F.lit("---\ntitle: Doc\n"), when(i, 2, "author: A B\n"), when(i, 3, "date: 2026-01-02\n"), when(i, 5, "generator: ChatGPT 5\n"), when(i, 7, "prompt: p\nmodel: m\n"), F.lit("---\n"))
    body = [when(i, 11, "<!-- generated by a tool -->"), when(i, 13, '<meta name="generator" content="Midjourney">'), when(i, 17, '<script type="application/ld+json">{"by": "Firefly"}</script>'), prose(), when(i, 9, "a​b")]
    return F.concat(front, F.lit("# Head\n"), *body)


def webp(i: Column) -> Column:
    """An extended WebP with EXIF of the other byte order, and XMP by id; the text as image data."""
    odd = lambda data: F.when(F.octet_length(data) % 2 == 1, raw(b"\0")).otherwise(raw(b""))
    part = lambda kind, data: F.concat(raw(kind), little(F.octet_length(data), 4), data, odd(data))
    entry = lambda tag, kind, count, value: raw(tag.to_bytes(2, "big") + kind.to_bytes(2, "big") + count.to_bytes(4, "big") + value)
    big_endian = F.concat(raw(b"MM\0*\0\0\0\x08\0\x02"), entry(0x010F, 2, 4, b"cam\0"), entry(0x0112, 3, 1, b"\0\x06\0\0"), raw(b"\0\0\0\0"))
    some = lambda n, c: F.when(F.pmod(i, F.lit(n)) == 0, c).otherwise(raw(b""))
    body = F.concat(raw(b"WEBP"), part(b"VP8X", raw(bytes([0x0C, 0, 0, 0, 9, 0, 0, 6, 0, 0]))), part(b"VP8L", F.concat(raw(b"\x2f"), utf8(F.coalesce("text", F.lit(""))))), some(2, part(b"EXIF", big_endian)), some(3, part(b"XMP ", raw(PACKET.encode()))))
    return F.concat(raw(b"RIFF"), little(F.octet_length(body), 4), body)


def refused_svg(i: Column) -> Column:
    """SVG that is not read, in four ways."""
    body = utf8(F.concat(F.lit("<svg><text>"), prose(), F.lit("</text></svg>")))
    kind = F.pmod(F.floor(i / 7), F.lit(4))
    return F.when(kind == 0, F.concat(raw(b"\xff\xfe"), body)).when(kind == 1, F.concat(body, raw(b"<!-- \xff -->"))).when(kind == 2, F.concat(raw(b'<?xml version="1.0" encoding="koi8-r"?>'), body)).otherwise(utf8(F.concat(F.lit('<?xml version="1.0"?><sv'), prose())))


def typed_guide(i: Column) -> Column:
    """Front matter with a value of each type by id."""
    n = i.cast("string")
    pick = F.pmod(i, F.lit(3))
    return F.concat(F.lit("---\ntitle: 'Doc \""), n, F.lit("\"'\norder: 00"), n, F.lit("\nweight: "), n, F.lit(".50\ndraft: "), F.when(pick == 0, "true").when(pick == 1, "false").otherwise("~"), F.lit("\nsource: "), F.coalesce("source", F.lit("null")), F.lit("\n---\n"), prose())
