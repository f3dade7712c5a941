"""Repeated and null ids, empty and very long inputs: a row stays a row of its own."""

import pytest
from pyspark.sql import functions as F

from traceloom.operators import guides, markup
from traceloom.operators.cleaning import clean_files
from traceloom.operators.documents import markdown_signals, scan_files, svg_records
from traceloom.operators.svg import clean_svg, nesting, svg_facts, svg_rows
from traceloom.operators.verify import clean_and_verify, compare

SVG = "item_id long, content binary"


def test_svgs_of_one_id_stay_apart(spark):
    a, b = b"<svg><a/><!-- x --></svg>", b"<svg><b/><title>t</title></svg>"
    rows = spark.createDataFrame([(1, a), (1, b), (None, b), (2, None), (3, b""), (1, a)], SVG)
    got = sorted(((r.item_id, r.reason, r.cleaned) for r in clean_svg(rows).collect()), key=repr)
    assert got == sorted([(1, None, "<svg><a/></svg>")] * 2 + [(1, None, "<svg><b/></svg>"), (None, None, "<svg><b/></svg>"), (2, "no content", None), (3, "no svg element", None)], key=repr)
    assert clean_svg(rows.limit(0)).count() == 0
    files = clean_files(rows)
    assert files.count() == 6 and files.filter("item_id is null and cleaned is not null").count() == 1
    assert scan_files(rows).filter("signal_id = 'exif'").count() == 4 and scan_files(rows).filter("reason is not null").count() == 2


def test_elements_close_by_their_whole_names(spark):
    assert nesting(["+title", "+dc:title", "-dc:title", "", "-title", ""], 6)["inside"] == [True, True, True, True, True, False]
    assert nesting(["+title", "-dc:title", "", "-title", ""], 5)["inside"] == [True, True, True, True, False]
    assert nesting(["-title", "=title", "", "+title", ""], 5) == {"inside": [False, True, False, True, True], "regions": [{"element": "title", "start": 1, "stop": 2}, {"element": "title", "start": 3, "stop": 5}]}
    content = b"<svg><title>A<dc:title>B</dc:title>C</title><g/></svg>"
    assert clean_svg(spark.createDataFrame([(1, content)], SVG)).first().cleaned == "<svg><g/></svg>"


def test_a_very_long_svg(spark):
    content = b"<svg>" + b"<rect a='>' inkscape:x=\"1\"/>text" * 20_000 + b"<title>" + b"x" * 10**6 + b"</title></svg>"
    rows = spark.createDataFrame([(1, content)], SVG)
    assert svg_facts(svg_rows(rows, "item_id", "content")).first().editor == 20_000
    assert len(clean_svg(rows).first().cleaned) == 11 + 20_000 * len("<rect a='>'/>text")


def test_an_embedded_picture_that_is_none(spark):
    content = b'<svg><image href="data:image/png;base64,!!!"/><image href="data:image/png;base64,AAAA"/><image href="data:image/gif;base64,R0lGODlh"/></svg>'
    rows = spark.createDataFrame([(1, content)], SVG)
    assert clean_svg(rows).first().cleaned == content.decode()
    r = svg_records(rows).first()
    assert (r.embedded, r.exif, r.iptc, r.records) == (0, None, False, [])


def test_verified_texts_of_one_id(spark):
    rows = spark.createDataFrame([(1, "a​b"), (1, "plain"), (None, "a​b"), (2, None), (3, "")], "id long, text string")
    got = sorted(((r.item_id, r.outcome) for r in clean_and_verify(rows, "id", "text").filter("signal_id = 'hidden-unicode'").collect()), key=repr)
    assert got == sorted([(1, "removed"), (1, "absent"), (None, "removed"), (2, "absent"), (3, "absent")], key=repr)


def test_compared_facts_of_null_and_repeated_ids(spark):
    facts = "item_id long, signal_id string, status string"
    before = spark.createDataFrame([(1, "exif", "detected"), (None, "exif", "detected"), (2, "xmp", "detected")], facts)
    after = spark.createDataFrame([(1, "exif", "not_detected"), (1, "exif", "detected"), (None, "exif", "not_detected")], facts)
    assert {(r.item_id, r.outcome) for r in compare(before, after).collect()} == {(1, "remaining"), (None, "removed"), (2, "remaining")}
    assert compare(before, after).count() == 3


@pytest.mark.parametrize("n", [8_000, 1_000_000])
def test_long_items_of_an_inline_array(spark, n):
    text = f"---\ntitle: t\nrelatedTools: ['a', {'x' * n}, \"{'y' * n}\", '{'z' * n}']\n---\nbody"
    frame = spark.createDataFrame([(1, text)], "id long, md string")
    items = guides.inline_array(F.concat(F.lit("['a', "), F.repeat(F.lit("x"), n), F.lit(", \"b,c\", 'd''e', ]")))
    assert [len(x.value) for x in frame.select(items.alias("i")).first().i] == [1, n, 3, 3]
    assert guides.lint_guides(frame, "id", "md").filter("rule = 'nothing related'").count() == 0


def test_guides_of_one_id(spark):
    good, bad = "---\ntitle: A\nsummary: s\n---\n" + "word " * 30, "no fence"
    frame = spark.createDataFrame([(1, good), (1, bad), (None, bad), (2, None), (3, "")], "id long, md string")
    found = [(r.id, r.rule) for r in guides.in_line_order(guides.lint_guides(frame, "id", "md"), "id").collect()]
    assert sum(rule == "no front matter" for _, rule in found) == 4 and (None, "no front matter") in found and (1, "missing title") not in found
    assert guides.read_guides(frame, "id", "md", "x").select("id", "title").collect() == [(1, "A")]
    assert guides.lint_guides(frame.limit(0), "id", "md").count() == 0


def test_scripts_and_meta_tags_within_front_matter_go_too(spark):
    text = '---\ntitle: <meta name="generator" content="g">x\n---\n<!-- made by hand --><script type="application/ld+json">1</script>body'
    r = markup.clean_markdown(spark.createDataFrame([(1, text)], "id long, md string"), "id", "md").first()
    assert (r.cleaned, r.json_ld, r.meta_tags) == ("---\ntitle: x\n---\n<!-- made by hand -->body", 1, 1)


def test_markdown_signals_of_odd_texts(spark):
    frame = spark.createDataFrame([(1, ""), (1, "x"), (None, "---\nauthor: me\n---\n"), (2, None), (3, "---\nx: &a 1\n---\n")], "id long, text string")
    rows = markdown_signals(frame, "id").collect()
    assert len(rows) == 4 * 7 and [(r.item_id, r.value) for r in rows if r.status == "detected"] == [(None, "me")]
