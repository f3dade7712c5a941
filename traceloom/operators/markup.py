"""Front matter of Markdown, and comments, JSON-LD, meta tags, handlers and remote references of HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hidden import clean_hidden
from ..functions.texts import trim_space
from ..plans.dims import REMOVED_ROLES, ROLES, role_of

#: Lines between fences at the very start: opening fence, block, closing fence.
BLOCK = r"(?dms)\A(-{3}[ \t]*\r?\n)(.+?)(^(?:-{3}|\.{3})[ \t]*(?:\r?\n|\z))"
#: What a key of front matter may be called.
KEY_NAME = r"\A[A-Za-z_][\w.\-]*\z"
# What comments say that tell how something was made.
COMMENT_GATE = r"generat|created\s+with|produced\s+by|exported|written\s+by|\bai\b|model|prompt"
COMMENT = r"(?s)<!--(.*?)-->"
#: A comment that speaks of these, up to its own end.
TOLD_COMMENT = rf"<!--(?:(?!-->).)*?(?:{COMMENT_GATE}).*?-->"
JSON_LD = r"""<script(?=[^>]*?\stype\s*=\s*["']?application/ld\+json)[^>]*>(.*?)</script\s*>"""
_NAMES = "|".join(key for keys in ROLES.values() for key in sorted(keys.split(), key=len, reverse=True))
#: A meta tag whose name has a role.
TOLD_META = rf"""<meta(?=[^>]*?\sname\s*=\s*["']?(?:{_NAMES})["'\s/>])[^>]*>"""


def front_matter(text: Column) -> Column:
    """The lines between the fences at the very start, or ''."""
    return F.regexp_extract(text, BLOCK, 2)


def unsafe(block: Column) -> Column:
    """YAML anchors, aliases or merge keys, by which one entry depends on another."""
    return block.rlike(r"(?<!\S)[&*][A-Za-z_]") | block.rlike(r"(?dm)^\s*<<\s*:")


def lines_of(block: Column) -> Column:
    """The lines with the ends that they have."""
    return F.regexp_extract_all(block, F.lit(r"[^\n]*\n|[^\n]+\z"), F.lit(0))


def key_of(line: Column) -> Column:
    """indent, name and value of a line that sets a key, parted at its first colon; null for any other line."""
    head = F.substring_index(line, ":", 1)
    name = F.regexp_replace(head, r"\A\s+|\s+\z", "")
    indent = F.length(head) - F.length(F.regexp_replace(head, r"\A\s+", ""))
    value = trim_space(F.substring(line, F.length(head) + 2, F.length(line)))
    return F.when(F.contains(line, F.lit(":")) & name.rlike(KEY_NAME), F.struct(indent.alias("indent"), name.alias("name"), value.alias("value")))


def entries(block: Column) -> Column:
    """An array of the block's keys: line, indent, name, path, value, last (the line before the next key as shallow).

    Two passes over the key lines, forwards for paths and backwards for extents. Each carries a stack
    of keys of rising indent, so the work grows with the keys and the depth of nesting.
    """
    found = F.transform(lines_of(block), lambda x, i: F.struct(i.alias("line"), key_of(x).alias("key")))
    set_ = F.filter(found, lambda k: k["key"].isNotNull())
    keys = F.transform(set_, lambda k: F.struct(k["line"].alias("line"), *[k["key"][c].alias(c) for c in ("indent", "name", "value")]))
    level, key = "array<struct<line:int,indent:int,name:string>>", "array<struct<line:int,indent:int,name:string,path:string,value:string,last:int>>"
    state = lambda stack, out: F.struct(stack.cast(level).alias("stack"), out.cast(key).alias("out"))
    own = lambda k: F.array(F.struct(k["line"].alias("line"), k["indent"].alias("indent"), k["name"].alias("name")))
    whole = lambda k, path, last: F.struct(*[k[x].alias(x) for x in ("line", "indent", "name")], path.alias("path"), k["value"].alias("value"), last.alias("last"))

    def down(s, k):
        stack = F.concat(F.filter(s["stack"], lambda x: x["indent"] < k["indent"]), own(k))
        path = F.array_join(F.transform(stack, lambda x: x["name"]), ".")
        return state(stack, F.concat(s["out"], F.array(whole(k, path, F.lit(None).cast("int")))))

    def up(s, k):
        after = F.filter(s["stack"], lambda x: x["indent"] <= k["indent"])  # the nearest is the last
        last = F.coalesce(F.get(after, F.size(after) - 1)["line"], F.size(lines_of(block))) - 1
        stack = F.concat(F.filter(after, lambda x: x["indent"] < k["indent"]), own(k))
        return state(stack, F.concat(F.array(whole(k, k["path"], last)), s["out"]))

    start = state(F.array(), F.array())
    with_path = F.aggregate(keys, start, down, lambda s: s["out"])
    return F.aggregate(F.reverse(with_path), start, up, lambda s: s["out"])


def front_matter_keys(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each key line: id, line, indent, key, path, value, role, last (the line before the next key as shallow), unsafe."""
    block = front_matter(F.col(text_col))
    rows = items.filter(F.col(text_col).rlike(BLOCK)).select(id_col, unsafe(block).alias("unsafe"), F.explode(entries(block)).alias("k"))
    key = F.lower("k.name")
    return rows.select(id_col, "k.line", "k.indent", key.alias("key"), "k.path", "k.value", role_of(key).alias("role"), "k.last", "unsafe")


def _without_entries(block: Column, gone: Column) -> Column:
    """The block's lines that no entry of `gone` covers."""
    covered = lambda i: F.exists(gone, lambda k: i.between(k["line"], k["last"]))
    return F.array_join(F.filter(lines_of(block), lambda x, i: ~covered(i)), "")


def _front_cleaned(text: Column, keys: Column) -> tuple[Column, Column]:
    """Front matter (fences and all) without the entries of removed roles, '' where no key is left; and the body."""
    block = front_matter(text)
    gone = F.filter(keys, lambda k: role_of(F.lower(k["name"])).isin(*REMOVED_ROLES))
    whole = F.concat(F.regexp_extract(text, BLOCK, 1), block, F.regexp_extract(text, BLOCK, 3))
    left = F.concat(F.regexp_extract(text, BLOCK, 1), _without_entries(block, gone), F.regexp_extract(text, BLOCK, 3))
    none_left = (F.size(keys) > 0) & (F.size(gone) == F.size(keys))
    front = F.when(~text.rlike(BLOCK), "").when(unsafe(block) | (F.size(gone) == 0), whole).when(none_left, "").otherwise(left)
    return front, F.when(text.rlike(BLOCK), F.substring(text, F.length(whole) + 1, F.length(text))).otherwise(text)


def clean_front_matter(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and cleaned: without the entries of removed roles; without fences where no key would be left.

    Unsafe blocks stay as they are. Lines within a removed entry go with it, whoever else claims them.
    Line ends and fences stay as they were.
    """
    rows = items.select(id_col, text_col, entries(front_matter(F.col(text_col))).alias("keys"))
    front, body = _front_cleaned(F.col(text_col), F.col("keys"))
    return rows.select(id_col, F.concat(front, body).alias("cleaned"))


def clean_markdown(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, cleaned, removed_keys (paths), comments, json_ld, meta_tags (how many of each go) and hidden (characters that go).

    Front matter as clean_front_matter; JSON-LD scripts and meta tags whose name has a role go wherever they stand,
    comments that tell how it was made go from the body, leftmost first; then hidden characters. A null text gives nulls.
    """
    rows = items.select(id_col, F.col(text_col).alias("_text"), entries(front_matter(F.col(text_col))).alias("keys"))
    front, body = _front_cleaned(F.col("_text"), F.col("keys"))
    gone = F.filter("keys", lambda k: role_of(F.lower(k["name"])).isin(*REMOVED_ROLES))
    safe = ~unsafe(front_matter(F.col("_text")))
    rows = rows.select(id_col, front.alias("front"), body.alias("body"), F.when(safe, F.transform(gone, lambda k: k["path"])).otherwise(F.array().cast("array<string>")).alias("removed_keys"))
    edits = rf"(?is){TOLD_COMMENT}|{JSON_LD}|{TOLD_META}"
    anywhere = rf"(?is){JSON_LD}|{TOLD_META}"
    deleted = F.concat(F.regexp_extract_all("front", F.lit(anywhere), F.lit(0)), F.regexp_extract_all("body", F.lit(edits), F.lit(0)))
    rows = rows.withColumns({"deleted": deleted, "stripped": F.concat(F.regexp_replace("front", anywhere, ""), F.regexp_replace("body", edits, ""))})
    of = lambda start: F.size(F.filter("deleted", lambda d: F.lower(d).startswith(start)))
    cleaned = clean_hidden(F.col("stripped"))
    kept_spaces = clean_hidden(F.col("stripped"), normalize_spaces=False)
    return rows.select(id_col, cleaned.alias("cleaned"), "removed_keys", of("<!--").alias("comments"), of("<script").alias("json_ld"), of("<meta").alias("meta_tags"), (F.length("stripped") - F.length(kept_spaces)).alias("hidden"))


def comments(html: Column, gated: bool = True) -> Column:
    """The comments' texts; gated: only those that speak of how something was made."""
    found = F.transform(F.regexp_extract_all(html, F.lit(COMMENT), F.lit(1)), trim_space)
    return F.filter(found, lambda c: c.rlike(f"(?i){COMMENT_GATE}")) if gated else found


def json_ld(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(f"(?is){JSON_LD}"), F.lit(1)), trim_space)


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag, in double, single or no quotes; '' where it has none."""
    pattern = rf"""(?i)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])


def meta_tags(html: Column) -> Column:
    """name, content and role of each meta tag whose name has a role."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0))
    name = lambda t: F.lower(attribute(t, "name"))
    each = F.transform(tags, lambda t: F.struct(name(t).alias("name"), attribute(t, "content").alias("content"), role_of(name(t)).alias("role")))
    return F.filter(each, lambda m: (m["name"] != "") & (m["role"] != "other"))


def event_handlers(html: Column) -> Column:
    return F.regexp_count(html, F.lit(r"""(?i)<[a-z][^>]*\son[a-z]+\s*="""))


def remote_references(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""(?i)\b(?:src|href)\s*=\s*["']((?:https?:)?//[^"']+)["']"""), F.lit(1))
