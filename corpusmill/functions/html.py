"""Field extraction from raw HTML with built-in regular expressions and array functions.

The functions expect `html` after `strip_noise` (comments, scripts and styles removed). A `<p>` ends at its closing tag
or where the next paragraph or block element starts, which is how a browser closes it. Regions end where their element
does: the markup behind the opening tag is cut at every tag of that name, and a fold over the pieces counts the depth.

Limits on the number or length of extracted parts are parameters; None means everything.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import WS, clean_page_text, collapse_ws, let, strip, unescape_entities
from .urls import authority, resolve

MIN_PARAGRAPH = 50

# The inside of a tag: anything but `>`, or a quoted attribute value.
_IN_TAG = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_P_OPEN = rf"(?i)<p(?:\s{_IN_TAG})?>"
_P_END = (
    r"(?i)<(?:/p\s*>|/?(?:address|article|aside|blockquote|body|details|div|dl|fieldset|figcaption|figure|footer|form|"
    r"h[1-6]|header|hr|html|main|menu|nav|ol|pre|section|table|ul)\b)"
)
_ATTRIBUTE = r"""[^\s"'>/=]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
_MAIN_CLASS = "content|article|post|entry"


def strip_noise(html: Column) -> Column:
    return F.regexp_replace(
        F.coalesce(html, F.lit("")),
        r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>",
        "",
    )


def text_of(markup: Column) -> Column:
    """Text content: tags out, character references decoded."""
    return unescape_entities(F.regexp_replace(markup, rf"<[A-Za-z/!?]{_IN_TAG}>", ""))


def text_pieces(markup: Column, separator: str) -> Column:
    """Every text node stripped, empty ones dropped, joined by `separator`."""
    pieces = F.split(F.regexp_replace(markup, rf"<[A-Za-z/!?]{_IN_TAG}>", "\x00"), "\x00")
    return F.array_join(
        F.filter(F.transform(pieces, lambda p: strip(unescape_entities(p))), lambda p: p != ""), separator
    )


def _or_null(c: Column) -> Column:
    return let(c, lambda t: F.when(t != "", t))


def _element(html: Column, tag: str) -> Column:
    """Inner markup of the first such element, up to its closing tag or the end; NULL when absent."""
    whole = F.regexp_extract(html, rf"(?is)<{tag}(?=[\s>/]){_IN_TAG}>.*?(?:</{tag}\s*>|\z)", 0)
    edges = rf"(?i)\A<{tag}(?=[\s>/]){_IN_TAG}>|</{tag}\s*>\z"
    return let(whole, lambda e: F.when(e != "", F.regexp_replace(e, edges, "")))


def _has_value(attribute: str, values: str) -> str:
    """Lookahead: the tag carries `attribute` and its value contains one of the alternatives."""
    return (
        rf"""(?=[^>]*\s{attribute}\s*=\s*(?:"[^"]*(?:{values})|'[^']*(?:{values})|[^\s"'>]*(?:{values})))"""
    )


def _has_token(attribute: str, token: str) -> str:
    """Lookahead: one of the space-separated words of the attribute is exactly `token`."""
    return (
        rf"""(?=[^>]*\s{attribute}\s*=\s*(?:"(?:[^"]*\s)?{token}(?:\s[^"]*)?"|'(?:[^']*\s)?{token}(?:\s[^']*)?'"""
        rf"""|{token}(?=[\s>])))"""
    )


def _region(html: Column, tag: str, attributes: str = "") -> Column:
    """Inner markup of the first element that opens so, nested elements of its name included; NULL when absent. An element
    that is never closed runs to the end of the page."""
    opening = rf"<({tag})(?=[\s>/]){attributes}{_IN_TAG}>"
    rest = F.regexp_extract(html, rf"(?is){opening}.*", 0)

    def inner(r: Column) -> Column:
        name = F.lower(F.regexp_extract(r, r"^<([A-Za-z][A-Za-z0-9]*)", 1))
        pieces = F.split(F.regexp_replace(r, rf"(?is)\A{opening}", ""), F.concat(F.lit("(?i)(?=</?"), name, F.lit(r"[\s>/])")))

        def step(state: Column, piece: Column) -> Column:
            start = F.lower(F.substring(piece, 1, 30))
            change = (
                F.when(F.startswith(start, F.concat(F.lit("</"), name)), -1)
                .when(F.startswith(start, F.concat(F.lit("<"), name)), 1).otherwise(0)
            )
            depth = F.when(state["depth"] == 0, 0).otherwise(state["depth"] + change)
            return F.struct(depth.alias("depth"), (state["taken"] + F.when(depth > 0, 1).otherwise(0)).alias("taken"))

        def kept(parts: Column) -> Column:
            start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("taken"))
            # A split with look-ahead can open with a piece that is itself a tag, so the first piece is counted as any other.
            return F.array_join(F.slice(parts, F.lit(1), F.aggregate(parts, start, step)["taken"]), "")

        return F.when(r != "", let(pieces, kept))

    return let(rest, inner)


def tags(html: Column, name: str) -> Column:
    """Opening tags of this name, as written."""
    return F.regexp_extract_all(html, F.lit(rf"(?i)<{name}(?=[\s/>]){_IN_TAG}>"), F.lit(0))


def attribute(tag: Column, name: str) -> Column:
    """Decoded value of an attribute of one tag; the first wins; NULL when absent."""
    written = F.get(
        F.filter(
            F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(0)), lambda a: a.rlike(rf"(?i)^{name}\s*=")
        ),
        F.lit(0),
    )
    raw = F.regexp_replace(written, r"^[^=]*=\s*", "")
    return unescape_entities(F.regexp_replace(raw, r"""(?s)^"(.*)"\z|^'(.*)'\z""", "$1$2"))


def meta_entries(html: Column) -> Column:
    """Array of struct<name, property, content>, one per `<meta>`, in page order."""
    return F.transform(
        tags(html, "meta"),
        lambda t: F.struct(
            attribute(t, "name").alias("name"),
            attribute(t, "property").alias("property"),
            attribute(t, "content").alias("content"),
        ),
    )


def _first_meta(metas: Column, field: str, value: str) -> Column:
    return F.get(F.filter(metas, lambda m: m[field] == value), F.lit(0))


def paragraph_markup(region: Column) -> Column:
    """Markup inside every `<p>` of the region, in order."""

    def inside(parts: Column) -> Column:
        opened = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
        return F.transform(opened, lambda s: F.regexp_replace(s, rf"(?s){_P_END}.*", ""))

    return let(F.split(region, _P_OPEN), inside)


def paragraphs(region: Column) -> Column:
    return F.transform(paragraph_markup(region), text_of)


def title(html: Column, metas: Column) -> Column:
    """`<title>`, else the first `<h1>`, else og:title, else "No title"."""
    raw = F.coalesce(
        _or_null(unescape_entities(_element(html, "title"))),
        _or_null(text_of(_element(html, "h1"))),
        _or_null(_first_meta(metas, "property", "og:title")["content"]),
    )
    return let(raw, lambda t: F.when(t.isNull(), F.lit("No title")).otherwise(clean_page_text(t)))


def main_content(html: Column) -> Column:
    """Long paragraphs of the first region that has any; the whole page is the last resort."""

    def long_ones(region: Column) -> Column:
        found = F.filter(paragraphs(region), lambda p: F.length(strip(p)) > MIN_PARAGRAPH)
        return let(found, lambda ps: F.when(F.size(ps) > 0, ps))

    chosen = F.coalesce(
        long_ones(_region(html, "article")),
        long_ones(_region(html, "main")),
        long_ones(_region(html, "div", _has_value("class", _MAIN_CLASS))),
        long_ones(_region(html, "div", _has_value("id", _MAIN_CLASS))),
        long_ones(html),
        F.array().cast("array<string>"),
    )
    return clean_page_text(F.array_join(chosen, "\n\n"))


def up_to(text: Column, limit: int | None) -> Column:
    return text if limit is None else F.substring(text, 1, limit)


def abstract(html: Column, metas: Column, limit: int | None = None) -> Column:
    """Meta description (even when empty), else og:description, else a first paragraph of more than 100 characters, up to `limit`."""
    described = _first_meta(metas, "name", "description")
    og = _first_meta(metas, "property", "og:description")
    first = F.get(paragraphs(html), F.lit(0))
    return (
        F.when(described.isNotNull(), clean_page_text(described["content"]))
        .when(og.isNotNull(), clean_page_text(og["content"]))
        .otherwise(
            let(first, lambda p: F.when(F.length(p) > 100, clean_page_text(up_to(p, limit))).otherwise(F.lit("")))
        )
    )


def metadata(metas: Column) -> Column:
    """Map name-or-property -> content of the meta tags that have both; the last of equal names wins."""
    pairs = F.filter(
        F.transform(
            metas,
            lambda m: F.struct(
                F.coalesce(_or_null(m["name"]), _or_null(m["property"])).alias("key"), _or_null(m["content"]).alias("value")
            ),
        ),
        lambda e: e["key"].isNotNull() & e["value"].isNotNull(),
    )

    def last_wins(entries: Column) -> Column:
        keys = F.transform(entries, lambda e: e["key"])
        return F.map_from_entries(
            F.filter(
                entries,
                lambda e, i: ~F.array_contains(
                    F.slice(keys, i + 2, F.greatest(F.size(keys) - i - 1, F.lit(0))), e["key"]
                ),
            )
        )

    return let(pairs, last_wins)


def authors(html: Column, metas: Column) -> Column:
    """Meta author plus short texts of elements with an author-like class; distinct and sorted."""
    named = F.filter(F.array(_first_meta(metas, "name", "author")["content"]), lambda a: a.isNotNull())
    element = rf"(?is)<([a-z][a-z0-9]*)(?=\s){_has_value('class', 'author')}{_IN_TAG}>.*?(?:</\1\s*>|\z)"
    marked = F.filter(
        F.transform(F.regexp_extract_all(html, F.lit(element), F.lit(0)), lambda e: strip(text_of(e))),
        lambda t: (t != "") & (F.length(t) < 100),
    )
    found = F.when(html.rlike("(?i)author"), F.concat(named, marked)).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(found))


def date(html: Column, metas: Column) -> Column:
    moment = F.filter(
        F.transform(tags(html, "time"), lambda t: attribute(t, "datetime")), lambda d: d.isNotNull()
    )
    return F.coalesce(
        _or_null(_first_meta(metas, "property", "article:published_time")["content"]),
        _or_null(_first_meta(metas, "name", "publication_date")["content"]),
        _or_null(_first_meta(metas, "name", "date")["content"]),
        _or_null(F.get(moment, F.lit(0))),
        F.lit(""),
    )


def keywords(metas: Column) -> Column:
    found = _first_meta(metas, "name", "keywords")
    listed = F.transform(F.split(F.coalesce(found["content"], F.lit("")), ","), strip)
    return F.when(found.isNotNull(), listed).otherwise(F.array().cast("array<string>"))


def images(html: Column, base: Column, limit: int | None = None) -> Column:
    with_source = F.filter(tags(html, "img"), lambda t: F.coalesce(attribute(t, "src") != "", F.lit(False)))
    return F.transform(
        with_source if limit is None else F.slice(with_source, 1, limit),
        lambda t: F.struct(
            resolve(base, attribute(t, "src")).alias("url"),
            F.coalesce(attribute(t, "alt"), F.lit("")).alias("alt"),
            F.coalesce(attribute(t, "title"), F.lit("")).alias("title"),
        ),
    )


def links(html: Column, base: Column, limit: int | None = None) -> Column:
    """Links that stay on the authority of the page, in page order."""
    anchors = F.regexp_extract_all(html, F.lit(rf"(?is)<a(?=\s){_IN_TAG}>.*?(?=</?a[\s>]|\z)"), F.lit(0))
    resolved = F.filter(
        F.transform(
            anchors,
            lambda a: F.struct(
                resolve(base, attribute(F.regexp_extract(a, rf"(?is)^(<a\s{_IN_TAG}>)", 1), "href")).alias("url"),
                strip(text_of(a)).alias("text"),
            ),
        ),
        lambda link: F.coalesce(authority(link["url"]) == authority(base), F.lit(False)),
    )
    return resolved if limit is None else F.slice(resolved, 1, limit)


def generic_title(html: Column, limit: int | None = None) -> Column:
    """`<title>`, or the first `<h1>` of a page without one."""
    titled = unescape_entities(_element(html, "title"))
    return up_to(F.coalesce(titled, text_pieces(_element(html, "h1"), ""), F.lit("")), limit)


def generic_content(html: Column, limit: int | None = None) -> Column:
    """Whole text of the first main region after navigation, header and footer are removed, else of all paragraphs."""
    region = F.coalesce(
        _region(html, "article"),
        _region(html, "main"),
        _region(html, "[a-z][a-z0-9]*", _has_token("class", "content")),
        _region(html, "[a-z][a-z0-9]*", _has_token("id", "content")),
        _region(html, "[a-z][a-z0-9]*", _has_token("class", "article-body")),
    )
    from_paragraphs = F.array_join(F.transform(paragraph_markup(html), lambda p: text_pieces(p, "")), " ")
    whole = _or_null(text_pieces(region, " "))
    return up_to(F.coalesce(whole, from_paragraphs), limit)


def strip_chrome(html: Column) -> Column:
    """Navigation, header and footer elements removed."""
    out = html
    for tag in ("nav", "footer", "header"):
        out = F.regexp_replace(out, rf"(?is)<{tag}(?=[\s>]){_IN_TAG}>.*?</{tag}\s*>", "")
    return out
