"""Scalar text functions as Column builders.

Regular expressions spell out their character classes: the shorthand classes of the JVM cover ASCII only, while the
semantics here are those of Unicode text (no-break spaces are white space, accented letters are word characters).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .unicode import compose, needs_composition

# Separators of every kind plus the control characters that count as white space. Single characters and one category
# test are much faster in the JVM's matcher than a long list of ranges.
WS_CHARS = r"\t\n\x0B\f\r\x1C\x1D\x1E\x1F\x{0085}\p{Z}"
_WS_LITERAL = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS = f"[{WS_CHARS}]"
NOT_WS = f"[^{WS_CHARS}]"
WORD_CHARS = r"\p{L}\p{N}_"
WORD = f"[{WORD_CHARS}]"
# Unicode word boundary without the JVM's version-dependent \b.
EDGE = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"

# Quotes folded to ASCII and ligatures expanded.
QUOTES_FROM = "‘’“”"
QUOTES_TO = "''\"\""
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}

# HTML named character references that are decoded; `amp` has to come last.
ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "copy": "©", "reg": "®",
    "trade": "™", "middot": "·", "bull": "•", "hellip": "…", "mdash": "—", "ndash": "–",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»",
    "deg": "°", "euro": "€", "pound": "£", "agrave": "à", "acirc": "â", "ccedil": "ç",
    "egrave": "è", "eacute": "é", "ecirc": "ê", "icirc": "î", "ocirc": "ô", "ugrave": "ù",
    "ucirc": "û", "amp": "&",
}

_ENTITY_TABLE = "array({})".format(", ".join(
    "named_struct('ref', '&{};', 'char', '{}')".format(name, char.replace("'", "\\'"))
    for name, char in ENTITIES.items() if name != "amp"
))

# Windows-1252 characters and the C1 code points that carry the same bytes.
_CP1252 = bytes(b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
_CP1252_CHARS = _CP1252.decode("cp1252")
_C1_CHARS = _CP1252.decode("latin-1")


def let(value: Column, body) -> Column:
    """Bind `value` to a lambda variable so that `body` can use it many times and it is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"{WS}+", " ")


def strip(c: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.btrim(c, F.lit(_WS_LITERAL))


def unescape_entities(c: Column) -> Column:
    """Decode named (`&eacute;`) and numeric (`&#233;`, `&#xE9;`) character references."""

    def decoded(t: Column) -> Column:
        named = F.aggregate(F.expr(_ENTITY_TABLE), t, lambda acc, e: F.replace(acc, e["ref"], e["char"]))
        numeric = let(named, lambda n: F.when(n.contains("&#"), _decode_numeric(n)).otherwise(n))
        return F.replace(numeric, F.lit("&amp;"), F.lit("&"))

    return let(c, lambda t: F.when(t.contains("&"), decoded(t)).otherwise(t))


def _decode_numeric(c: Column) -> Column:
    def piece(p: Column, i: Column) -> Column:
        body = F.regexp_extract(p, r"^([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});", 1)
        code = F.when(
            body.rlike("^[xX]"), F.conv(F.substring(body, 2, 6), 16, 10)
        ).otherwise(body).cast("int")
        valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(32)), 8, "0")), "UTF-32")
        rest = F.substr(p, F.length(body) + 2)
        return (
            F.when(i == 0, p)
            .when((body != "") & valid, F.concat(char, rest))
            .otherwise(F.concat(F.lit("&#"), p))
        )

    return F.array_join(F.transform(F.split(c, "&#"), piece), "")


# A UTF-8 lead byte and a continuation byte, both shown as one-byte characters.
_MOJIBAKE = rf"[\x{{00C2}}-\x{{00F4}}][\x{{0080}}-\x{{00BF}}{_CP1252_CHARS}]"
# ASCII characters are settled by the first two tests.
_NEEDS_REPAIR = (
    rf"[&\r]|(?=[^\x{{0000}}-\x{{007F}}])(?:[{QUOTES_FROM}{''.join(LIGATURES)}\x{{0085}}\x{{2028}}\x{{2029}}]|{needs_composition()}|{_MOJIBAKE})"
)


def fix_encoding(c: Column | str) -> Column:
    """Repair common encoding damage: UTF-8 read as Latin-1/Windows-1252, character references, curly quotes,
    ligatures and line breaks, then canonical composition.

    One pattern decides whether a text needs any of it; give a plain column, since it is referred to more than once."""
    c = _col(c)

    def redecode(t: Column) -> Column:
        as_bytes = F.translate(t, _CP1252_CHARS, _C1_CHARS)
        # `encode` raises on characters outside its charset, so such texts must not reach it.
        safe = let(as_bytes, lambda b: F.when(b.rlike(r"[^\x{0000}-\x{00FF}]"), F.lit("")).otherwise(b))
        utf8 = F.try_validate_utf8(F.encode(safe, "ISO-8859-1").cast("string"))
        return F.when(t.rlike(_MOJIBAKE), F.coalesce(F.nullif(utf8, F.lit("")), t)).otherwise(t)

    def repair(t: Column) -> Column:
        out = let(redecode(t), lambda r: F.when(r.contains("<"), r).otherwise(unescape_entities(r)))
        out = F.translate(out, QUOTES_FROM, QUOTES_TO)
        for src, dst in LIGATURES.items():
            out = F.replace(out, F.lit(src), F.lit(dst))
        return compose(F.regexp_replace(out, r"\r\n?|[\x{0085}\x{2028}\x{2029}]", "\n"))

    return F.when(c.rlike(_NEEDS_REPAIR), repair(c)).otherwise(c)


def clean_text(c: Column | str, repair: bool = True) -> Column:
    """Tags to a space, then URLs and e-mail-like tokens out, white space collapsed, control characters out, trimmed.

    The token pattern is anchored at token starts and possessive, so that long runs without blanks stay linear."""
    out = text_or_empty(c)
    out = fix_encoding(out) if repair else out
    out = F.regexp_replace(out, "<[^>]++>", " ")
    out = F.regexp_replace(out, f"https?://{NOT_WS}+", "")
    out = F.regexp_replace(out, f"(?<!{NOT_WS}){NOT_WS}[^@{WS_CHARS}]*+@{NOT_WS}+", "")
    out = collapse_ws(out)
    out = F.regexp_replace(out, r"[\x{0000}-\x{0008}\x{000B}-\x{001F}]", "")
    return F.trim(out)


def normalize_text(c: Column | str) -> Column:
    """Curly quotes to ASCII, every white-space run to one space, trimmed."""
    out = F.translate(text_or_empty(c), "\u00a0" + QUOTES_FROM, " " + QUOTES_TO)
    return F.trim(collapse_ws(out))


def clean_page_text(c: Column | str) -> Column:
    """White space collapsed, then four character references replaced in this order, then trimmed."""
    out = collapse_ws(text_or_empty(c))
    for ref, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        out = F.replace(out, F.lit(ref), F.lit(char))
    return strip(out)


def content_hash(title: Column | str, abstract: Column | str) -> Column:
    return F.sha2(F.concat(text_or_empty(title), F.lit("|"), text_or_empty(abstract)), 256)


def truncate_marked(c: Column | str, limit: int) -> Column:
    """First `limit` characters plus `...` when the text is longer."""
    if limit < 1:
        raise ValueError("limit must be positive")
    c = text_or_empty(c)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def prefix(c: Column | str, limit: int) -> Column:
    return F.substring(text_or_empty(c), 1, limit)


def ascii_ratio(c: Column | str) -> Column:
    c = _col(c)
    return F.length(F.regexp_replace(c, r"[^\x{0000}-\x{007F}]", "")) / F.length(c)


def word_count(c: Column | str) -> Column:
    return F.regexp_count(_col(c), F.lit(f"{NOT_WS}+"))


def topic_slug(c: Column | str) -> Column:
    return F.lower(F.replace(_col(c), F.lit(" "), F.lit("_")))


def article_url(pmid: Column | str, base: str = "https://pubmed.ncbi.nlm.nih.gov/") -> Column:
    pmid = text_or_empty(pmid)
    return F.when(pmid != "", F.concat(F.lit(base), pmid, F.lit("/"))).otherwise(F.lit(""))


def json_object_slice(c: Column | str) -> Column:
    """Text from the first `{` to the last `}`; empty when there is none."""
    return F.regexp_extract(text_or_empty(c), r"(?s)(\{.*\})", 1)


def json_array_slice(c: Column | str) -> Column:
    return F.regexp_extract(text_or_empty(c), r"(?s)(\[.*\])", 1)


def compliance_metadata(url: Column | str, at: Column, robots_checked: bool = True, enabled: bool = True) -> Column:
    """Six-key map that records the terms under which a page was taken; empty when switched off."""
    if not enabled:
        return F.create_map().cast("map<string,string>")
    entries = {
        "consent_logged": F.lit("yes"),
        "fair_use_compliance": F.lit("research_purposes"),
        "tos_verified": F.lit("yes"),
        "robots_txt_checked": F.lit("yes" if robots_checked else "no"),
        "timestamp": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"),
        "source_url": _col(url),
    }
    return F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)])
