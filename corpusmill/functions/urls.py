"""URL parts and reference resolution (RFC 3986) as Column builders."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import let


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def authority(url: Column | str) -> Column:
    """`netloc` of the URL, with port and user info; empty when there is none. Unlike `parse_url` it accepts blanks."""
    return F.regexp_extract(_col(url), r"^(?:[^:/?#]+:)?//([^/?#]*)", 1)


def scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(url), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def path_and_query(url: Column | str) -> Column:
    """Path plus query, as used by crawl rules; `/` when the path is empty."""
    rest = F.regexp_extract(_col(url), r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^#]*)", 1)
    return F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))


def _squeeze_dots(segments: Column) -> Column:
    """Drop `.` segments and let `..` take the segment before it."""
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    last = F.element_at(segments, -1)
    return F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)


def _clean_path(path: Column, relative: Column) -> Column:
    return let(path, lambda p: _clean_bound_path(p, relative))


def _clean_bound_path(path: Column, relative: Column) -> Column:
    def rebuild(parts: Column) -> Column:
        n = F.size(parts)
        inner = F.when(
            relative, F.filter(parts, lambda s, i: (s != "") | (i == 0) | (i == n - 1))
        ).otherwise(parts)
        joined = F.array_join(_squeeze_dots(inner), "/")
        return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))

    needs_work = path.rlike(r"(^|/)\.{1,2}(/|$)") | (relative & path.contains("//"))
    return F.when(needs_work, let(F.split(path, "/"), rebuild)).otherwise(path)


def resolve(base: Column | str, ref: Column | str) -> Column:
    """Absolute form of `ref` as found on the page `base`."""
    base = _col(base)
    return let(_col(ref), lambda r: _resolve(base, r))


def _resolve(base: Column, ref: Column) -> Column:
    b_scheme = F.regexp_extract(base, r"^([^:/?#]+):", 1)
    b_auth = authority(base)
    b_path = F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    b_query = F.regexp_extract(base, r"^[^?#]*(\?[^#]+)", 1)
    site = F.concat(b_scheme, F.lit("://"), b_auth)
    r_path = F.regexp_extract(ref, r"^([^?#]*)", 1)
    r_tail = F.concat(
        F.regexp_extract(ref, r"^[^?#]*(\?[^#]+)", 1), F.regexp_extract(ref, r"^[^#]*(#.+)", 1)
    )
    folder = F.regexp_extract(b_path, r"^(.*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(ref == "", base)
        .when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(b_scheme, F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(site, _clean_path(r_path, F.lit(False)), r_tail))
        .when(ref.startswith("?"), F.concat(site, b_path, r_tail))
        .when(ref.startswith("#"), F.concat(site, b_path, b_query, r_tail))
        .otherwise(F.concat(site, _clean_path(F.concat(folder, r_path), F.lit(True)), r_tail))
    )
