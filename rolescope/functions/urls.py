"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rolescope import fixed_values as V
from rolescope.functions import text as t

ANCHOR = r"""(?is)<a\b[^>]*?\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""


def url_host(url: t.Expr) -> Column:
    """Network location as written (port and case kept), "" when there is none."""
    return F.regexp_extract(t.as_col(url), r"\A(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def drop_fragment(url: t.Expr) -> Column:
    return F.split_part(t.as_col(url), F.lit("#"), F.lit(1))


def _without_dots(path: Column) -> Column:
    """Resolve . and .. segments of an absolute path."""
    parts = F.slice(F.split(path, "/", -1), 2, F.greatest(F.size(F.split(path, "/", -1)) - 1, F.lit(0)))

    def step(kept: Column, part: Column) -> Column:
        parent = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(part == "..", parent).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))

    kept = F.aggregate(parts, F.slice(parts, 1, 0), step)
    tail = F.when(path.rlike(r"/\.\.?\z"), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(F.size(kept) > 0, tail).otherwise(""))


def join_url(base: t.Expr, href: t.Expr) -> Column:
    """Resolve a link against its page; the usual web schemes only."""
    b, h = t.as_col(base), t.strip(t.text_or_empty(href))
    scheme = F.regexp_extract(b, r"\A([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    root = F.regexp_extract(b, r"\A([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    path = F.regexp_extract(b, r"\A[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_extract(path, r"\A(.*/)", 1)
    to_path = F.regexp_extract(h, r"\A([^?#]*)", 1)
    to_tail = F.regexp_extract(h, r"\A[^?#]*(.*)", 1)
    absolute = F.when(h.startswith("/"), to_path).otherwise(
        F.concat(F.when(folder == "", "/").otherwise(folder), to_path))
    query = F.regexp_extract(b, r"\A[^?#]*(\?[^#]*)", 1)
    return (
        F.when(h == "", b)
        .when(h.rlike(r"\A[A-Za-z][A-Za-z0-9+.\-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
        .when(h.startswith("?"), F.concat(root, path, h))
        .when(h.startswith("#"), F.concat(root, path, query, h))
        .otherwise(F.concat(root, _without_dots(absolute), to_tail))
    )


def anchor_hrefs(html: t.Expr) -> Column:
    """href values of all anchors, in page order; comments are skipped."""
    body = F.regexp_replace(t.text_or_empty(html), r"(?s)<!--.*?-->", "")
    raw = F.zip_with(
        F.zip_with(
            F.regexp_extract_all(body, F.lit(ANCHOR), F.lit(1)),
            F.regexp_extract_all(body, F.lit(ANCHOR), F.lit(2)), lambda a, b: F.concat(a, b)),
        F.regexp_extract_all(body, F.lit(ANCHOR), F.lit(3)), lambda a, b: F.concat(a, b))
    return F.transform(raw, lambda h: F.replace(h, F.lit("&amp;"), F.lit("&")))


def page_links(url: t.Expr, html: t.Expr) -> Column:
    """Links of a page to its own host, resolved, without fragments."""
    u = t.as_col(url)
    resolved = F.transform(anchor_hrefs(html), lambda h: join_url(u, h))
    return F.transform(F.filter(resolved, lambda x: url_host(x) == url_host(u)), drop_fragment)


def is_candidate_url(url: t.Expr, include: list[str] | Column = (), exclude: list[str] | Column = (),
                     hints: list[str] = V.URL_JOB_HINTS) -> Column:
    """No exclude pattern; some include pattern where any is given, else a job word."""
    low = F.lower(t.as_col(url))

    def any_of(patterns: list[str] | Column) -> Column:
        if isinstance(patterns, Column):
            return F.exists(patterns, lambda p: F.contains(low, F.lower(p)))
        return t.contains_any(low, [p.lower() for p in patterns])

    hinted = t.contains_any(low, hints)
    if isinstance(include, Column):
        wanted = F.when(F.size(include) > 0, any_of(include)).otherwise(hinted)
    else:
        wanted = any_of(include) if include else hinted
    return ~any_of(exclude) & wanted


def in_scope(url: t.Expr, host: Column, exclude: list[str] | Column = ()) -> Column:
    low = F.lower(t.as_col(url))
    if isinstance(exclude, Column):
        banned = F.exists(exclude, lambda p: F.contains(low, F.lower(p)))
    else:
        banned = t.contains_any(low, [p.lower() for p in exclude])
    return (url_host(url) == host) & ~banned
