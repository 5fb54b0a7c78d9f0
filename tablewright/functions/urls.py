"""URL functions: parts, domains, brands, guards, and what a link points to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions.text import let

# fixed values: host aliases, assets, guide paths, parameters
BRANDS = (
    (r"^(?:bananarepublic\.com|bananarepublic\.gap\.com)$", "banana-republic"),
    (r"calvinklein\.(?:com|us)$", "calvinklein"),
    (r"(?:usa\.)?tommy\.com$|tommyhilfiger\.", "tommyhilfiger"),
    *((rf"{x}\.", x) for x in ("underarmour", "newbalance", "hugoboss", "ralphlauren", "thenorthface", "columbia", "lacoste")),
)
ASSET_HOST = r"(?:^|\.)(?:images?|media|static|assets)\."
ASSET_TARGET = r"scene7|/is/image|image/hugobosscsprod|mediadecathlon"
ASSET_FILE = r"\.(?:avif|bmp|gif|ico|jpe?g|png|svg|webp|mp4|mpeg|mov|webm|zip|rar|7z)$"
GUIDE_PATH = r"/size-(?:chart|guide)/mens?-tops/?$|/size-guide/apparel/?$|/browse/sizechart\.do$"
DIRECT = r"size-fit(?:/|$)|size-guide(?:/|$)|size-chart|sizechart|sizeguide|size_charts|pages/size-guides"
DIRECT_TOPS = r"mens?[-_/]?tops?|mens?_tops?_alpha|men[-_/]?shirts?[-_]?tops|shirts?_tops|tops[-_]?alpha"
PRIVATE = r"^(?:localhost|0\.0\.0\.0|::1|\[::1\])$|\.(?:localhost|internal|local)$|^127\.|^10\.|^192\.168\.|^169\.254\.|^172\.(?:1[6-9]|2[0-9]|3[01])\."

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, f"(?s){_PARTS}", n)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host(url: Column) -> Column:
    """Lower-case host without its port; empty where the url isn't absolute."""
    return F.regexp_replace(F.lower(_part(url, 2)), r":\d*$", "")


def path(url: Column) -> Column:
    """Path, / where an absolute url has none."""
    return F.when(host(url) == "", "").otherwise(F.when(_part(url, 3) == "", "/").otherwise(_part(url, 3)))


def query(url: Column) -> Column:
    return _part(url, 4)


def fragment(url: Column) -> Column:
    return _part(url, 5)


def origin(url: Column) -> Column:
    """scheme://host[:port] without a default port, null where the url isn't absolute."""
    bare = F.regexp_replace(F.lower(_part(url, 2)), r":(?:80|443)?$", "")
    return F.when(host(url) != "", F.concat(scheme(url), F.lit("://"), bare))


def registrable(name: Column) -> Column:
    """The last two labels of a host."""
    labels = F.filter(F.split(F.lower(name), r"\."), lambda x: x != "")
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")


def brand(url: Column) -> Column:
    """The brand that a url's host stands for: an alias, else its registrable domain."""

    def of(bare: Column) -> Column:
        alias = reduce(lambda c, r: c.when(bare.rlike(r[0]), F.lit(r[1])), BRANDS, F.when(F.lit(False), F.lit("")))
        return F.coalesce(alias, registrable(bare))

    return let(F.regexp_replace(host(url), r"^www\.", ""), of)


def same_brand(a: Column, b: Column) -> Column:
    return (host(a) != "") & (host(b) != "") & (brand(a) == brand(b))


def document(url: Column) -> Column:
    """A url without its fragment."""
    return F.regexp_replace(url, "(?s)#.*$", "")


def is_asset(url: Column) -> Column:
    """Whether a url points to an image, a film or an archive."""
    h, p = host(url), F.lower(path(url))
    return h.rlike(ASSET_HOST) | F.concat(h, p).rlike(ASSET_TARGET) | p.rlike(ASSET_FILE)


def is_guide_path(url: Column) -> Column:
    p = F.lower(path(url))
    listed = p.rlike(r"/customerservice/info\.do$") & F.lower(query(url)).rlike(r"(?:^|[?&])cs=size_charts(?:&|$)")
    return p.rlike(GUIDE_PATH) | listed


def is_direct_guide(url: Column) -> Column:
    return F.lower(url).rlike(DIRECT)


def is_concrete_direct_guide(url: Column, category: Column) -> Column:
    return is_direct_guide(url) & ((F.coalesce(category, F.lit("")) != "tshirts") | F.lower(url).rlike(DIRECT_TOPS))


def is_allowed(url: Column) -> Column:
    """Whether a url may be fetched: http or https, and no private host."""
    return scheme(url).isin("http", "https") & (host(url) != "") & ~host(url).rlike(PRIVATE)


def without_dots(url: Column) -> Column:
    """An absolute url, without query and fragment, whose path holds no dot segments.

    The path's segments are folded into a stack: a single dot adds nothing, a double one
    takes the last away, and none where the stack is empty; either at the end leaves an
    empty last segment. An escaped dot counts as one.
    """
    site = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)/", 1)
    segments = F.split(F.substr(url, F.length(site) + 2), "/")
    single, double = r"(?i)^(?:\.|%2e)$", r"(?i)^(?:\.|%2e){2}$"

    def step(stack: Column, segment: Column) -> Column:
        shorter = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
        return F.when(segment.rlike(single), stack).when(segment.rlike(double), shorter).otherwise(F.array_append(stack, segment))

    stack = F.aggregate(segments, F.array().cast("array<string>"), step)
    ends = F.element_at(segments, -1).rlike(r"(?i)^(?:\.|%2e){1,2}$")
    path = F.array_join(F.when(ends, F.array_append(stack, F.lit(""))).otherwise(stack), "/")
    return F.when((site != "") & url.rlike(r"(?i)/(?:\.|%2e){1,2}(?:/|$)"), F.concat(site, F.lit("/"), path)).otherwise(url)


def resolved(base: Column, href: Column) -> Column:
    """An href as an absolute url; null for none, a fragment alone or a script.

    Covers absolute, scheme-relative, host-relative, query and path-relative forms
    and removes dot segments, however many there are.
    """
    own = F.trim(href)
    site = F.concat(_part(base, 1), F.lit("://"), _part(base, 2))
    here = F.when(path(base) == "", "/").otherwise(path(base))
    folder = F.regexp_replace(here, "[^/]*$", "")
    joined = (
        F.when(own.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), own)
        .when(own.startswith("//"), F.concat(_part(base, 1), F.lit(":"), own))
        .when(own.startswith("/"), F.concat(site, own))
        .when(own.startswith("?"), F.concat(site, here, own))
        .otherwise(F.concat(site, folder, own))
    )

    def with_path(url: Column) -> Column:
        return F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+$"), F.concat(url, F.lit("/"))).otherwise(url)

    def of(joined: Column) -> Column:
        head, tail = F.regexp_extract(joined, r"^([^?#]*)", 1), F.regexp_extract(joined, r"^[^?#]*(.*)$", 1)
        return let(F.concat(let(head, without_dots), tail), with_path)

    def absolute(url: Column) -> Column:
        return F.when(host(url) != "", url)

    usable = (own != "") & ~own.startswith("#") & ~own.startswith("javascript:")
    return F.when(usable, let(let(joined, of), absolute))
