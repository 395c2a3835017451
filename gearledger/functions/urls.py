"""URL expressions: host, canonical form, labels and trusted domains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gearledger.functions.text import squeeze

# Button captions removed from link labels, captions that say nothing.
CAPTIONS = "Learn more|Where to buy|Buy now|Compare|See more|See less|Explore"
EMPTY_LABELS = ("product", "products", "image", "all")


def https_only(url: Column) -> Column:
    return F.when(url.startswith("https://"), url)


def host(url: Column) -> Column:
    """Lower-case host without user or port; empty when there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def host_suffixes(url: Column) -> Column:
    """``a.b.c`` gives ``[a.b.c, b.c, c]``: the join keys of a sub-domain test."""
    labels = F.split(host(url), "\\.")
    size = F.size(labels)
    return F.transform(
        F.sequence(F.lit(1), size), lambda i: F.array_join(F.slice(labels, i, size - i + 1), ".")
    )


def in_domains(url: Column, domains: Column) -> Column:
    """True when the host equals or is below one of the domains."""
    return F.coalesce(F.arrays_overlap(host_suffixes(url), F.transform(domains, F.lower)), F.lit(False))


def fold_dots(url: Column) -> Column:
    """Absolute URL with the ``.`` and ``..`` segments of its path resolved; query and fragment stay."""
    origin = F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    rest = F.regexp_extract(url, "([?#].*)$", 1)
    parts = F.split(path(url), "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, part: (
        F.when(part == ".", acc)
        .when(part == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc))
        .otherwise(F.concat(acc, F.array(part)))
    ))
    folder = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    has_dots = path(url).rlike("(?:^|/)\\.\\.?(?:/|$)")
    return F.when(has_dots, F.concat(origin, F.array_join(folder, "/"), rest)).otherwise(url)


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of a link found on a page (absolute, scheme-relative, root-relative, relative)."""
    clean = F.trim(href)
    scheme = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    origin = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(path(base), "^(.*/)", 1)
    return (
        F.when(clean.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), clean)
        .when(clean.startswith("//"), F.concat(scheme, F.lit(":"), clean))
        .when(clean.startswith("/"), fold_dots(F.concat(origin, clean)))
        .when(clean.startswith("?") | clean.startswith("#"), F.concat(origin, path(base), clean))
        .otherwise(fold_dots(F.concat(origin, F.when(folder == "", F.lit("/")).otherwise(folder), clean)))
    )


def canonical(url: Column) -> Column:
    """Scheme, lower-case authority and path; only https links survive."""
    authority = F.lower(F.regexp_extract(url, "^(?i:https)://([^/?#]*)", 1))
    return F.when(F.lower(F.substring(url, 1, 8)) == "https://", F.concat(F.lit("https://"), authority, path(url)))


def link_label(text: Column, url: Column, segment: Column) -> Column:
    """Readable label of a link: its caption, or a path segment counted like a Python index."""
    caption = F.regexp_replace(squeeze(text), f"(?i)\\b(?:{CAPTIONS})\\b", " ")
    caption = F.btrim(squeeze(caption), F.lit(" -|·"))
    usable = (F.length(caption) >= 3) & ~F.lower(caption).isin(*EMPTY_LABELS)
    parts = F.filter(F.split(path(url), "/"), lambda p: p != "")
    size = F.size(parts)
    position = F.when(segment >= 0, segment + 1).otherwise(size + segment + 1)
    position = F.when((position >= 1) & (position <= size), position).otherwise(size)
    # "+" is a literal character in a path, only %XX sequences are decoded.
    decoded = F.try_url_decode(F.replace(F.get(parts, position.cast("int") - 1), F.lit("+"), F.lit("%2B")))
    slug = F.regexp_replace(decoded, "(?i)\\.(?:s?html?|php)$", "")
    words = F.trim(F.regexp_replace(slug, "[_-]", " "))
    return F.when(usable, caption).otherwise(F.coalesce(words, F.lit("")))
