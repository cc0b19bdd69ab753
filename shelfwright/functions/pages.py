"""Column functions on urls, descriptions and details of pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks an image's address, and what marks one as decoration.
IMAGE_MARKS = (".jpg", ".jpeg", ".png", ".webp", ".gif", ".avif", "/images/", "/uploads/", "/manga/", "/chapter/", "/comics/")
JUNK_MARKS = (
    "logo", "avatar", "icon", "banner", "ad-", "ads/", "ads.", "free_ad", "ad_", "favicon", "thumb", "emoji", "badge", "button", "spinner", "loading", "pixel", "tracking", "analytics",
    "1x1", "demon-title", "demon-logo", "noimg", "/img/logo", "cropped-", "site-logo", "header-", "footer-", "discord", "paypal", "patreon", "social",
)
# Hosts that no address may name.
PRIVATE_HOST = r"(?i)^localhost$|^127\.|^10\.|^172\.(1[6-9]|2\d|3[01])\.|^192\.168\.|^::1$|^0\.0\.0\.0$|^169\.254\.|^fc00:|^fe80:|\.internal$|\.local$"
# Phrases of a site's own notices.
NOTICE = "(?i)new feature|reading history|manganato automatically|read .{0,80} online for free"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)"


def _any_of(text: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | text.contains(m)
    return out


def is_image_url(url: Column) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    return low.startswith("http") & _any_of(low, IMAGE_MARKS)


def is_junk_url(url: Column) -> Column:
    return _any_of(F.lower(F.coalesce(url, F.lit(""))), JUNK_MARKS)


def host_of(url: Column) -> Column:
    """The host in small letters, without brackets; empty if there is none."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_extract(url, HOST, 1))), r"^\[|\]$", "")


def is_private_host(host: Column) -> Column:
    return host.rlike(PRIVATE_HOST)


def host_suffixes(host: Column) -> Column:
    """The host and what stands after each of its dots."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def fix_title(title: Column) -> Column:
    """A capital after a letter and an apostrophe becomes small; runs of blanks become one."""
    parts = F.split(title, "'", -1)
    small = F.transform(parts, lambda p, i: F.when((i > 0) & F.get(parts, i - 1).rlike("[a-zA-Z]$") & p.rlike("^[A-Z]"), F.concat(F.lower(F.left(p, F.lit(1))), F.substring(p, 2, 1 << 30))).otherwise(p))
    return F.regexp_replace(F.array_join(small, "'"), r"(?U)\s{2,}", " ")


def strip_label(text: Column) -> Column:
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.trim(F.regexp_replace(flat, r"(?i)^.{0,150}?\b(summary|overview|about|description|synopsis)\s*:\s*", ""))


def is_boilerplate(text: Column) -> Column:
    return F.coalesce((F.length(text) < 30) | text.rlike(NOTICE), F.lit(True))


def alt_titles(text: Column) -> Column:
    """Up to eight other titles after the word Alternative."""
    names = F.split(F.regexp_extract(text, r"(?i)Alternative\s*:?\s*([^\n<]+)", 1), "[;,]")
    return F.slice(F.filter(F.transform(names, lambda s: F.trim(s)), lambda s: F.length(s) > 1), 1, 8)


def strip_role(name: Column, role: str) -> Column:
    """A name without its role in brackets; Unknown where there is none yet."""
    return F.when(F.coalesce(name, F.lit("")).isin("", "Updating"), "Unknown").otherwise(F.trim(F.regexp_replace(name, rf"(?i)\s*\({role}\)", "")))


def is_end_page(html: Column) -> Column:
    low = F.lower(html)
    return low.contains("page not found") | low.contains("nothing found") | html.rlike("(?i)<h1[^>]*>.*404")


def max_page(html: Column) -> Column:
    """The greatest page number that a link of the page or its `Page X of Y` tells of; 1 at least."""
    most = lambda pattern: F.array_max(F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), lambda n: n.try_cast("int")))
    return F.greatest(F.lit(1), most(r"[?&]page=(\d+)"), most(r"(?i)/page/(\d+)"), F.regexp_extract(html, r"(?i)Page\s+\d+\s+of\s+(\d+)", 1).try_cast("int"))


# Fixed value: the host whose titles stand behind `series` in the path.
SERIES_HOST = "omegascans.org"


def source_slug(url: Column) -> Column:
    """The last part of the url's path, or at one host the part behind `series` if there is one; empty without it."""
    address = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)"
    parts = F.filter(F.split(F.regexp_extract(url, address, 2), "/"), lambda p: p != "")
    at = F.array_position(parts, "series")
    named = F.lower(F.regexp_extract(url, address, 1)).contains(SERIES_HOST) & (at > 0)
    return F.coalesce(F.when(named, F.get(parts, at.cast("int"))).otherwise(F.try_element_at(parts, F.lit(-1))), F.lit(""))


def client_ip(forwarded: Column, real: Column, real_first: bool = False) -> Column:
    """The address that a request comes from: the first forwarded one, then the real one, or the other way round; unknown without any."""
    first, own = F.nullif(F.trim(F.get(F.split(forwarded, ","), F.lit(0))), F.lit("")), F.nullif(F.trim(real), F.lit(""))
    return F.coalesce(*((own, first) if real_first else (first, own)), F.lit("unknown"))
