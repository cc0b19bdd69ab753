"""Page tables: links, meta data and last pages by expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pages import is_image_url, is_junk_url
from ..functions.text import clean_text, detect_status, is_nav_label, parse_rating

LINK = r'<a href="([^"?]*)[^"]*">([^<]*)</a>'


def extract_links(pages: DataFrame, least: int = 2) -> DataFrame:
    """The first link to each address of a page, with its text of `least` characters or more."""
    hrefs, names = (F.regexp_extract_all("html", F.lit(LINK), F.lit(k)) for k in (1, 2))
    links = pages.select("page_id", F.posexplode(F.arrays_zip(hrefs.alias("href"), names.alias("name"))).alias("pos", "x")).select("page_id", "pos", "x.href", F.trim("x.name").alias("name")).filter(F.length("name") >= least)
    return links.groupBy("page_id", "href").agg(F.min(F.struct("pos", "name")).alias("x")).select("page_id", "href", F.col("x.pos").alias("pos"), F.col("x.name").alias("name"))


def page_meta(pages: DataFrame) -> DataFrame:
    """Title (h1, then title) and the page number that the url asks for."""
    h1, title = F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    number = F.regexp_extract("url", r"[?&]page=(\d+)", 1).try_cast("int")
    return pages.select("page_id", F.coalesce(F.nullif(h1, F.lit("")), title).alias("title"), F.greatest(F.lit(1), F.coalesce(number, F.lit(1))).alias("page"))


IMAGE = r"(?i)<img\b[^>]*>"
#: Regions in which a reader's images stand, tried in this order.
REGIONS = (r'(?is)id="readerarea"(.*?)</div>', r'(?is)class="[^"]*reading-content[^"]*"(.*?)</div>', r'(?is)class="[^"]*chapter-content[^"]*"(.*?)</div>', r"(?is)<main\b(.*?)</main>", r"(?is)<article\b(.*?)</article>")


def extract_images(pages: DataFrame, regions: tuple[str, ...] = REGIONS, least: int = 3) -> DataFrame:
    """page_id and its image addresses, each once: region by region until there are `least`; with fewer, also the large ones of the whole page that aren't decoration."""
    attribute = lambda tag, name: F.nullif(F.regexp_extract(tag, rf'(?i)[\s"]{name}="([^"]*)"', 1), F.lit(""))
    address = lambda tag: F.coalesce(attribute(tag, "data-src"), attribute(tag, "data-lazy-src"), attribute(tag, "src"), F.lit(""))
    tags = lambda text: F.regexp_extract_all(text, F.lit(IMAGE), F.lit(0))
    found = F.array().cast("array<string>")
    for region in regions:
        inside = F.flatten(F.transform(F.regexp_extract_all("html", F.lit(region), F.lit(1)), tags))
        own = F.filter(F.transform(inside, address), is_image_url)
        found = F.when(F.size(found) >= least, found).otherwise(F.array_union(found, own))
    small = lambda tag, side: F.coalesce(F.regexp_extract(tag, rf'(?i)\s{side}="(\d{{1,9}})', 1).try_cast("int").between(1, 199), F.lit(False))
    large = F.filter(tags(F.col("html")), lambda t: ~small(t, "width") & ~small(t, "height"))
    rest = F.filter(F.transform(large, address), lambda u: is_image_url(u) & ~is_junk_url(u))
    held = pages.select("page_id", "html", found.alias("found"))
    return held.select("page_id", F.when(F.size("found") >= least, F.col("found")).otherwise(F.array_union("found", rest)).alias("images"))


ANCHOR = r"(?is)<a\b([^>]*)>(.*?)</a>"


def link_cards(pages: DataFrame, base: str, pattern: str = ".", least: int = 2, labels: bool = False) -> DataFrame:
    """page_id, url, pos and title of the links whose address matches the pattern, the first of each address.

    Addresses lose their query and become absolute; the title is the title attribute, else the image's alt,
    else the text without markup, in single blanks. With labels, navigation stays too.
    """
    attribute = lambda text, name: F.nullif(F.regexp_extract(text, rf"""(?i)(?:^|\s){name}\s*=\s*["']([^"']*)["']""", 1), F.lit(""))
    tags, inner = (F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(k)) for k in (1, 2))
    cards = pages.select("page_id", F.posexplode(F.arrays_zip(tags.alias("tag"), inner.alias("inner"))).alias("pos", "x")).select("page_id", "pos", "x.tag", "x.inner")
    href = F.regexp_replace(attribute(F.col("tag"), "href"), r"[?#].*$", "")
    text = F.coalesce(attribute(F.col("tag"), "title"), attribute(F.col("inner"), "alt"), F.regexp_replace("inner", "<[^>]*>", " "))
    cards = cards.select("page_id", "pos", F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(base), href)).alias("url"), href.alias("href"), F.trim(F.regexp_replace(text, r"\s+", " ")).alias("title"))
    kept = cards.filter(F.col("href").rlike(pattern) & (F.length("title") >= least))
    kept = kept if labels else kept.filter(~is_nav_label(F.col("title")))
    return kept.groupBy("page_id", "url").agg(F.min(F.struct("pos", "title")).alias("x")).select("page_id", "url", "x.pos", "x.title")


def page_details(pages: DataFrame, suffix: str = r"\s*[|–-]\s*[^|–-]*$", status_rule: str = "labelled") -> DataFrame:
    """page_id, title, description, rating, status and type from raw pages.

    Title: the meta title, else h1, else title without the site's name behind it. Description: the first
    paragraph of over 40 characters, else the meta one. The rating is the first number of a class "rating".
    """
    html = F.col("html")
    found = lambda pattern: F.nullif(F.trim(clean_text(F.regexp_extract(html, pattern, 1))), F.lit(""))
    meta = lambda name: found(rf"""(?is)<meta\s[^>]*(?:property|name)=["']{name}["'][^>]*content=["']([^"']*)["']""")
    paragraphs = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<p\b[^>]*>(.*?)(?=<p\b|</p>|</article>|</body>|\z)"), F.lit(1)), lambda p: F.trim(F.regexp_replace(clean_text(p), r"\s+", " ")))
    body = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1>", " "), "<[^>]*>", " ")
    kind = F.when(F.lower(body).contains("manhua"), "Manhua").when(F.lower(body).contains("manga series"), "Manga").otherwise("Manhwa")
    rating = F.regexp_extract(html, r"""(?is)class=["'][^"']*rating[^"']*["'][^>]*>([^<]*)<""", 1)
    title = F.coalesce(meta("og:title"), found(r"(?is)<h1\b[^>]*>(.*?)</h1>"), found(r"(?is)<title\b[^>]*>(.*?)</title>"))
    description = F.coalesce(F.get(F.filter(paragraphs, lambda p: F.length(p) > 40), 0), meta("og:description"), meta("description"), F.lit(""))
    return pages.select("page_id", F.trim(F.regexp_replace(title, suffix, "")).alias("title"), description.alias("description"), parse_rating(rating).alias("rating"), detect_status(body, status_rule).alias("status"), kind.alias("type"))
