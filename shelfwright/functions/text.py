"""Column functions that clean, key and compare titles."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Genre spellings.
CANONICAL_GENRES = {
    "slice of life": "Slice of Life", "sci fi": "Sci-Fi", "sci-fi": "Sci-Fi", "martial arts": "Martial Arts", "school life": "School Life", "school": "School",
    "full color": "Full Color", "graphic novel": "Graphic Novel", "boys love": "Boys Love", "girls love": "Girls Love", "tragedy": "Tragedy", "historical": "Historical",
    "medical": "Medical", "murim": "Murim", "revenge": "Revenge", "isekai": "Isekai", "shoujo ai": "Shoujo Ai", "shounen ai": "Shounen Ai",
}
# Genres that mark a title as adult.
ADULT_GENRES = ("adult", "mature", "smut", "ecchi", "erotica", "hentai", "pornographic", "doujinshi", "yaoi", "yuri", "boys love", "girls love", "netorare", "sm bdsm")


# The labelled status; labels of a site's navigation, and how they begin.
STATUS = r"(?i)Status\s*[:\-]?\s*(Completed|Ongoing|Hiatus|Dropped|Cancelled)"
NAV_LABELS = (
    "HOME - Manhwa Manhua Top", "Manhwa Manhua Top", "New Release", "Popular Manga", "Latest Update", "Popular Genres", "Trending Manhwa", "Top Comics", "Top Manhua", "Top Manhwa", "My bookmarks",
    "Sign in", "Sign up", "Register", "Settings", "Read Manga", "New manga to read weekly", "ManhuaTop", "Spoiler",
)
NAV_PREFIX = "(?i)^(?:Latest|Popular|Top |New |Trending|All |Best |Manhua |Manhwa |Read )"
# Sources that carry adult titles; source codes and their names.
ADULT_SOURCES = "(?i)demonic|omega"
SOURCE_NAMES = {
    "Source A": "Asura Scans", "Source B": "Demonic Scans", "Source C": "Scythe Scans", "Source D": "Webtoons", "Source E": "Manganato", "Source F": "Atsu", "Source G": "Omega Scans",
    "Source H": "ManhuaTop", "ManhuaTop": "ManhuaTop",
}


def title_key(t: Column) -> Column:
    return F.regexp_replace(F.lower(t), "[^a-z0-9]", "")


def strip_markdown(t: Column) -> Column:
    """Images and links go with their text; white space collapses."""
    bare = F.regexp_replace(F.regexp_replace(t, r"!\[[^\]]*\]\([^)]*\)", ""), r"\[[^\]]*\]\([^)]*\)", "")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def canonical_genre(g: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in CANONICAL_GENRES.items() for x in pair])
    return F.coalesce(F.element_at(names, F.lower(F.trim(g))), g)


def split_genres(genres: Column) -> Column:
    """Joined genres part where a small letter meets a capital; spellings are canonical, firsts stay."""
    parts = F.flatten(F.transform(genres, lambda g: F.split(F.regexp_replace(g, "([a-z])([A-Z])", "$1\u0001$2"), "\u0001")))
    return F.array_distinct(F.filter(F.transform(parts, lambda g: canonical_genre(F.trim(g))), lambda g: g != ""))


def is_adult(genres: Column) -> Column:
    return F.coalesce(F.exists(genres, lambda g: F.lower(g).isin(*ADULT_GENRES)), F.lit(False))


def loose_genre(name: str) -> str:
    """Pattern of a genre's name in any case, its words joined by blanks, underscores or hyphens."""
    return "(?i)^" + r"[\s_-]+".join(re.escape(w) for w in name.split()) + "$"


def is_adult_loose(genres: Column, source: Column) -> Column:
    """Whether a genre is an adult one however its words are joined, or the source carries adult titles."""
    names = "|".join(loose_genre(g)[5:-1] for g in ADULT_GENRES)
    by_genre = F.coalesce(F.exists(genres, lambda g: g.rlike(f"(?i)^(?:{names})$")), F.lit(False))
    return by_genre | F.coalesce(source.rlike(ADULT_SOURCES), F.lit(False))


def parse_rating(text: Column) -> Column:
    """The first number, if it is at most 10; else N/A."""
    number = F.regexp_extract(text, r"(\d+\.?\d*)", 1)
    return F.when(number.try_cast("double") <= 10, number).otherwise("N/A")


def parse_grade(text: Column) -> Column:
    """The first run of digits and points, if the number that it begins with is at most 10; else N/A."""
    run = F.regexp_extract(text, r"([\d.]+)", 1)
    number = F.regexp_extract(run, r"^(\d+\.?\d*|\.\d+)", 1)
    return F.when(number.try_cast("double") <= 10, run).otherwise("N/A")


def detect_status(text: Column, rule: str = "first", known: Column | None = None) -> Column:
    """The status that a page's text tells of.

    rule "labelled": `Status: X` first, then the words; "first": completed, then hiatus; "last": hiatus over
    completed; "fallback": completed only where the known status is still Ongoing.
    """
    low = F.lower(text)
    plain = F.when(low.contains("completed"), "Completed").when(low.contains("hiatus"), "Hiatus").otherwise("Ongoing")
    if rule == "labelled":
        return F.coalesce(F.nullif(F.regexp_extract(text, STATUS, 1), F.lit("")), plain)
    if rule == "last":
        return F.when(low.contains("hiatus"), "Hiatus").otherwise(plain)
    if rule == "fallback":
        return F.when((known == "Ongoing") & low.contains("completed"), "Completed").otherwise(known)
    return plain


def source_name(code: Column) -> Column:
    """A source's name; codes that aren't known stay, and none is Unknown."""
    names = F.create_map(*[F.lit(x) for pair in SOURCE_NAMES.items() for x in pair])
    return F.coalesce(F.element_at(names, code), F.nullif(code, F.lit("")), F.lit("Unknown"))


def proxy_url(url: Column) -> Column:
    """Image addresses by way of the proxy: own and relative ones stay, what is too short goes."""
    code = F.url_encode(url)
    for put, sign in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        code = F.replace(code, F.lit(put), F.lit(sign))
    u = F.coalesce(url, F.lit(""))
    return F.when(F.length(u) < 5, "").when(u.startswith("/api/") | ~u.startswith("http"), u).otherwise(F.concat(F.lit("/api/img?url="), code))


def title_case(t: Column, marks: str = "[-_]+") -> Column:
    """Marks become blanks, words begin with capitals."""
    return F.concat_ws(" ", F.transform(F.filter(F.split(t, marks), lambda w: w != ""), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w)))))


def title_from_url(url: Column) -> Column:
    """The title in an address's slug between /en/x/ and /list; empty without one."""
    return title_case(F.regexp_extract(url, "/en/[^/]+/([^/]+)/list", 1), "-")


def is_nav_label(title: Column) -> Column:
    """Whether a link's text names a list or a place of the site."""
    return title.isin(*NAV_LABELS) | title.rlike(NAV_PREFIX)


def clean_text(t: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(t, "\u0000", ""), "<[^>]*>", "")
    # fixed values, in this order
    for code, sign in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&#x2F;", "/"), ("&nbsp;", " ")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return F.trim(out)


def clean_url(u: Column) -> Column:
    url = F.trim(u)
    low = F.lower(url)
    bad = low.startswith("javascript:") | (low.startswith("data:") & ~low.startswith("data:image/"))
    return F.when(bad, "").otherwise(F.regexp_replace(url, "[<>\"'`]", ""))


def romanize(t: Column) -> Column:
    out = F.lower(t)
    # fixed values, in this order
    rules = ((r"\s*\([^)]*\)\s*", " "), (r"\s*\[[^\]]*\]\s*", " "), ("ou", "o"), ("uu", "u"), ("ou", "o"), ("aa", "a"), ("ee", "e"), ("oo", "o"), (r"[:\-–—]\s+.*$", ""), (r"\s+for\s+the\s+", " "), (r"\s+to\s+", " "), (r"[^a-z0-9\s]", ""), (r"\s+", " "))
    for pattern, put in rules:
        out = F.regexp_replace(out, pattern, put)
    return F.trim(out)


def query_hash(q: Column) -> Column:
    return F.left(F.sha2(q, 256), F.lit(8))


def slugify(t: Column, mark: str = "-") -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(t), "[^a-z0-9]+", mark), f"^{mark}+|{mark}+$", "")


def plain_words(t: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+", " "))


def _query_words(query: str) -> tuple[str, list[str]]:
    import re

    q = " ".join(re.sub(r"[^a-z0-9\s]", " ", query.lower()).split())
    return q, [w for w in q.split(" ") if len(w) > 1]


def _hits(text: Column, words: list[str]) -> Column:
    return sum((F.when(text.contains(w), 1).otherwise(0) for w in words), F.lit(0))


def relevance_score(title: Column, description: Column, query: str) -> Column:
    q, words = _query_words(query)
    t, d = plain_words(title), plain_words(description)
    score = F.when(t == q, 1000).otherwise(0) + F.when(t.contains(q), 300).otherwise(0) + F.when(F.lit(q).contains(t) & (F.length(t) > 8), 120).otherwise(0)
    score = score + 25 * _hits(t, words) + 5 * _hits(d, words)
    if len(words) >= 4:
        share = _hits(t, words) / len(words)
        score = score + F.when(share >= 0.8, 120).when(share >= 0.6, 50).otherwise(0)
    return score


# What a relevant title does not hold.
DENIED = ("manga lists", "latest updates", "popular", "home", "search", "scythe scans", "demonic scans")


def is_relevant(title: Column, query: str, denied: tuple[str, ...] = DENIED) -> Column:
    q, words = _query_words(query)
    t = plain_words(title)
    need = -(-len(words) * 6 // 10) if len(words) >= 4 else max(1, -(-len(words) // 2))
    if len(words) == 1:
        w = words[0]
        by_words = (F.lit(len(w) >= 3)) & t.contains(w) & ~((F.lit(len(w)) < F.length(t) * 0.3) & (F.length(t) > 3 * len(w)))
    else:
        by_words = _hits(t, words) >= need
    bad = F.lit(False)
    for x in denied:
        bad = bad | t.contains(x)
    return ~bad & (t.contains(q) | by_words)


def _edits(x: Column, y: Column, share: float) -> Column:
    return F.levenshtein(x, y) <= F.greatest(F.lit(1), F.floor(F.greatest(F.length(x), F.length(y)) * share))


def _ratio(a: Column, b: Column) -> Column:
    return F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))


def fuzzy_key_match(a: Column, b: Column) -> Column:
    """Whether two title keys name the same work: equal, romanized alike, one in the other, or few edits."""
    return key_match(a, b, roman_key(a), roman_key(b))


def key_match(a: Column, b: Column, ra: Column, rb: Column) -> Column:
    """fuzzy_key_match on keys and their romanized forms."""
    la, lb = F.length(a), F.length(b)
    close = (F.abs(F.length(ra) - F.length(rb)) <= 3) & (F.length(ra) > 3) & _edits(ra, rb, 0.15)
    long = (la > 6) & (lb > 6)
    inside = a.startswith(b) | b.startswith(a) | ((a.contains(b) | b.contains(a)) & (_ratio(a, b) >= 0.7))
    near = (F.abs(la - lb) <= 3) & (la > 5) & _edits(a, b, 0.2)
    return (a == b) | (ra == rb) | close | (long & inside) | near


def roman_key(title: Column) -> Column:
    return F.regexp_replace(romanize(title), " ", "")


def title_words(title: Column) -> Column:
    """Words of over two characters, of letters and digits only; repeated ones stay."""
    return F.filter(F.split(F.regexp_replace(F.lower(title), r"[^a-z0-9\s]", " "), r"\s+"), lambda w: F.length(w) > 2)


def search_words(title: Column) -> Column:
    """Words of over two characters as they stand between blanks; repeated ones stay."""
    return F.filter(F.split(F.lower(title), r"\s+"), lambda w: F.length(w) > 2)


def search_key(title: Column) -> Column:
    """A title's key with long vowels cut short, as search results are compared."""
    return F.regexp_replace(F.replace(F.replace(F.lower(title), F.lit("ou"), F.lit("o")), F.lit("uu"), F.lit("u")), "[^a-z0-9]", "")


def _shared(wa: Column, wb: Column) -> Column:
    return F.size(F.filter(wa, lambda w: F.array_contains(wb, w)))


def fuzzy_title_match(a: Column, b: Column) -> Column:
    """Whether two titles name the same work: by their keys, or by seven in ten of the fewer words, two at least; a's repeated words count each."""
    return title_match(title_key(a), title_key(b), roman_key(a), roman_key(b), title_words(a), title_words(b))


def title_match(ka: Column, kb: Column, ra: Column, rb: Column, wa: Column, wb: Column) -> Column:
    """fuzzy_title_match on keys, romanized forms and words."""
    enough = (F.size(wa) >= 2) & (F.size(wb) >= 2)
    return key_match(ka, kb, ra, rb) | (enough & (_shared(wa, wb) >= 2) & (_shared(wa, wb) / F.least(F.size(wa), F.size(wb)) >= 0.7))


def fuzzy_search_match(a: Column, b: Column) -> Column:
    """Whether the search result a repeats b, which was found before."""
    return search_match(title_key(a), title_key(b), search_key(a), search_key(b), search_words(a), search_words(b))


def search_match(ka: Column, kb: Column, sa: Column, sb: Column, wa: Column, wb: Column) -> Column:
    """fuzzy_search_match on keys, search keys and words."""
    inside = (F.length(ka) > 5) & (F.length(kb) > 5) & (ka.contains(kb) | kb.contains(ka)) & (_ratio(ka, kb) >= 0.65)
    near = (F.abs(F.length(ka) - F.length(kb)) <= 3) & (F.length(ka) > 5) & _edits(ka, kb, 0.2)
    words = (F.size(wa) >= 2) & (F.size(wb) >= 2) & (_shared(wa, wb) / F.least(F.size(wa), F.size(wb)) >= 0.7)
    return (ka == kb) | (sa == sb) | inside | near | words
