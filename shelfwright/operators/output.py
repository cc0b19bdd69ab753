"""What the catalog shows: safe rows, shelves, facets and adult pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.pages import fix_title
from .catalog import check_page, ordered, rating_number, with_total
from .search import contains_any

#: Shown where a field is empty.
DEFAULTS = {"rating": "N/A", "status": "Unknown", "type": "Manhwa", "chapter_count": "0", "author": "Unknown", "artist": "Unknown", "url": ""}


def to_public(df: DataFrame) -> DataFrame:
    """Titles as they are shown: defaults for what is empty, clean texts, split genres, images by the proxy, sources by name."""
    kinds = dict(df.dtypes)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    put = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d)) for c, d in DEFAULTS.items() if c in kinds}
    put |= {"title": fix_title(text("title")), "source": T.source_name(text("source"))}
    if "description" in kinds:
        put["description"] = T.strip_markdown(text("description"))
    if "cover_url" in kinds:
        put["cover_url"] = T.proxy_url(text("cover_url"))
    if "genres" in kinds:
        put["genres"] = T.split_genres(F.coalesce("genres", F.array().cast("array<string>")))
    if "sources" in kinds:
        put["sources"] = F.transform(F.coalesce("sources", F.array().cast(kinds["sources"])), lambda s: F.struct(T.source_name(s["name"]).alias("name"), F.coalesce(s["url"], F.lit("")).alias("url")))
    if "chapters" in kinds:
        put["chapters"] = F.transform(F.coalesce("chapters", F.array().cast(kinds["chapters"])), lambda c: F.struct(c["title"].alias("title"), F.coalesce(c["url"], F.lit("")).alias("url"), F.coalesce(c["date"], F.lit("")).alias("date")))
    return df.withColumns(put)


def adult_page(df: DataFrame, *, genre: str = "All", query: str = "", page: int = 1, size: int = 40) -> DataFrame:
    """A page of the adult titles, the newest first, with total and has_more; of a genre however its words are joined, and with a query in one of its fields."""
    check_page(page, size, 1 << 30)
    rows = df.filter(T.is_adult_loose(F.col("genres"), F.col("source")))
    if genre and genre != "All":
        rows = rows.filter(F.exists("genres", lambda g: g.rlike(T.loose_genre(genre))))
    if query.strip():
        rows = contains_any(rows, query.strip()[:100], [c for c in ("title", "description", "genres", "author", "artist") if c in df.columns])
    shown = ordered(rows, "adult")
    return with_total((shown.offset((page - 1) * size) if page > 1 else shown).limit(size), rows, page, size)


def facets(df: DataFrame) -> DataFrame:
    """The genres of all titles, but for adult ones."""
    return df.select(F.explode("genres").alias("genre")).distinct().filter(~F.lower("genre").isin(*T.ADULT_GENRES))


def _newly_released(n: int) -> list[int]:
    """Fixed order of n places: each place from the last on changes with one that its own digits give."""
    places = list(range(n))
    for i in range(n - 1, 0, -1):
        h = 0
        for c in str(i):
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        j = abs(h - (1 << 32) if h >= 1 << 31 else h) % (i + 1)
        places[i], places[j] = places[j], places[i]
    return places


def shelves(df: DataFrame, genre: str, top: int = 30, size: int = 12) -> DataFrame:
    """id, shelf and place of the shelves of the top titles: trending, popular, genre, daily and newly released.

    With fewer titles than two shelves have room for, popular repeats the first ones; so does the genre's
    shelf with fewer than six titles. All windows see the top rows only.
    """
    best = ordered(df, "landing").limit(top)
    order = Window.orderBy(rating_number(F.col("rating")).desc(), F.desc("updated_at"), "title_key", "id")
    rows = best.select("id", F.row_number().over(order).alias("rank"), F.exists("genres", lambda g: F.lower(g) == genre.lower()).alias("fits"))
    every = Window.partitionBy()
    rows = rows.withColumns({"n": F.count("*").over(every), "n_fits": F.sum(F.col("fits").cast("int")).over(every), "nth_fit": F.sum(F.col("fits").cast("int")).over(Window.orderBy("rank"))})
    place = F.array(*[F.array(*map(F.lit, [_newly_released(n).index(i) + 1 for i in range(n)])) for n in range(1, top + 1)])  # by number of rows and rank
    new = F.get(F.get(place, F.col("n").cast("int") - 1), F.col("rank") - 1)
    first = F.when(F.col("rank") <= size, F.col("rank"))
    own_genre = F.when(F.col("n_fits") >= 6, F.when(F.col("fits"), F.col("nth_fit").cast("int"))).otherwise(first)
    popular = F.when(F.col("n") >= 2 * size, F.when(F.col("rank").between(size + 1, 2 * size), F.col("rank") - size)).otherwise(first)
    shelf = lambda name, at: F.struct(F.lit(name).alias("shelf"), at.alias("place"))
    held = F.array(shelf("trending", first), shelf("popular", popular), shelf("genre", own_genre), shelf("daily", first), shelf("newly released", F.when(new <= size, new)))
    return rows.select("id", F.explode(held).alias("x")).select("id", "x.shelf", "x.place").filter("place is not null")
