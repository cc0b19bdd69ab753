"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Base spans are four patterns with checks. A protected entity is a base span's value: an address, a number. A
word stands near an entity where it lies within `window` code points of it. Over the whole corpus, a term's
pointwise mutual information with an entity is what the term tells of the entity's own information; the rest
is what stays unknown of the entity to whom the term is known. It is taken at the lower confidence bound
(Wilson's) of the share of the term's occurrences that stand near the entity, where copies of a context count
once, so that few occurrences tell less, and alike at every table size: a term seen once, near an entity,
leaves 1.9 bits, one seen ten times near the same entity only 0.3.

Terms that leave at most `bits` and at most half of an entity become spans of kind "term" wherever they stand in the documents
that hold the entity. Sanitising generalises base spans to their kind and such terms to [TERM], and removes
terms that leave at most `removal_bits`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

KINDS = ("email", "ip", "card", "phone")

#: The base patterns in possessive form, so that they match in linear time. \\G and the look-behind start a
#: match where the plain pattern would: at the start of a run or right after a match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
WORD = r"\p{L}+"
SPANS = "array<struct<start:int,kind:int,end:int,entity:bigint>>"
TERMS = "array<struct<start:int,kind:int,end:int,left:double>>"
#: Matches that are placed in one go: what comes behind is shifted by what lies before.
RUN = 256
#: Code points of the blocks that a text is cut into for rebuilding.
BLOCK = 1024


def _let(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.transform(F.array(value), use)[0]


def _places(text: Column, pattern: str, keep=None) -> Column:
    """Start, end and string of the pattern's matches: what stands between them is what split gives. Takes time in proportion to the text."""
    between = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.filter(F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), between, lambda m, g: F.struct(m.alias("m"), g.alias("gap"))), lambda x: x["m"].isNotNull())
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,m:string>>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["gap"]
        b = a + F.length(x["m"])
        return F.struct(b.alias("at"), F.concat(acc["found"], F.array(F.struct(a.alias("start"), b.alias("end"), x["m"].alias("m")))).alias("found"))

    def shifted(run: Column, by: Column) -> Column:
        return F.transform(run["found"], lambda x: F.struct((x["start"] + by).alias("start"), (x["end"] + by).alias("end"), x["m"].alias("m")))

    def placed(p: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(p) - 1, F.lit(0)) / RUN).cast("int")), lambda k: F.aggregate(F.slice(p, k * RUN + 1, RUN), begin, step))
        return _let(runs, lambda r: F.flatten(F.zip_with(r, _before(F.transform(r, lambda x: x["at"])), shifted)))

    found = _let(pairs, placed)
    return F.filter(found, lambda x: keep(x["m"])) if keep else found


def _before(lengths: Column) -> Column:
    """For each of a few lengths the sum of those before it."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(lengths, begin, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    digits = F.filter(F.split(F.reverse(_digits(m)), ""), lambda c: c != "")
    doubled = F.transform(digits, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


CHECKS = {
    "email": lambda m: F.lit(True),
    # parts of more than three digits pass with leading zeros only
    "ip": lambda m: F.forall(F.split(m, r"\."), lambda x: x.rlike("^0*[0-9]{1,3}$") & (F.right(x, F.lit(3)).cast("int") <= 255)),
    "card": lambda m: F.length(_digits(m)).between(12, 19) & _luhn(m),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}


def _as_kind(k: int):
    same = F.lower if KINDS[k] == "email" else _digits if KINDS[k] in ("card", "phone") else lambda m: m
    return lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"), F.xxhash64(F.lit(k), same(x["m"])).alias("entity"))


def _is_kind(k: int):
    return lambda s: s["kind"] == k


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start and kind."""
    none = F.array().cast(SPANS)
    parts = []
    for k, kind in enumerate(KINDS):
        spans = F.transform(_places(text, PATTERNS[kind], CHECKS[kind]), _as_kind(k))
        needs = text.contains(NEEDS[kind]) if kind in NEEDS else text.rlike("[0-9]")
        parts.append(F.when(needs, spans).otherwise(none))
    return F.array_sort(F.concat(*parts))


def _words(text: Column) -> Column:
    """Words of a text outside its addresses (no other base span has letters): start, end and the lower-cased word."""
    pattern = F.lit(PATTERNS["email"])
    blanked = F.array_join(F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda gap, m: F.concat(gap, F.repeat(F.lit(" "), F.coalesce(F.length(m), F.lit(0))))), "")
    return F.transform(_places(F.when(text.contains("@"), blanked).otherwise(text), WORD), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lower(x["m"]).alias("term")))


def _row_id(doc_id: Column, text: Column) -> Column:
    """Equal for rows of equal id and text only."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), F.xxhash64(text))


def _near(spans: DataFrame, words: DataFrame, window: int) -> DataFrame:
    """entity, term and context for each word within the window of a span; met by stretches of window code points, in which few spans and words have room."""
    stretch = lambda c: F.floor(c / window)
    around = spans.withColumn("stretch", F.explode(F.sequence(stretch(F.col("start") - window), stretch(F.col("end") + window)))).withColumnsRenamed({"start": "a", "end": "b"})
    met = words.withColumn("stretch", stretch(F.col("start"))).join(around, ["rid", "stretch"]).filter((F.col("start") >= F.col("a") - window) & (F.col("end") <= F.col("b") + window))
    seen = met.groupBy("rid", "a", "kind", "entity").agg(F.array_sort(F.collect_list(F.struct((F.col("start") - F.col("a")).alias("at"), "term"))).alias("seen"))
    return seen.select("entity", F.xxhash64("seen").alias("context"), F.explode("seen.term").alias("term"))


def disclosures(near: DataFrame, counts: DataFrame, z: float) -> DataFrame:
    """entity, term, own and left: bits of information of the entity, and those that the term leaves of them.

    counts(term, n) has the terms of near and, as a null term, all other words.
    """
    pairs = materialize(near.groupBy("entity", "term", "context").agg(F.count("*").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("together"), F.count("*").alias("contexts")), "pairs")
    own = pairs.groupBy("entity").agg(F.sum("together").alias("of_entity"))
    joined = pairs.join(own, "entity").join(counts, "term").join(F.broadcast(counts.agg(F.sum("n").alias("total"))))
    share = F.least(F.col("together") / F.col("n"), F.lit(1.0))
    size = F.col("contexts") / share  # occurrences, with copies of a context counted once
    least = (share + z * z / (2 * size) - z * F.sqrt(share * (1 - share) / size + z * z / (4 * size * size))) / (1 + z * z / size)
    own_bits = F.log2(F.greatest(F.col("total") / F.col("of_entity"), F.lit(1.0)))
    mutual = F.log2(least) + own_bits
    return joined.select("entity", "term", own_bits.alias("own"), (own_bits - mutual).alias("left"))


def find_spans(docs: DataFrame, *, window: int = 64, bits: float = 2.0, z: float = 1.645) -> DataFrame:
    """doc_id, rid, base, terms for each row of docs(doc_id, text): arrays of (start, kind, end, ...), of terms null where there are none.

    A null text counts as empty and has no spans; repeated rows get the same spans each; a null doc_id
    stays null; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = rows.select("doc_id", _row_id(F.col("doc_id"), F.col("text")).alias("rid"), "text", base_spans(F.col("text")).alias("base"))
    found = materialize(found.select("doc_id", "rid", "base", F.when(F.size("base") > 0, _words(F.col("text"))).alias("words")), "pii")
    held = found.filter(F.size("base") > 0).dropDuplicates(["rid"])
    spans = held.select("rid", F.explode("base").alias("x")).select("rid", "x.*")
    words = held.select("rid", F.explode("words").alias("x")).select("rid", "x.*")
    near = materialize(_near(spans, words, window), "near")
    counts = rows.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    known = near.select("term").distinct().withColumn("near", F.lit(True))
    counts = materialize(counts.join(known, "term", "left").groupBy(F.when(F.col("near"), F.col("term")).alias("term")).agg(F.sum("n").alias("n")), "counts")
    telling = disclosures(near, counts, z).filter((F.col("left") <= bits) & (2 * F.col("left") <= F.col("own")))
    of_row = spans.select("rid", "entity").distinct().join(telling, "entity").groupBy("rid", "term").agg(F.min("left").alias("left"))
    marked = words.join(of_row, ["rid", "term"]).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("kind"), "end", "left"))).alias("terms"))
    return found.drop("words").join(marked, "rid", "left").select("doc_id", "rid", "base", F.col("terms").cast(TERMS).alias("terms"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def pii_report(docs: DataFrame, **settings) -> DataFrame:
    """Counts, the digest of the base spans and all spans for each row of docs; see find_spans."""
    found = find_spans(docs, **settings)
    plain = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    every = F.concat(plain("base"), plain(F.coalesce("terms", F.array().cast(TERMS))))
    counts = [F.size(F.filter("base", _is_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(every)).alias("spans"))


def blocks_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _piece(blocks: Column, a: Column, b: Column) -> Column:
    """Code points a to b of a text in blocks."""
    i, j = F.floor(a / BLOCK).cast("int"), F.floor(b / BLOCK).cast("int")
    block = lambda k: F.coalesce(F.get(blocks, k), F.lit(""))
    across = F.concat(F.substring(block(i), a % BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(block(j), F.lit(1), b % BLOCK))
    return F.when(i == j, F.substring(block(i), a % BLOCK + 1, b - a)).otherwise(across)


def sanitize(docs: DataFrame, *, removal_bits: float = 0.75, **settings) -> DataFrame:
    """docs with each row's spans generalised or removed in its text; rows without spans and all other columns stay.

    Of spans that overlap the first is replaced, and what the others have behind it is cut. Nulls, repeated
    rows and empty tables: see find_spans.
    """
    found = find_spans(docs, **settings).filter(F.size("base") > 0).dropDuplicates(["rid"])
    label = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, "term")])
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.get(label, s["kind"]).alias("put")))
    terms = F.transform(F.coalesce("terms", F.array().cast(TERMS)), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.when(s["left"] > removal_bits, F.get(label, s["kind"])).otherwise("").alias("put")))
    cuts = found.select("rid", F.explode(F.concat(base, terms)).alias("x")).select("rid", "x.*")
    before = Window.partitionBy("rid").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    cuts = cuts.withColumn("at", F.coalesce(F.max("end").over(before), F.lit(0)))
    kept = F.when(F.col("start") >= F.col("at"), F.struct("at", "start", "put"))
    cuts = cuts.groupBy("rid").agg(F.array_sort(F.collect_list(kept)).alias("cuts"), F.max("end").alias("rest")).select(F.col("rid").alias("_id"), F.struct("cuts", "rest").alias("_cuts"))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    parts = lambda b: F.array_join(F.transform("_cuts.cuts", lambda c: F.concat(_piece(b, c["at"], c["start"]), c["put"])), "")
    done = _let(blocks_of(text), lambda b: F.concat(parts(b), _piece(b, F.col("_cuts.rest"), F.length(text))))
    keyed = docs.select(F.struct("*").alias("row")).withColumn("_rid", _row_id(F.col("row.doc_id").cast("long"), text))
    joined = keyed.join(cuts, F.col("_rid") == F.col("_id"), "left")
    return joined.select(F.col("row").withField("text", F.when(F.col("_cuts").isNotNull(), done).otherwise(F.col("row.text"))).alias("row")).select("row.*")
