"""Secret scans: a random forest tells findings from false positives, in DataFrame functions and spark.ml only.

Candidates are unbroken strings of 16 key characters or more, and strings of any length that stand right
after a secret's name; '=' ends a candidate as padding only. The forest sees a candidate's length, its
character transitions (between classes, and their bits in the corpus' words), how much of it the corpus'
frequent words cover, its path (source) and the words around it. It is trained from labelled findings: those
given, the hand-labelled ones of this module, and of the candidates those in a provider's format as secrets
and card numbers and words of running text as false ones. No label is made from what the forest sees alone.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections import Counter
from functools import reduce
from string import ascii_lowercase

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pii import CHECKS, _let, _piece, _places, blocks_of
from .shared import materialize

#: Most frequent words of the corpus, of four letters or more, that count as its dictionary.
DICTIONARY_WORDS = 300
#: Bits of a transition that the corpus' words don't have.
RARE_BITS = 12.0
KEY = "[A-Za-z0-9_+/-]"
NAME = "(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential)[\"']?+\\s*+[:=]{1,2}+>?+\\s*+[\"'`]?+"
STRING = f"{KEY}{{16,}}+(?:={{1,2}}+(?![A-Za-z0-9_+/-]))?+"
#: After a name: a string as elsewhere, or what stands up to a blank, a delimiter or such a string.
VALUE = f"(?:{STRING}|(?:(?!(?<!{KEY}){KEY}{{16}})[^\\s\"'`<>&,;|(){{}}\\[\\]:=])(?:(?!(?<!{KEY}){KEY}{{16}})[^\\s\"'`<>&,;|(){{}}\\[\\]])*+)"
ASSIGNED = f"(?<!{KEY}){KEY}*?{NAME}"
CANDIDATE = f"{ASSIGNED}{VALUE}|(?<!{KEY}){STRING}"
PROVIDER = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abpr]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})$"
NAMED = NAME + "$"
FEATURES = ["length", "digits", "upper", "distinct", "transitions", "pair_bits", "covered", "named", "assigned", "quoted", "code_path", "words_left", "words_right", "hash_named"]
CLASSES = r"([A-Z]+|[a-z]+|[0-9]+|[_+/=-]+)"

#: Labelled findings: places of secrets, and of what only looks like one. {..} stands for values of a kind; see _values.
SECRETS = [
    ("a.env", "PASSWORD={pw}"), ("a.env", "export DB_PASSWORD={pw}"), ("app.yml", "password: '{pw}'"), ("app.yml", "pwd: {pw}"), ("a.py", 'token = "{hex40}"'), ("notes", 'the new one is token = "{hex40}" as agreed'), ("notes", 'token = "{hex32}", see above'), ("a.env", "AWS_SECRET_ACCESS_KEY={b64}"),
    ("a.json", '"api_key": "{mixed}",'), ("a.json", '"token":    "{short}",'), ("a.go", "secret := {hex32};"), ("a.sh", "curl https://a.example/x?page=2&token={mixed}&y=1"), ("a.js", "auth: '{mixed}'"), ("a.tf", 'access_key = "{mixed}"'), ("wiki", "login with password: {pw} please"), ("a.conf", "credential={b64}"), ("mail", "here is the api-key: {mixed} for you"), ("a.env", "TOKEN={hex64}"), ("notes", "secret := ab.{hex32};"), ("a.py", "API_KEY = '{b64}'"),
]
FALSE_ONES = [
    ("log", "commit {hex40} fixes the build"), ("log", "sha256:{hex64} ok"), ("readme", "md5 {hex32} file.iso"), ("log", "etag: \"{hex32}\""), ("a.json", '"integrity": "sha512-{b64}",'), ("log", "request {uuid} done"), ("notes", "the card {digits} was charged"), ("notes", "and {word}{word}{word} of the"), ("notes", "{word} {word}{word}{word}{word}, {word}"), ("a.py", "class {Word}{Word}{Word}(Base):"),
    ("a.py", "import {word}_{word}_{word}"), ("a.yml", "path: /usr/{word}/{word}/{word}"), ("app.yml", "password: {holder}"), ("a.env", "TOKEN={holder}"), ("a.js", "secret = '{holder}'"), ("a.py", "token = {word}_{word}"), ("a.py", "auth = {word}"), ("a.json", '"password": "{word}",'), ("readme", "see https://{word}.example/{word}-{word}-{word}"), ("notes", "the token: {word} {word}"), ("log", "build {digits} {digits}"), ("a.go", "revision {hex40}"), ("a.lock", 'checksum = "{hex64}"'), ("notes", "{digits} {word} {digits}"),
]
#: What stands for a secret in examples.
HOLDERS = "changeme password example your_token_here your_api_key xxxxxxxx null none true undefined required REPLACE_ME_WITH_YOUR_KEY test_test_test_test secret placeholder".split()


def _values(n: int) -> dict[str, str]:
    """The n-th value of each kind, from a digest of n."""
    d = hashlib.sha512(str(n).encode()).hexdigest()
    letters = "".join("etaoinshrdlucmfw"[int(c, 16)] for c in d)
    b64 = base64.b64encode(bytes.fromhex(d)).decode()
    mixed = b64.replace("+", "x").replace("/", "Q").replace("=", "")
    word = letters[: 4 + int(d[0], 16) % 6]
    pw = [letters[:6] + str(int(d[:2], 16)), letters[:4].title() + "@" + d[:3] + "!", letters[:3] + "." + d[:4] + "$", mixed[:12]][n % 4]
    return {"hex32": d[:32], "hex40": d[:40], "hex64": d[:64], "b64": b64[: 32 + 4 * (n % 8)], "mixed": mixed[: 16 + n % 25], "short": d[:2 + n % 10], "uuid": f"{d[:8]}-{d[8:12]}-4{d[13:16]}-a{d[17:20]}-{d[20:32]}", "digits": str(int(d[:16], 16))[:16], "word": word, "Word": word.title(), "pw": pw, "holder": HOLDERS[n % len(HOLDERS)]}


def labelled_findings(spark: SparkSession, times: int = 12) -> DataFrame:
    """doc_id, text, source and label of the hand-labelled findings, each with so many values."""
    rows = []
    for label, places in ((1.0, SECRETS), (0.0, FALSE_ONES)):
        for k, (path, text) in enumerate(places):
            for n in range(times):
                values = iter(range(100 * times * k + 100 * n, 10**9))
                rows.append((len(rows), re.sub(r"\{(\w+)\}", lambda m, v=values: _values(next(v))[m[1]], text), path, label))
    items = [F.struct(F.lit(i).cast("long").alias("doc_id"), F.lit(t).alias("text"), F.lit(p).alias("source"), F.lit(y).alias("label")) for i, t, p, y in rows]
    return spark.range(1).select(F.inline(F.array(*items)))


class Language:
    """The corpus' frequent words and the bits of its letter pairs: bounded statistics over all documents."""

    def __init__(self, docs: DataFrame):
        words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit("[a-z]{2,}"), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
        words = materialize(words, "words")
        self.words = [r["w"] for r in words.filter(F.length("w").between(4, 32)).orderBy(F.desc("n"), "w").limit(DICTIONARY_WORDS).collect()]
        both = F.concat(_pairs(F.col("w")), _pairs(F.expr("substring(w, 2)")))
        pairs = words.select("n", F.explode(both).alias("pair")).groupBy("pair").agg(F.sum("n").alias("n")).collect()  # 676 rows at most
        times, of = {r["pair"]: r["n"] for r in pairs}, Counter()
        for pair, n in times.items():
            of[pair[0]] += n
        self.bits = [min(RARE_BITS, -math.log2(times[a + b] / of[a])) if a + b in times else RARE_BITS for a in ascii_lowercase for b in ascii_lowercase]

    def covered(self, value: Column) -> Column:
        """The share of a value that frequent words cover."""
        if not self.words:
            return F.lit(0.0)
        longest = "|".join(sorted(self.words, key=lambda w: (-len(w), w)))
        return 1 - F.length(F.regexp_replace(F.lower(value), f"(?:{longest})", "")) / F.length(value)

    def pair_bits(self, value: Column) -> Column:
        """Mean bits of a value's neighbouring characters."""
        table, low = F.array(*map(F.lit, self.bits)), F.lower(value)
        at = lambda p: F.when(p.rlike("^[a-z]{2}$"), (F.ascii(p) - 97) * 26 + F.ascii(F.substring(p, 2, 1)) - 97)
        bits = lambda p: F.coalesce(F.get(table, at(p)), F.lit(RARE_BITS))
        total = lambda pairs: F.aggregate(pairs, F.lit(0.0), lambda s, p: s + bits(p))
        return (total(_pairs(low, ".")) + total(_pairs(F.substring(low, F.lit(2), F.length(low)), "."))) / F.greatest(F.length(value) - 1, F.lit(1))


def _pairs(value: Column, kind: str = "[a-z]") -> Column:
    return F.regexp_extract_all(value, F.lit(f"(?s){kind}{{2}}"), F.lit(0))


def candidates(docs: DataFrame, language: Language, around: int = 32) -> DataFrame:
    """A row for each candidate of docs(doc_id, text, source): doc_id, start, end, value and the features."""
    source = F.col("source") if "source" in docs.columns else F.lit(None)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(source.cast("string"), F.lit("")).alias("path"))

    def named(x: Column) -> Column:
        bare = F.regexp_replace(x["m"], rf"^{ASSIGNED}(?=[^:=])", "")
        value = F.regexp_replace(bare, r"(?<![.:])[.:]++$", "")  # what ends a sentence
        start = x["start"] + F.length(x["m"]) - F.length(bare)
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), (F.length(bare) < F.length(x["m"])).alias("named"))

    def with_sides(blocks: Column):
        left = lambda x: _piece(blocks, F.greatest(x["start"] - around, F.lit(0)), x["start"])
        right = lambda x: _piece(blocks, x["end"], F.least(x["end"] + around, F.length("text")))
        return lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), x["named"].alias("named"), left(x).alias("left"), right(x).alias("right"))

    places = F.transform(_places(F.col("text"), CANDIDATE), named)
    # sides are taken before the rows are made, so that no text is copied for each of its candidates
    every = _let(blocks_of(F.col("text")), lambda b: F.transform(places, with_sides(b)))
    found = rows.filter(F.col("text").rlike(CANDIDATE)).select("doc_id", "path", F.explode(every).alias("x")).select("doc_id", "path", "x.*").filter("value <> ''")
    value, size = F.col("value"), F.length("value")
    share = lambda keep: F.length(F.regexp_replace(value, f"[^{keep}]", "")) / size
    flag = lambda c: c.cast("double")
    words = lambda c: F.size(F.regexp_extract_all(F.col(c), F.lit(r"\p{L}{2,}"), F.lit(0))).cast("double")
    return found.withColumns({
        "length": size.cast("double"), "digits": share("0-9"), "upper": share("A-Z"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / size,
        "transitions": (F.size(F.regexp_extract_all(value, F.lit(CLASSES), F.lit(1))) - 1) / size,
        "pair_bits": language.pair_bits(value), "covered": language.covered(value),
        "named": flag(F.col("named") | F.col("left").rlike(NAMED)), "assigned": flag(F.col("named") | F.col("left").rlike(r"[:=]\s*[\"']?$")), "quoted": flag(F.col("left").rlike("[\"']$") & F.col("right").rlike("^[\"']")),
        "code_path": flag(F.col("path").rlike(r"(?i)\.(?:env|ya?ml|json|ini|conf|cfg|py|js|ts|go|java|rb|sh|tf)$|code|git")),
        "words_left": words("left"), "words_right": words("right"),
        "hash_named": flag(F.col("left").rlike("(?i)(?:commit|sha-?\\d*|md5|hash|digest|checksum|revision|integrity|etag|uuid|guid|request)\\W*$|sha512-$")),
    })


def _own_label() -> Column:
    """1 for values in a provider's format, 0 for card numbers and for words of running text, else null."""
    running = (F.col("assigned") == 0) | ((F.col("quoted") == 0) & F.col("right").rlike(r"^[.,;!?]? \p{L}"))
    return F.when(F.col("value").rlike(PROVIDER), 1.0).when(CHECKS["card"](F.col("value")) & F.col("value").rlike("^[0-9]+$"), 0.0).when(running & F.col("value").rlike("^[A-Z]?[a-z-]+$|^[A-Z]+$"), 0.0)


def train(sample: DataFrame) -> PipelineModel:
    """The forest from sample(FEATURES, label), where both labels weigh the same in all."""
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    weight = F.when(F.col("label") == 1, 1 / n[1.0]).otherwise(1 / n[0.0]) * (sum(n.values()) / 2)
    forest = RandomForestClassifier(numTrees=40, maxDepth=8, seed=11, labelCol="label", weightCol="weight")
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(sample.withColumn("weight", weight))


def _score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("score", F.round(vector_to_array("probability")[1], 6)).drop("features", "rawPrediction", "probability", "prediction")


def _sample(found: DataFrame, seeds: DataFrame, labelled: DataFrame | None, per_label: int) -> DataFrame:
    """value_sha256, label and features of the training rows: given and hand-labelled ones, and per_label of each own label, those of least hash."""
    columns = ["value_sha256", "label", *FEATURES]
    own = found.withColumnRenamed("own", "label").filter("label is not null").dropDuplicates(["value_sha256"])
    parts = [own.filter(F.col("label") == y).orderBy("value_sha256").limit(per_label).select(*columns) for y in (0, 1)] + [seeds.select(*columns)]
    if labelled is not None:
        given = labelled.select(F.sha2("value", 256).alias("value_sha256"), F.col("label").cast("double").alias("label"), *FEATURES).filter("label in (0, 1)")
        parts += [given.filter(F.col("label") == y).orderBy("value_sha256").limit(per_label) for y in (0, 1)]
    return materialize(reduce(DataFrame.unionByName, parts), "labelled")


def _prepared(docs: DataFrame, labelled: DataFrame | None, per_label: int) -> tuple[DataFrame, DataFrame]:
    """The candidates of docs and the training rows. Values themselves are not written, only their hashes."""
    language = Language(docs)
    kept = ["doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), F.col("value").rlike(PROVIDER).alias("provider"), *FEATURES]
    found = materialize(candidates(docs, language).select(*kept, _own_label().alias("own")), "candidates")
    texts = labelled_findings(docs.sparkSession)
    seeds = candidates(texts, language).select(*kept).join(texts.select("doc_id", "label"), "doc_id")
    return found, _sample(found, seeds, labelled, per_label)


def held_out(docs: DataFrame, labelled: DataFrame | None = None, *, sample_per_label: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """label, accepted and n: verdicts on the fifth of the labelled rows (by hash of the value) that a forest of the others hasn't seen."""
    _, sample = _prepared(docs, labelled, sample_per_label)
    unseen = F.conv(F.substring("value_sha256", 1, 4), 16, 10).cast("int") % 5 == 0
    scored = _score(train(sample.filter(~unseen)), sample.filter(unseen))
    return scored.groupBy("label", (F.col("score") >= threshold).alias("accepted")).agg(F.count("*").alias("n"))


def secret_scan(docs: DataFrame, labelled: DataFrame | None = None, *, sample_per_label: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """doc_id, start, end, value_sha256, score and is_secret for each candidate of docs(doc_id, text, source).

    labelled has the columns of candidates() and label (0 or 1); at most sample_per_label rows of each label,
    those of least hash, are taken from it, and as many from the candidates that label themselves. Values in
    a provider's format are secrets whatever the forest says. Null texts have no candidates; repeated rows
    give theirs each; other columns are ignored.
    """
    found, sample = _prepared(docs, labelled, sample_per_label)
    scored = _score(train(sample), found)
    return scored.select("doc_id", "start", "end", "value_sha256", "score", (F.col("provider") | (F.col("score") >= threshold)).alias("is_secret"))
