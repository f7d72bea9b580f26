"""Personal data: base patterns, and identifiers that contexts give away.

Base entities come from regular expressions. They, and strings shaped like keys,
seed a bootstrap: the words to the left and right of seeds are lexical patterns, and
every identifier-like string in such a context is one of its instances, as is a word
that is given a name in quotes. Spark scores
the graph of patterns and instances in rounds (a pattern by the share of its
instances that are believed, an instance by the patterns around it) until neither
changes. Instances of high-confidence patterns are discovered identifiers, whether
they were believed at first or not. DataFrame functions only.

All expressions are linear in a text's length, runs of one character class of any
length included: a match starts at the end of the last one or where its class
begins, and what it takes it doesn't give back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm.shared import named, spread_join, written

# The entities as they are to be found, in forms that don't backtrack.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Identifier-like strings: letters and digits, parted by single - . / or, between digits, blanks.
CANDIDATE = r"(?<![A-Za-z0-9])(?<![A-Za-z0-9][-./])(?=(?:[A-Za-z]++[-./])*+[A-Za-z]*+[0-9])[A-Za-z0-9]++(?:[-./][A-Za-z0-9]++)*+(?:(?<=[0-9]) [0-9]++(?![A-Za-z0-9]))*+"
#: What is given a name: a word in quotes after = or :, which needs no digit to be a candidate.
NAMED = r"(?<=[=:][\"'])[A-Za-z][A-Za-z_-]++(?=[\"'])|(?<=[=:] [\"'])[A-Za-z][A-Za-z_-]++(?=[\"'])"
#: Letters and digits that an identifier has at least; one of them is a digit, unless it is given a name.
LEAST_CHARS = 5
#: Candidates of this shape are seeds as base entities are, but found only where a context confirms them, and then told as a kind of their own.
KEY = r"^(?=[0-9]*+[A-Fa-f])(?=[A-Fa-f]*+[0-9])[0-9A-Fa-f]{32,}+$"
#: Unbelieved instances that every pattern is thought to have; what a pattern needs to be trusted, its believed instances among that.
DOUBT, CONFIDENT, LEAST_SEEDS = 2.0, 0.6, 3
#: What an instance needs to be believed: the chance that one of its trusted patterns is right.
BELIEVED = 0.6
#: Characters of a block; a context is read from at least one whole block to either side.
WINDOW = 512
_ONE = r"^([^\p{L}\p{N}]*+[\p{L}\p{N}]++)"
_TWO = r"^([^\p{L}\p{N}]*+[\p{L}\p{N}]++[^\p{L}\p{N}]++[\p{L}\p{N}]++)"
_STEP = 64


def _matches(text: str, regex: str, name: str, df: DataFrame) -> DataFrame:
    """df with the column name: array<struct<start, end, m>> of all matches; positions in code points.

    Java's split and find walk the same matches, so the parts between them give
    their places. Prefix sums go by blocks: n matches take n * n / 8192 additions,
    about as many as n for the thousands that a long text has.
    """
    df = df.withColumn("_m", F.regexp_extract_all(F.col(text), F.lit(regex), F.lit(0)))
    df = df.withColumn("_p", F.when(F.size("_m") > 0, F.split(F.col(text), regex, -1)))
    df = df.withColumn("_l", F.transform("_m", lambda m, i: F.length(m) + F.length(F.get("_p", i))))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    blocks = lambda n: F.sequence(F.lit(0), F.floor(n / _STEP).cast("int"))
    df = df.withColumn("_b", F.transform(blocks(F.size("_l")), lambda b: total(F.slice("_l", b * _STEP + 1, F.lit(_STEP)))))
    df = df.withColumn("_o", F.transform("_b", lambda _, b: total(F.slice("_b", F.lit(1), b))))

    def place(m: Column, i: Column) -> Column:
        block = F.floor(i / _STEP).cast("int")
        start = F.get("_o", block) + total(F.slice("_l", block * _STEP + 1, i - block * _STEP)) + F.length(F.get("_p", i))
        return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("m"))

    return df.withColumn(name, F.transform("_m", place)).drop("_m", "_p", "_l", "_b", "_o")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), worth), F.lit(0), lambda a, b: a + b) % 10 == 0


_BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
SOUND = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
    "card": lambda m: F.when(F.length(_digits(m)).between(16, 19), _luhn(_digits(m))).otherwise(False),
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
}


def _sound(kind: str) -> Column:
    return F.filter(kind, lambda s: SOUND[kind](s["m"]))


def _of_kind(kind: str) -> Column:
    return F.transform(kind, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _patterns(s: Column) -> Column:
    """The contexts of a span: the last word and the last two to its left, the first word to its right, lower case, with the marks between them and the span."""
    b, e = F.floor(s["start"] / WINDOW).cast("int"), F.floor(s["end"] / WINDOW).cast("int")
    part = lambda i: F.coalesce(F.get("_blocks", i), F.lit(""))
    before = F.reverse(F.lower(F.concat(part(b - 1), F.substring(part(b), F.lit(1), s["start"] - b * WINDOW))))
    after = F.lower(F.concat(F.substring(part(e), s["end"] - e * WINDOW + 1, F.lit(WINDOW)), part(e + 1)))
    tidy = lambda side, c: F.concat(F.lit(side), F.regexp_replace(c, r"\s+", " "))
    found = F.array(*(tidy("<", F.reverse(F.regexp_extract(before, x, 1))) for x in (_ONE, _TWO)), tidy(">", F.regexp_extract(after, _ONE, 1)))
    return F.filter(found, lambda p: F.length(p) > 1)


def _instance(m: Column) -> Column:
    """What an instance goes by: its text, or the digest of a long one."""
    return F.when(F.length(m) > 64, F.sha2(m, 256)).otherwise(m)


def base_entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a column for each kind of BASE, and candidates: array<struct<start, end, m>>; seen holds their contexts.

    Leftmost matches that don't overlap, of which those that fail their check are
    dropped. candidates are identifier-like strings that overlap no base entity.
    seen is array<struct<instance, seed, patterns>> of both.
    """
    df = docs.withColumn("_text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    # A text without the character that a kind needs can't hold it.
    needs = {"email": F.contains("_text", F.lit("@")), "phone": F.contains("_text", F.lit("+"))}
    has_digit = F.col("_text").rlike("[0-9]")
    for kind, regex in BASE.items():
        df = df.withColumn("_some", F.when(needs.get(kind, has_digit), F.col("_text")).otherwise(""))
        df = _matches("_some", regex, kind, df).withColumn(kind, _sound(kind))
    df = _matches("_some", CANDIDATE, "candidates", df.withColumn("_some", F.when(has_digit, F.col("_text")).otherwise("")))
    df = _matches("_some", NAMED, "_named", df.withColumn("_some", F.when(F.col("_text").rlike("[=:] ?[\"'][A-Za-z]"), F.col("_text")).otherwise("")))
    spans = F.concat(*(F.col(k) for k in BASE))
    free = lambda c: ~F.exists(spans, lambda s: (s["start"] < c["end"]) & (s["end"] > c["start"]))
    sound = lambda c: (F.length(F.regexp_replace(c["m"], "[^A-Za-z0-9]", "")) >= LEAST_CHARS) & c["m"].rlike("[0-9]")
    worded = F.filter("_named", lambda c: F.length(F.regexp_replace(c["m"], "[^A-Za-z]", "")) >= LEAST_CHARS)
    df = df.withColumn("candidates", F.filter(F.concat(F.filter("candidates", sound), worded), free))
    df = df.withColumn("_blocks", F.when(F.size(F.concat(spans, "candidates")) > 0, F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{WINDOW}}}"), F.lit(0))))
    told = lambda seed: lambda s: F.struct(_instance(s["m"]).alias("instance"), seed(s["m"]).alias("seed"), _patterns(s).alias("patterns"))
    seen = F.concat(F.transform(spans, told(lambda m: F.lit(True))), F.transform("candidates", told(lambda m: m.rlike(KEY))))
    return df.withColumn("seen", seen).drop("_text", "_some", "_named", "_blocks")


def trusted_instances(found: DataFrame) -> DataFrame:
    """(instance, belief): what stands in trusted contexts, from rows of base_entities().

    Pairs of pattern and instance count once, however often they occur; an
    instance that is a seed anywhere is one everywhere. Scores only grow from round
    to round, so trusted patterns stay so and the rounds come to an end. Patterns
    and instances that very many edges share are dealt to salts in the joins.
    """
    seen = found.select(F.inline("seen")).select("instance", "seed", F.explode("patterns").alias("pattern"))
    edges = written(seen.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pii_edges")
    total = edges.count()
    links = edges.select("pattern", "instance")
    instances = edges.groupBy("instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n")).withColumn("belief", F.lit(0.0))
    before = None
    while True:
        score = instances.select("instance", "n", F.when(F.col("seed"), 1.0).otherwise(F.col("belief")).alias("score"))
        patterns = spread_join(links, score, ["instance"], total).groupBy("pattern").agg((F.sum("score") / (F.count("*") + F.lit(DOUBT))).alias("trust"), F.count_if(F.col("score") >= BELIEVED).alias("support"), F.count("*").alias("n"))
        patterns = written(patterns.where((F.col("trust") >= CONFIDENT) & (F.col("support") >= LEAST_SEEDS)), "pii_patterns")
        doubt = spread_join(links, patterns, ["pattern"], total).groupBy("instance").agg(F.exp(F.sum(F.log(1 - F.least("trust", F.lit(0.999))))).alias("doubt"))
        instances = written(instances.drop("belief").join(doubt, "instance", "left").select("instance", "seed", "n", (1 - F.coalesce("doubt", F.lit(1.0))).alias("belief")), "pii_instances")
        now = (patterns.count(), *instances.agg(F.count_if(F.col("belief") >= BELIEVED), F.round(F.sum("belief"), 3)).first())
        if now == before:
            return instances.where(F.col("belief") >= BELIEVED).select("instance", "belief")
        before = now


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, found): spans array<struct<kind, start, end>> of base entities, and what contexts add: of kind key what has the shape of one, of kind id all else.

    A context is read from the blocks of WINDOW characters around a span: a word that
    is longer than them is cut there, and two such words count as one context.
    Null texts count as empty. Repeated rows and ids each get their row: found
    spans join by id and a hash of the text. Texts and identifiers of any length
    are read whole. An empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"))
    found = written(base_entities(rows).withColumn("h", F.xxhash64("text")).drop("text"), "pii_base")
    places = found.where(F.size("candidates") > 0).select("doc_id", "h", F.explode("candidates").alias("c")).select("doc_id", "h", "c.start", "c.end", _instance(F.col("c.m")).alias("instance"), F.when(F.col("c.m").rlike(KEY), "key").otherwise("id").alias("kind"))
    counts = written(places.groupBy("instance").agg(F.count("*").alias("n")).join(trusted_instances(found), "instance").select("instance", "n"), "pii_found")
    hits = spread_join(places, counts, ["instance"], max(1, places.count()))
    hits = hits.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.struct("kind", F.col("start").alias("start"), F.col("end").alias("end")))).alias("found"))
    hits = hits.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "found")
    base = found.select("doc_id", "h", F.concat(*map(_of_kind, BASE)).alias("base"))
    joined = base.join(hits, base["doc_id"].eqNullSafe(hits["_id"]) & (base["h"] == hits["_h"]), "left")
    return joined.select("doc_id", "base", F.coalesce("found", F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("found"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents; n_key and n_id count what contexts add by kind, n_found both, n_spans all spans."""
    spans = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE]
    of = F.transform("found", lambda s: s["kind"])
    added = [(F.size("found") - F.size(F.array_remove(of, k))).cast("long").alias(f"n_{k}") for k in ("key", "id")]
    more = [*added, F.size("found").cast("long").alias("n_found"), (F.size("base") + F.size("found")).cast("long").alias("n_spans")]
    return spans.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "found")).alias("spans"), *more)
