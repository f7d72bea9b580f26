"""URL filters: rules found by their rarest literal token.

A pattern is literal text with * for anything, ^ for a separator (any character
that is no letter, digit, _, -, . or %, or the end), || at its start for the start
of a host or of one of its subdomain labels, and | for either end of the URL. With
$host at its end it is held against the host alone; with @@ at its start it is an
exception, and what it fits isn't blocked by a pattern. A listed rule is a host and
the beginning of a path, with a verdict.

Tokens are runs of a-z and 0-9. A literal token of a rule is a run that the rule
delimits on both sides; a URL that the rule fits has it as a token. Of those the one
that the fewest URLs have is the rule's key. A URL fetches the rules of its tokens
by an equi-join, and runs the regular expressions and comparisons of those only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm.shared import ascii_lower, spread_join, written

#: Words that hosts of pages which sell, lure or track carry as a part of a label: the usual ones of such lists, by kind.
HOST_WORDS = {
    "gambling": "casino poker bet bets betting bingo jackpot lottery roulette slots gambling wager",
    "pharmacy": "pills pharmacy viagra cialis meds drugstore steroids",
    "adult": "adult porn xxx sex sexcam escort camgirls hentai nude",
    "advertising": "ads adserver adservice adnetwork banner banners clicktrack popads tracker tracking telemetry pixel",
    "fraud": "spam phishing malware scam warez keygen crack torrent clickbait linkfarm payday replica",
}
#: What pages of these kinds have in their paths and queries.
PATHS = (
    "/wp-login.php",
    "/xmlrpc.php",
    "/affiliate/*/click^",
    "/aff_c?",
    "/clk?",
    "/redirect?*url=http",
    "^utm_campaign=spam^",
    "^clickid=",
    "/download/*.exe|",
    "/download/*.scr|",
    "/track/*/pixel.gif",
    "/ads/*/banner^",
    "/phishing/",
)
#: Hosts that carry such words for other reasons.
EXCEPTIONS = ("@@||*.gov^$host", "@@||*.edu^$host", "@@||spam-filter.$host", "@@||ads-txt.$host", "@@||drug-safety.$host")


def default_patterns() -> tuple[str, ...]:
    """Each word as a label, at the beginning of one and at its end, on hosts; the paths; the exceptions."""
    forms = ("||{}.$host", "||{}-$host", "-{}.$host", "-{}-$host")
    words = [w for some in HOST_WORDS.values() for w in some.split()]
    return (*(form.format(w) for w in words for form in forms), *PATHS, *EXCEPTIONS)


#: Patterns of the method. A user's own go to judged() as a tuple, or as a table with a column pattern.
PATTERNS = default_patterns()
#: Host and path, verdict.
LISTED = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
RULE = "rule_id int, kind string, rule string, verdict string, regex string, on_host boolean, host string, path string"


def pattern_parts(pattern: str) -> tuple[str, str, bool]:
    """What a pattern says: its verdict, its text in lower case, and whether it is held against the host alone."""
    text = pattern.lower()
    verdict, text = ("allow", text[2:]) if text.startswith("@@") else ("block", text)
    return verdict, text.removesuffix("$host"), text.endswith("$host")


def pattern_regex(pattern: str) -> str:
    """The regular expression of a pattern, for lower-cased URLs, or hosts between two bars; Java's and RE2's syntax agree on it."""
    _, body, on_host = pattern_parts(pattern)
    label = "^[|]([^|]*[.])?" if on_host else "^[a-z][a-z0-9+.-]*://([^/?#]*[.])?"
    start = label if body.startswith("||") else "^[|]" if body.startswith("|") and on_host else "^" if body.startswith("|") else ""
    body = body.lstrip("|")
    end, body = ("[|]$" if on_host else "$", body[:-1]) if body.endswith("|") else ("", body)
    # A host stands between bars, which end it as a separator does.
    special = {"*": "[^|]*", "^": "[|]"} if on_host else {"*": ".*", "^": "([^a-z0-9_.%-]|$)"}
    return start + "".join(special.get(c) or (c if re.match(r"[a-z0-9_/=-]", c) else f"[{c}]") for c in body) + end


def pattern_tokens(pattern: str) -> list[str]:
    """Literal tokens: runs with a literal character or an anchor on both sides."""
    _, body, _ = pattern_parts(pattern)
    anchored = body.startswith("|")
    body = body.lstrip("|")
    closed, body = (True, body[:-1]) if body.endswith("|") else (False, body)
    out = []
    for m in re.finditer("[a-z0-9]+", body):
        before = body[m.start() - 1] if m.start() else "^" if anchored else "*"
        after = body[m.end()] if m.end() < len(body) else "^" if closed else "*"
        if before != "*" and after != "*":
            out.append(m.group())
    return out


def listed_tokens(rule: str) -> list[str]:
    """Literal tokens of a listed rule: all of its host, and those that its path ends."""
    host, slash, path = rule.partition("/")
    lower = lambda s: s.translate({c: c + 32 for c in range(65, 91)})
    return re.findall("[a-z0-9]+", lower(host)) + [m.group() for m in re.finditer("[a-z0-9]+(?=[^a-z0-9])", lower(slash + path))]


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)\A(?:(?!://).)*+://([^/?#]*+)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A(?:(?!://).)*+://[^/?#]*+([^?#]*+)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """The tokens of a URL, and the empty one, under which rules without a literal token are."""
    return F.array_append(F.array_distinct(F.regexp_extract_all(ascii_lower(url), F.lit("([a-z0-9]+)"), 1)), "")


def rule_table(spark: SparkSession, patterns: tuple[str, ...] | DataFrame, listed: tuple[tuple[str, str], ...]) -> DataFrame:
    """RULE and literals: patterns and listed rules alike. A table of patterns goes through the driver: it is a parameter, as the tuple is."""
    if isinstance(patterns, DataFrame):
        patterns = tuple(r.pattern for r in patterns.select("pattern").where("pattern IS NOT NULL").distinct().toLocalIterator())
    rows = [(k, "pattern", p, pattern_parts(p)[0], pattern_regex(p), pattern_parts(p)[2], None, None, pattern_tokens(p) or [""]) for k, p in enumerate(patterns)]
    for k, (rule, verdict) in enumerate(listed):
        host, slash, path = rule.partition("/")
        rows.append((len(patterns) + k, "listed", rule, verdict, None, None, host, slash + path, listed_tokens(rule) or [""]))
    return spark.createDataFrame(rows, f"{RULE}, literals array<string>")


def keyed_rules(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """(token, rules, n): every rule under the literal token that the fewest URLs have; counts is (token, n) of URLs."""
    literal = rules.withColumn("token", F.explode("literals")).drop("literals")
    ranked = literal.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    names = [c.split()[0] for c in RULE.split(", ")]
    best = ranked.groupBy("rule_id").agg(F.min_by(F.struct("token", "n", *names), F.struct("n", "token")).alias("r")).select("r.*")
    return best.groupBy("token").agg(F.collect_list(F.struct(*names)).alias("rules"), F.max("n").alias("n"))


def fitting_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule, verdict, hit) of those urls (url) that a rule fits: the longest listed rule, and whether a pattern fits and no exception.

    A token that very many URLs have is dealt to salts in the join.
    """
    each = urls.select("url", F.explode(tokens(F.col("url"))).alias("token"))
    counts = written(each.groupBy("token").agg(F.count("*").alias("n")), "url_tokens")
    keyed = keyed_rules(rules, counts)
    total = counts.agg(F.sum("n")).first()[0] or 1
    met = spread_join(each, keyed, ["token"], total).select("url", F.explode("rules").alias("r"))
    tried = met.select("url", "r.*", url_host(F.col("url")).alias("_at"), url_path(F.col("url")).alias("_under"))
    of_host = (F.col("_at") == F.col("host")) | F.endswith("_at", F.concat(F.lit("."), "host"))
    against = F.when(F.col("on_host"), F.concat(F.lit("|"), "_at", F.lit("|"))).otherwise(ascii_lower(F.col("url")))
    fits = F.when(F.col("kind") == "pattern", F.rlike(against, F.col("regex"))).otherwise(of_host & F.startswith("_under", F.col("path")))
    place = F.when(F.col("kind") == "listed", F.struct(F.length("rule"), F.col("rule")))
    best = F.max_by(F.struct("rule", "verdict"), place)
    return tried.where(fits).groupBy("url").agg(best.alias("b"), (F.max(F.col("kind") == "pattern") & ~F.bool_or((F.col("kind") == "pattern") & (F.col("verdict") == "allow"))).alias("hit")).select("url", "b.rule", "b.verdict", "hit")


def judged(pages: DataFrame, patterns: tuple[str, ...] | DataFrame = PATTERNS, listed: tuple[tuple[str, str], ...] = LISTED) -> DataFrame:
    """(page_id, host, path, rule, verdict): a row for each row of pages.

    A null URL, or one without ://, has an empty host and path, fits no listed
    rule and no pattern that names a host. Of listed rules that fit the longest
    wins, of equal ones the last by its text. Repeated rows and ids are judged
    each; URLs of any length are read whole; an empty table gives no rows. Other
    columns are not read.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    known = rows.where("url IS NOT NULL")
    urls = written(known.groupBy("url").agg(F.count("*").alias("n")), "urls")
    found = fitting_rules(urls, rule_table(pages.sparkSession, patterns, listed))
    told = urls.join(found, "url", "left")
    met = spread_join(known, told, ["url"], max(1, known.count())).select("page_id", "url", "rule", "verdict", "hit")
    every = met.unionByName(rows.where("url IS NULL").select("page_id", "url"), allowMissingColumns=True)
    verdict = F.coalesce("verdict", F.when(F.col("hit"), "block").otherwise("allow"))
    return every.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), "rule", verdict.alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every page's URL."""
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _any_sql(verdict: str) -> str:
    """Whether a pattern of this verdict fits, as SQL over url and host."""
    lower = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    tests = []
    for on_host in (True, False):
        some = [f"({pattern_regex(p)})" for p in PATTERNS if pattern_parts(p)[0] == verdict and pattern_parts(p)[2] == on_host]
        if some:
            tests.append(f"regexp_matches({"'|' || host || '|'" if on_host else lower}, '{'|'.join(some)}')")
    return "(" + " OR ".join(tests) + ")"


OP8_SQL = r"""
WITH p AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(rule, verdict) AS (VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')),
j AS (
  SELECT p.*, (SELECT max_by(struct_pack(rule := r.rule, verdict := r.verdict), length(r.rule)) FROM r
     WHERE (p.host = split_part(r.rule, '/', 1) OR ends_with(p.host, '.' || split_part(r.rule, '/', 1)))
       AND starts_with(p.path, substr(r.rule, length(split_part(r.rule, '/', 1)) + 1))) AS hit FROM p)
SELECT page_id, host, path, hit.rule AS rule,
       coalesce(hit.verdict, CASE WHEN {any} THEN 'block' ELSE 'allow' END) AS verdict FROM j
""".replace("{any}", _any_sql("block") + " AND NOT (" + _any_sql("allow") + ")")
