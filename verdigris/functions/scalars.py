"""Scalar functions of records, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the record model.
CLASSES = ("silent-zero-revenue", "immutable-after-deploy", "unchecked-staleness", "missing-slippage-guard", "auth-bypass", "unconfirmed-state", "wrong-constant", "missing-verification", "other")
SEVERITIES = ("critical", "high", "medium", "low")
#: White space as the record model has it: ASCII and the Unicode blanks.
BLANK = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"


def pick(key: Column, values: dict[str, object], default: object = None) -> Column:
    """The value of a small fixed table for key."""
    out = F.lit(default)
    for name, value in values.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def severity_rank(severity: Column) -> Column:
    """critical 4 to low 1, anything else 0."""
    return pick(severity, {"critical": 4, "high": 3, "medium": 2, "low": 1}, 0)


def collapse_blank(text: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{BLANK}+", " "))


def short_digest(text: Column, size: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, size)


def content_key(trap_id: Column, sdk: Column, snippet: Column) -> Column:
    """First 16 hex digits of SHA-256 over trap, sdk and collapsed snippet, null characters between."""
    nothing = F.lit("")
    return short_digest(F.concat(F.coalesce(trap_id, nothing), F.lit("\0"), F.coalesce(sdk, nothing), F.lit("\0"), collapse_blank(F.coalesce(snippet, nothing))))


def proven(red: Column, green: Column) -> Column:
    return F.coalesce(red, F.lit(False)) & F.coalesce(green, F.lit(False))


def quality_score(severity: Column, corroboration: Column, is_proven: Column) -> Column:
    """round(100 * severity weight * (0.6 + 0.4 * min(corroboration, 5) / 5)) in whole numbers; 0 if unproven."""
    tenths = pick(severity, {"critical": 10, "high": 8, "medium": 5, "low": 3}, 3)
    seen = F.least(F.greatest(F.coalesce(corroboration, F.lit(0)), F.lit(0)), F.lit(5))
    return F.when(is_proven, F.floor((tenths * (30 + 4 * seen) * 2 + 5) / 10)).otherwise(0).cast("int")


def snippet_trim(text: Column, size: int) -> Column:
    """Trimmed text cut at size characters with a mark; null when blank."""
    cut = F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")
    return F.when(F.length(cut) == 0, None).when(F.length(cut) > size, F.concat(F.substring(cut, 1, size), F.lit("\n…"))).otherwise(cut)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def license_bucket(license_id: Column) -> Column:
    """permissive, weak-copyleft, strong-copyleft, none or unknown."""
    name = F.upper(F.coalesce(license_id, F.lit("")))
    # Licences by bucket.
    permissive = ("MIT", "APACHE-2.0", "BSD-2-CLAUSE", "BSD-3-CLAUSE", "ISC", "0BSD", "UNLICENSE", "MPL-2.0", "CC0-1.0", "ZLIB")
    weak = ("LGPL-2.1", "LGPL-3.0", "EPL-2.0", "CDDL-1.0")
    strong = ("GPL-2.0", "GPL-3.0", "AGPL-3.0", "SSPL-1.0")
    return F.when(name.isin(*permissive), "permissive").when(name.isin(*weak), "weak-copyleft").when(name.isin(*strong), "strong-copyleft").when(name.isin("NOASSERTION", "NONE", ""), "none").otherwise("unknown")


def severity_from_score(value: Column) -> Column:
    """Severity of an advisory's score or word: 9, 7 and 4 are bounds, moderate is medium, anything else is high."""
    number = F.regexp_extract(F.trim(value), r"^([-+]?[0-9]+(\.[0-9]+)?)", 1)
    score = F.when(number != "", number.try_cast("double"))
    word = F.lower(F.trim(value))
    by_score = F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").otherwise("low")
    return F.when(score.isNotNull(), by_score).when(word == "moderate", "medium").when(word.isin(*SEVERITIES), word).otherwise("high")


def age_days(then: Column, now: int) -> Column:
    """Days from an epoch second to now."""
    return (F.lit(now) - then) / 86400.0


def lamports_text(lamports: Column) -> Column:
    """Whole units of 10^9 with up to nine decimals and no zeros behind them."""
    text = (lamports.cast("decimal(38,9)") / F.lit(10**9).cast("decimal(38,0)")).cast("decimal(38,9)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")


def snake_case(text: Column) -> Column:
    """Words of camel case, blanks and dashes parted by underscores, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1_$2"), "[\\s-]+", "_"))


# Patterns that end the ids of rules about the same mistake.
RULE_PATTERNS = ("algorithm-none", "decode-missing-verify", "ignoreexpiration-true", "reject-unauthorized-false", "cookie-secure-false", "cookie-samesite-none", "saveuninitialized-true")


def rule_pattern(rule_id: Column) -> Column:
    """The known pattern that ends an id in any case, else the id."""
    return F.coalesce(*(F.when(F.endswith(F.lower(rule_id), F.lit(p)), F.lit(p)) for p in RULE_PATTERNS), rule_id)


def usd_text(value: Column) -> Column:
    """Dollars in billions (two decimals), millions (one), thousands (none) or as they are; a dash for none."""
    part = lambda size, digits: F.format_string(f"%.{digits}f", value / F.lit(float(size)))
    big = F.when(value >= 1e9, F.concat(part(1e9, 2), F.lit("B"))).when(value >= 1e6, F.concat(part(1e6, 1), F.lit("M"))).when(value >= 1e3, F.concat(part(1e3, 0), F.lit("K")))
    return F.when(value.isNull(), "—").otherwise(F.concat(F.lit("$"), F.coalesce(big, F.round(value).cast("long").cast("string"))))


def age_text(then: Column, now: int) -> Column:
    """How long ago an epoch second is: never, just now, minutes, hours up to two days, days; null if it lies ahead."""
    minutes = F.floor((F.lit(now) - then) / 60)
    told = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    some = F.when(minutes < 1, "just now").when(minutes < 60, told(minutes, "m")).when(minutes < 48 * 60, told(F.floor(minutes / 60), "h")).otherwise(told(F.floor(minutes / 1440), "d"))
    return F.when(then.isNull(), "never").when(then <= now, some)


def invoked_programs(logs: Column) -> Column:
    """The distinct programs that lines of a log invoke, at any depth, in the order they come."""
    called = F.transform(logs, lambda x: F.regexp_extract(x, r"^Program (\S+) invoke \[[0-9]+\]$", 1))
    return F.array_distinct(F.filter(called, lambda x: x != ""))


def add_days(then: Column, days: Column | int) -> Column:
    """An epoch second so many days on."""
    return then + 86400 * (days if isinstance(days, Column) else F.lit(days))


def canonical_json(text: Column) -> Column:
    """JSON of any depth in one form: keys of all objects in the order of their characters, no blanks, escapes only where they must be; null for what isn't JSON.

    The variant type holds objects by sorted keys and strings by their characters.
    Numbers of up to 38 digits keep them without zeros at the end; others are doubles.
    An object that names a key twice is no JSON here.
    """
    return F.to_json(F.try_parse_json(text))


BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def base58_thresholds(size: int) -> list[str]:
    """Numerals of 256 ** k for k up to size, without leading ones: where the length in bytes rises."""

    def numeral(n: int) -> str:
        return (numeral(n // 58) if n >= 58 else "") + BASE58[n % 58]

    return [numeral(256**k) for k in range(size + 1)]


def base58_decodes_to(value: Column, size: int) -> Column:
    """Whether a text of base58 digits stands for exactly so many bytes.

    A leading one is a zero byte; the rest is a number. Its bytes follow from
    comparing its numeral with those of the powers of 256, by length and then by
    digits, which are in the order of their characters: no number is computed.
    """
    rest = F.regexp_replace(value, "^1+", "")
    zeros = F.length(value) - F.length(rest)
    steps = F.array(*map(F.lit, base58_thresholds(size)))
    least, over = F.get(steps, F.lit(size - 1) - zeros), F.get(steps, F.lit(size) - zeros)
    before = lambda a, b: (F.length(a) < F.length(b)) | ((F.length(a) == F.length(b)) & (a < b))
    sized = F.when(zeros == size, rest == "").when(zeros > size, False).otherwise(~before(rest, least) & before(rest, over))
    return F.coalesce(sized & ~value.rlike(f"[^{BASE58}]"), F.lit(False))
