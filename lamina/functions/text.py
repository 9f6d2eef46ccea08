"""Text rules: references, aggregate messages, span checks, quotes, paths and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The claim type of each causal marker.
MARKER_TYPES = {
    "instead of": "tradeoff", "rather than": "tradeoff", "to avoid": "constraint", "to prevent": "constraint", "otherwise": "constraint", "避免": "constraint", "以免": "constraint", "否則": "constraint", "because": "why", "since": "why", "due to": "why", "in order to": "why", "so that": "why", "to ensure": "why", "the reason": "why", "reason:": "why", "why:": "why", "因為": "why", "由於": "why", "為了": "why", "理由：": "why", "理由:": "why", "原因：": "why", "原因:": "why",
}
# Patterns of references, list items, reverts and test paths.
CLOSING = r"(?i)\b(?:clos(?:e|es|ed)|fix(?:e[sd])?|resolv(?:e|es|ed))\s+#(\d+)"
BARE = r"#(\d+)"
LIST_ITEM = r"^[ \t]*(?:[*+-]|\d+[.)])[ \t]+"
ITEM_REFERENCE = r"(?:^|[^\w#])#(\d{1,7})\b"
REVERT = r"""(?i)^revert[\s:"']"""
TEST_DIRECTORY = r"(^|/)(__tests__|__mocks__|tests?|e2e|spec)/"
TEST_FILES = {r"\.([cm]?[jt]s|[jt]sx)$": r"\.(spec|test|bench)\.[cm]?[jt]sx?$", r"\.py$": r"(^|/)(test_[^/]+|[^/]+_test)\.py$"}
LEADING_MARKER = r"(?i)^(instead of|rather than|because(?: of)?|since|due to|in order to|so that|otherwise|to avoid|to prevent|to ensure|the reason|reason:|why:|因為|由於|為了|避免|以免|否則|理由|原因)[\s:,.，。：]*"


def references(body: Column) -> Column:
    """array<struct<to_key, confidence>> of #N in body, by number; 0.9 after a closing word, else 0.4."""
    closed = F.regexp_extract_all(body, F.lit(CLOSING), F.lit(1))
    keys = F.array_distinct(F.regexp_extract_all(body, F.lit(BARE), F.lit(1)))
    made = F.transform(keys, lambda k: F.struct(k.cast("decimal(38,0)").alias("n"), k.alias("to_key"), F.when(F.array_contains(closed, k), 0.9).otherwise(0.4).alias("confidence")))
    return F.transform(F.array_sort(made), lambda x: F.struct(x["to_key"], x["confidence"]))


def subject_end(message: Column) -> Column:
    return F.length(F.regexp_extract(message, r"(?s)^(.*?)(\r?\n|$)", 1))


def aggregate_signal(message: Column) -> Column:
    """struct<items, refs>: list items below the subject that carry references, and the different ones they carry."""
    body = F.substring(message, subject_end(message) + 1, F.length(message))
    rows = F.transform(F.filter(F.split(body, r"\r?\n", -1), lambda x: x.rlike(LIST_ITEM)), lambda x: F.regexp_extract_all(F.regexp_replace(x, LIST_ITEM, ""), F.lit(ITEM_REFERENCE), F.lit(1)))
    found = F.filter(rows, lambda x: F.size(x) > 0)
    return F.struct(F.size(found).alias("items"), F.size(F.array_distinct(F.flatten(found))).alias("refs"))


def is_aggregate(message: Column) -> Column:
    signal = aggregate_signal(message)
    return (signal["items"] >= 2) & (signal["refs"] >= 2)


def attributable(message: Column, char_start: Column) -> Column:
    """Whether a quote may be put down to the change; a null start is a quote from elsewhere."""
    return ~is_aggregate(message) | F.coalesce(char_start < subject_end(message), F.lit(False))


def verify_span(body: Column, body_sha: Column, start: Column, end: Column, quote: Column, expected_sha: Column) -> Column:
    """The first reason against a proposed span, or 'verified'. Offsets are code points."""
    part = F.substring(body, start + 1, end - start)
    return (
        F.when(F.coalesce(F.length(quote), F.lit(0)) == 0, "empty_quote")
        .when(start.isNull() | end.isNull() | (start < 0) | (end <= start), "malformed_range")
        .when(end > F.length(body), "out_of_range")
        .when(body_sha != expected_sha, "stale_document")
        .when(part == quote, "verified")
        .when(F.instr(body, quote) > 0, "offset_mismatch")
        .otherwise("text_not_found")
    )


def unwrap_quote(quote: Column) -> Column:
    return F.regexp_replace(quote, r"[ \t]*\r?\n[ \t]*", " ")


def marker_of(rule: Column) -> Column:
    return F.regexp_extract(rule, r"causal:([^/]+)(?:/result)?$", 1)


def scope_of(entities: Column) -> Column:
    return F.when(entities <= 1, "entity").otherwise("batch")


def is_test_path(path: Column) -> Column:
    out = path.rlike(TEST_DIRECTORY)
    for suffix, files in TEST_FILES.items():
        out |= path.rlike(suffix) & path.rlike(files)
    return out


def days_between(start: Column, end: Column) -> Column:
    """Days as a double, at least 0; 0 if either is missing."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.coalesce(F.greatest(F.lit(0.0), micros / F.lit(86_400_000_000.0)), F.lit(0.0))


def residue(quote: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(quote, LEADING_MARKER, ""), r"[\s\p{P}]+$", ""))


def quote_rules(quote: Column) -> Column:
    """The audit rules that a quote breaks."""
    hits = {
        "R1": F.length(quote) < 30,
        "R2": quote.rlike(r"\?\s*$"),
        "R3": quote.rlike(r":\s*$"),
        "R4": F.length(residue(quote)) < 4,
        "R5": residue(quote).rlike(r"(?i)^(this|that|it|these|those|這|那|它)[\s\p{P}]*$"),
    }
    return F.filter(F.array(*[F.when(hit, F.lit(k)) for k, hit in hits.items()]), lambda x: x.isNotNull())


def github_origin(url: Column) -> Column:
    """owner/name of an https or ssh remote, or null."""
    return F.nullif(F.regexp_extract(url, r"^(?:https?://(?:[^@/]+@)?|git@|ssh://git@)github\.com[/:]([^/\s]+/[^/\s]+?)(?:\.git)?/?$", 1), F.lit(""))


def annual_rate(structural: Column, days: Column) -> Column:
    return F.try_divide(structural, days / 365)


def ambiguity_meaning(tier: Column) -> Column:
    return F.when(tier == "L3c", "content-class-size").when(tier.isin("L4", "L5"), "tied-candidates").otherwise("unique-by-construction")


def json_valid(value: Column) -> Column:
    return F.try_parse_json(value).isNotNull()


# What an address leaves as it is and the form encoding doesn't, and blanks.
_ADDRESS = {"+": "%20", "%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}


def _encoded(part: Column) -> Column:
    out = F.url_encode(part)
    for form, plain in _ADDRESS.items():
        out = F.replace(out, F.lit(form), F.lit(plain))
    return out


def timeline_address(key: Column, sha: Column) -> Column:
    """#key or, where a commit is given, #key/sha; both percent-encoded, so the slash is the only one."""
    return F.concat(F.lit("#"), _encoded(key), F.when(F.coalesce(sha, F.lit("")) != "", F.concat(F.lit("/"), _encoded(sha))).otherwise(""))


def parse_address(address: Column) -> Column:
    """struct<key, sha> of an address with or without a commit."""
    parts = F.split(F.regexp_replace(address, "^#", ""), "/", 2)
    plain = lambda c: F.trim(F.url_decode(F.replace(F.coalesce(c, F.lit("")), F.lit("+"), F.lit("%2B"))))
    return F.struct(plain(F.get(parts, F.lit(0))).alias("key"), plain(F.get(parts, F.lit(1))).alias("sha"))
