"""Secret scans, with DataFrame functions only.

Base findings come from three fixed patterns. A regular expression function gives matches without their places, so a text is also
split by the same pattern: the lengths of the parts and matches, added up, are the places (in code points, end exclusive). Sums, and
greatest and least values, run over an array in rounds of doubling distance, so n matches cost n log n and not n squared; what a candidate
overlaps is read off such running values over candidates and base findings in order.

On top, candidate strings (runs of WINDOW or more of the characters that keys are written in) are scored by Shannon
entropy: a window of WINDOW characters slides over a candidate, an array of counts follows it by one step down and one up, and
the sum of c*log2(c) is mended by the four changed terms, so that a step never counts anew. The threshold depends on the
candidate's character class: hex digits, letters of both cases, or letters with digits. Runs of letters of one case are words. Candidates that touch a
base finding or match an entry of the allow-list are suppressed.

Defined results: a null or empty text has no spans (counts 0, sha256 of the empty string, spans ''). Every row gives a row;
repeated rows give equal rows. Very long texts are scanned whole. A null doc_id is kept as it is, and redacted() keeps all columns whatever
their names. Added kinds are entropy_hex, entropy_mixed and
entropy_alnum; they sort after the base kinds at the same start.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import table

# The base patterns and the least lengths of what they find.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_VALUE = 12

WINDOW = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Least entropy, in bits a character, of the best window. 20 characters reach 4.32 at most.
LEAST_BITS = {"entropy_hex": 2.9, "entropy_mixed": 3.65, "entropy_alnum": 3.45}
#: Candidates that match one of these are not secrets.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    r"^[0-9+/_=-]+$",
    r"^[a-z+/_=-]+$",
    r"^[A-Z+/_=-]+$",
    r"^[A-Z]?[a-z]+([/_-][A-Z]?[a-z]+)*$",
    r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|abcdefgh|12345678|00000000",
)
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_mixed", "entropy_alnum")
MASK = "<SECRET>"

CHUNK = 1024
_SPANS = "array<struct<start:int,ord:int,kind:string,end:int>>"
_FOUND = "array<struct<start:int,end:int,value:string>>"
_FAR = (1 << 31) - 1


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once: a one-element array binds it to a name."""
    return F.transform(F.array(value), use)[0]


def _running(values: Column, both: Callable[[Column, Column], Column]) -> Column:
    """Of each place, both() over all values up to it."""

    def over(v: Column) -> Column:
        distances = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda d: d < F.size(v))
        return F.aggregate(distances, v, lambda s, d: F.transform(s, lambda x, i: F.when(i >= d, both(x, F.get(s, i - d))).otherwise(x)))

    return _bound(values, over)


def _located(text: Column, pattern: str, group: int | None = None) -> Column:
    """Matches as an array of (start, end, value), in order; value is the given group, or the match."""
    regex = F.lit(pattern)
    matches = F.regexp_extract_all(text, regex, F.lit(0))
    values = matches if group is None else F.regexp_extract_all(text, regex, F.lit(group))

    def placed(h: Column) -> Column:
        sizes = F.zip_with(h["m"], h["p"], lambda m, p: F.coalesce(F.length(m), F.lit(0)) + F.length(p))
        ended = lambda ends: F.transform(h["m"], lambda m, i: F.struct((ends[i] - F.length(m)).alias("start"), ends[i].alias("end"), h["v"][i].alias("value")))
        return _bound(_running(sizes, lambda a, b: a + b), ended)

    parts = F.struct(matches.alias("m"), values.alias("v"), F.split(text, pattern, -1).alias("p"))
    return F.when(text.rlike(pattern), _bound(parts, placed)).otherwise(F.lit(None).cast(_FOUND))


def _apart(candidates: Column, base: Column) -> Column:
    """The candidates that overlap no base finding, in order."""
    shape = "array<struct<start:int,end:int,base:boolean,value:string>>"

    def row(x: Column, is_base: bool) -> Column:
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(is_base).alias("base"), F.lit(None).cast("string").alias("value") if is_base else x["value"].alias("value"))

    ordered = F.array_sort(F.concat(F.transform(candidates, lambda x: row(x, False)).cast(shape), F.transform(base, lambda x: row(x, True)).cast(shape)))

    def over(rows: Column) -> Column:
        ends = _running(F.transform(rows, lambda x: F.when(x["base"], x["end"]).otherwise(-1)), F.greatest)
        starts = F.reverse(_running(F.reverse(F.transform(rows, lambda x: F.when(x["base"], x["start"]).otherwise(_FAR))), F.least))
        free = lambda near: F.filter(rows, lambda x, i: ~x["base"] & (near["ends"][i] <= x["start"]) & (near["starts"][i] >= x["end"]))
        return _bound(F.struct(ends.alias("ends"), starts.alias("starts")), free)

    kept = F.transform(_bound(ordered, over), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))
    return F.when(F.size(candidates) > 0, kept)


def _as_spans(found: Column, kind: str | Column) -> Column:
    kinds = F.lit(kind) if isinstance(kind, str) else kind
    order = F.array_position(F.array(*map(F.lit, KINDS)), kinds).cast("int")
    made = F.transform(found, lambda x: F.struct(x["start"].alias("start"), order.alias("ord"), kinds.alias("kind"), x["end"].alias("end")))
    return F.coalesce(made, F.array()).cast(_SPANS)


def _weight(count: Column) -> Column:
    """c * log2(c) for the counts that a window can have."""
    return F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)])[count]


def best_entropy(value: Column) -> Column:
    """The highest entropy of any WINDOW characters of value, by counts that follow the sliding window."""
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    slots = F.sequence(F.lit(1), F.lit(len(ALPHABET)))

    def over(codes: Column) -> Column:
        begin = F.slice(codes, 1, WINDOW)
        counts = F.transform(slots, lambda k: F.size(F.filter(begin, lambda c: c == k)))

        def from_counts(counts: Column) -> Column:
            total = F.aggregate(counts, F.lit(0.0), lambda s, c: s + _weight(c))
            first = F.struct(counts.alias("counts"), total.alias("now"), total.alias("least"))

            def step(s: Column, i: Column) -> Column:
                gone, come = codes[i - WINDOW - 1], codes[i - 1]
                less, more = s["counts"][gone - 1], s["counts"][come - 1]
                now = s["now"] + _weight(less - 1) - _weight(less) + _weight(more + 1) - _weight(more)
                moved = F.transform(s["counts"], lambda c, k: F.when(k == gone - 1, c - 1).when(k == come - 1, c + 1).otherwise(c))
                return F.when(gone == come, s).otherwise(F.struct(moved.alias("counts"), now.alias("now"), F.least(s["least"], now).alias("least")))

            places = F.when(F.size(codes) > WINDOW, F.sequence(F.lit(WINDOW + 1), F.size(codes))).otherwise(F.array().cast("array<int>"))
            return F.aggregate(places, first, step, lambda s: s["least"])

        return _bound(counts, from_counts)

    least = _bound(codes, over)
    return F.lit(math.log2(WINDOW)) - least / WINDOW


def _class(value: Column) -> Column:
    return F.when(value.rlike("^[0-9a-fA-F]+$"), F.lit("entropy_hex")).when(value.rlike("[0-9]"), F.lit("entropy_alnum")).otherwise(F.lit("entropy_mixed"))


def scan(docs: DataFrame) -> DataFrame:
    """row (all columns of docs), base and added: sorted arrays of (start, ord, kind, end)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.struct(*docs.columns).alias("row"), "text")
    hits = own.withColumns({"_assign": _located(text, ASSIGN, 2), "_access": _located(text, ACCESS), "_hex": _located(text, HEX), "_cand": _located(text, CANDIDATE)})
    values = F.filter("_assign", lambda x: F.length(x["value"]) >= LEAST_VALUE)
    based = hits.withColumn("base", F.array_sort(F.concat(_as_spans(values, "assign"), _as_spans(F.col("_access"), "access"), _as_spans(F.col("_hex"), "hex"))))

    def open_case(x: Column) -> Column:
        return functools.reduce(operator.and_, [~x["value"].rlike(p) for p in ALLOWED])

    opened = based.withColumn("_cand", F.filter(_apart(F.col("_cand"), F.col("base")), open_case))
    scored = opened.withColumn("_cand", F.when(F.size("_cand") > 0, F.transform("_cand", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), _class(x["value"]).alias("kind"), best_entropy(x["value"]).alias("bits")))))
    least = F.create_map(*[F.lit(x) for pair in LEAST_BITS.items() for x in pair])
    strong = F.filter("_cand", lambda x: x["bits"] >= least[x["kind"]])
    order = F.array(*map(F.lit, KINDS))
    added = F.transform(strong, lambda x: F.struct(x["start"].alias("start"), F.array_position(order, x["kind"]).cast("int").alias("ord"), x["kind"].alias("kind"), x["end"].alias("end")))
    return scored.withColumn("added", F.coalesce(added, F.array()).cast(_SPANS)).select("row", "base", "added")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of docs (doc_id, text)."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    found = scan(docs.select("doc_id", "text")).select("row.doc_id", "base", "added")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", "added"))).alias("spans"))


def redacted(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """docs, all columns, with every span of the text replaced by mask; n_chars, if there is one, follows the text. Spans that touch
    or overlap become one mask. A null text stays null."""
    found = scan(docs).select("row", F.array_sort(F.concat("base", "added")).alias("spans"))

    def masked(t: Column) -> Column:
        # a piece is cut from the few chunks that it lies in, since cutting walks a text from its start
        def piece(chunks: Column, a: Column, b: Column) -> Column:
            first = F.floor(a / CHUNK).cast("int")
            near = F.array_join(F.slice(chunks, first + 1, F.floor(b / CHUNK).cast("int") - first + 1), "")
            return near.substr(a - first * CHUNK + 1, b - a)

        def over(x: Column) -> Column:
            before = lambda i: F.when(i > 0, x["ends"][F.greatest(i - 1, F.lit(0))]).otherwise(F.lit(0))
            part = lambda s, i: F.when((i == 0) | (s["start"] > before(i)), F.concat(piece(x["chunks"], before(i), s["start"]), F.lit(mask))).otherwise(F.lit(""))
            last = x["ends"][F.size(x["ends"]) - 1]
            return F.concat(F.array_join(F.transform(t["spans"], part), ""), piece(x["chunks"], last, F.length(t["text"])))

        ends = _running(F.transform(t["spans"], lambda s: s["end"]), F.greatest)
        return _bound(F.struct(ends.alias("ends"), F.regexp_extract_all(t["text"], F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)).alias("chunks")), over)

    text = F.when(F.size("spans") > 0, _bound(F.struct(F.col("row.text").alias("text"), "spans"), masked)).otherwise(F.col("row.text"))
    done = found.select("row", text.alias("text"), (F.size("spans") > 0).alias("changed"))
    length = F.when(F.col("changed"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None
    return done.select(*[F.col("text") if c == "text" else length.alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


def _sql_matches(kind: str, order: int, pattern: str, group: int = 0) -> str:
    p = pattern.replace("'", "''")
    return f"SELECT rid, '{kind}' AS kind, {order} AS ord, regexp_extract_all(t, '{p}', 0) AS ms, regexp_extract_all(t, '{p}', {group}) AS vs, string_split_regex(t, '{p}') AS ps FROM d WHERE regexp_matches(t, '{p}')"


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({_sql_matches("assign", 1, ASSIGN, 2)} UNION ALL {_sql_matches("access", 2, ACCESS)} UNION ALL {_sql_matches("hex", 3, HEX)} UNION ALL {_sql_matches("cand", 9, "[A-Za-z0-9+/_=-]{20,}")}),
e AS (SELECT rid, kind, ord, ms, vs, ps, unnest(range(1, len(ms) + 1)) AS i FROM m),
s AS (SELECT rid, kind, ord, vs[i] AS v, length(ms[i]) AS n, list_sum(list_transform(ps[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)::BIGINT AS st FROM e),
base AS (SELECT rid, kind, ord, st, st + n AS en FROM s WHERE kind IN ('access', 'hex') OR (kind = 'assign' AND length(v) >= {LEAST_VALUE})),
c AS (SELECT rid, st, st + n AS en, v,
        CASE WHEN regexp_matches(v, '^[0-9a-fA-F]+$') THEN 'entropy_hex' WHEN regexp_matches(v, '[0-9]') THEN 'entropy_alnum' ELSE 'entropy_mixed' END AS kind
      FROM s WHERE kind = 'cand' AND {" AND ".join(f"NOT regexp_matches(v, '{p}')" for p in ALLOWED)}
        AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = s.rid AND b.st < s.st + s.n AND b.en > s.st)),
b AS (SELECT rid, st, en, kind, list_max(list_transform(range(0, length(v) - {WINDOW - 1}), lambda i: list_entropy(string_split(substr(v, (i + 1)::BIGINT, {WINDOW}), '')))) AS bits FROM c),
added AS (SELECT rid, kind, CASE kind WHEN 'entropy_hex' THEN 4 WHEN 'entropy_mixed' THEN 5 ELSE 6 END AS ord, st, en FROM b
          WHERE bits >= CASE kind {" ".join(f"WHEN '{k}' THEN {v}" for k, v in LEAST_BITS.items())} END),
bs AS (SELECT rid, count(*) FILTER (kind = 'assign') AS na, count(*) FILTER (kind = 'access') AS nc, count(*) FILTER (kind = 'hex') AS nh, string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, ord, en) AS j FROM base GROUP BY rid),
al AS (SELECT rid, string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, ord, en) AS j FROM (SELECT rid, kind, ord, st, en FROM base UNION ALL SELECT rid, kind, ord, st, en FROM added) GROUP BY rid)
SELECT d.doc_id, coalesce(bs.na, 0)::BIGINT AS n_assign, coalesce(bs.nc, 0)::BIGINT AS n_access, coalesce(bs.nh, 0)::BIGINT AS n_hex, sha256(coalesce(bs.j, '')) AS base_sha256, coalesce(al.j, '') AS spans
FROM d LEFT JOIN bs USING (rid) LEFT JOIN al USING (rid)
"""
