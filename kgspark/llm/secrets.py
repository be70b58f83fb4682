"""Secret scans in column functions only.

Base kinds are regular expressions (leftmost, non-overlapping, failing matches dropped). The method adds candidate
strings whose Shannon entropy, in some window of ``WINDOW`` characters, reaches the limit of their character class.
Entropy comes from incremental counts: a fold over entering and leaving characters updates one count and the running
sum of c*log2(c). Candidates are judged as hex or as mixed text, and need a letter and a digit; a run of letters or of
digits alone is a word or a number. Allow-listed strings are suppressed; base spans stay.

Null and empty texts have no spans. Repeated rows give repeated results, ties of start stand by kind as listed. Offsets
are code points, end exclusive. A very long text is one row and is scanned whole; matches are placed by running sums
and cut out of parts of the text, so time follows the text's length and a little more than its number of matches. An
empty table gives an empty result. Columns that are not named are not read; ``redact`` changes ``text`` alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_text")
BASE = KINDS[:3]
WINDOW = 20
#: Least entropy in bits of the best window, by character class.
LIMITS = {"entropy_hex": 3.05, "entropy_text": 3.85}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Strings that look random and are public.
ALLOW = r"(?i)example|changeme|placeholder|0123456789|abcdefghij|^d41d8cd98f00b204e9800998ecf8427e$|^e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855$"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = (
    "(" + "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|"
    + _either_case("api") + "_?" + _either_case("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: Runs that are too short are dropped anyway, and no later start in such a run is long enough.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
CANDIDATE = "[A-Za-z0-9+/_=-]{%d,}" % WINDOW
_FAST_CANDIDATE = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}+" % WINDOW

SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, both) -> Column:
    """The running ``both`` (an associative function of two columns) of an array, in log2(n) passes of doubling reach."""
    size = F.size(values)
    passes = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(size, F.lit(1)).cast("double"))).cast("int"))

    def step(acc, k):
        reach = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(acc, lambda x, i: F.when(i < reach, x).otherwise(both(F.get(acc, i - reach), x)))

    return F.when(size < 2, values).otherwise(F.aggregate(passes, values, step))


def located(text: Column, pattern: str, kind: Column | None = None) -> Column:
    """All matches of a pattern with their offsets: array of (kind, start, end, value)."""
    kind = F.lit(None).cast("string") if kind is None else kind

    def placed(x):
        found, gaps = x["found"], x["gaps"]
        sizes = F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))
        return F.zip_with(
            running(sizes, lambda a, b: a + b), found,
            lambda end, m: F.struct(kind.alias("kind"), (end - F.length(m)).alias("start"), end.alias("end"), m.alias("value")),
        )

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.struct(found.alias("found"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(text.rlike(pattern), bound(both, placed)).otherwise(F.array().cast(SPAN))


def best_entropy(value: Column) -> Column:
    """The largest entropy, in bits, of any window of WINDOW characters of one candidate."""
    size = F.length(value)
    codes = F.transform(F.split(value, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c))
    events = F.flatten(
        F.transform(
            F.sequence(F.lit(1), size),
            lambda i: F.when(
                i > WINDOW,
                F.array(
                    F.struct((i - WINDOW).alias("i"), F.lit(-1).alias("d")),
                    F.struct(i.alias("i"), F.lit(1).alias("d")),
                ),
            ).otherwise(F.array(F.struct(i.alias("i"), F.lit(1).alias("d")))),
        )
    )
    steps = F.transform(events, lambda e: F.struct(F.element_at(codes, e["i"]).alias("k"), e["d"].alias("d"), (e["i"] >= WINDOW).alias("full")))
    weight = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)))
    bins = len(ALPHABET)

    def step(acc, e):
        now = F.element_at(acc["n"], e["k"])
        total = acc["s"] + F.element_at(weight, now + e["d"] + 1) - F.element_at(weight, now + 1)
        counts = F.concat(
            F.slice(acc["n"], F.lit(1), e["k"] - 1), F.array(now + e["d"]), F.slice(acc["n"], e["k"] + 1, F.lit(bins))
        )
        best = F.when((e["d"] == 1) & e["full"], F.least(acc["least"], total)).otherwise(acc["least"])
        return F.struct(counts.alias("n"), total.alias("s"), best.alias("least"))

    zero = F.struct(F.array_repeat(F.lit(0), bins).alias("n"), F.lit(0.0).alias("s"), F.lit(1e9).alias("least"))
    return F.aggregate(steps, zero, step, lambda acc: F.lit(math.log2(WINDOW)) - acc["least"] / WINDOW)


def entropy_spans(text: Column) -> Column:
    hexes = lambda x: x["value"].rlike("^[0-9a-fA-F]+$")
    mixed = lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]")
    kind = lambda x: F.when(hexes(x), F.lit(KINDS[3])).otherwise(F.lit(KINDS[4]))
    limit = lambda x: F.when(hexes(x), F.lit(LIMITS[KINDS[3]])).otherwise(F.lit(LIMITS[KINDS[4]]))
    candidates = F.filter(located(text, _FAST_CANDIDATE), lambda x: mixed(x) & ~x["value"].rlike(ALLOW))
    return F.transform(
        F.filter(candidates, lambda x: best_entropy(x["value"]) >= limit(x)),
        lambda x: F.struct(kind(x).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")),
    )


def all_spans(text: Column) -> Column:
    """Every span of a text, sorted by start and then by kind as listed."""
    assign = F.filter(
        located(text, ASSIGN, F.lit("assign")), lambda x: F.length(F.regexp_extract(x["value"], ASSIGN, 2)) >= 6
    )
    every = F.concat(assign, located(text, ACCESS, F.lit("access")), located(text, HEX, F.lit("hex")), entropy_spans(text))
    rank = F.array(*map(F.lit, KINDS))
    keyed = F.transform(
        every,
        lambda x: F.struct(
            x["start"].alias("start"), F.array_position(rank, x["kind"]).alias("rank"), x["end"].alias("end"),
            x["kind"].alias("kind"), x["value"].alias("value"),
        ),
    )
    return F.sort_array(keyed)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id and ``found``, the sorted spans with their values."""
    return docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).select(
        id_col, all_spans(F.col("__text")).alias("found")
    )


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        id_col,
        *(count(k) for k in BASE),
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("found", line), ",").alias("spans"),
    )


def _without(text: Column, spans: Column, tag: str) -> Column:
    """The text with the tag for each group of overlapping spans; spans are sorted by start and not empty."""
    reach = running(F.transform(spans, lambda x: x["end"]), F.greatest)
    #: Kept stretches (from, to): before each span that starts where all earlier ones have ended, and behind the last.
    starts = lambda upto: F.transform(spans, lambda x, i: F.struct(F.when(i > 0, F.get(upto, i - 1)).otherwise(F.lit(0)).alias("a"), x["start"].alias("b")))

    def pieces(upto):
        inner = F.filter(starts(upto), lambda s: s["b"] >= s["a"])
        return F.concat(inner, F.array(F.struct(F.element_at(upto, -1).alias("a"), F.length(text).alias("b"))))

    def joined(kept):
        # Blocks of stretches are cut out of the text, and stretches out of their block.
        width = F.ceil(F.sqrt(F.size(kept).cast("double"))).cast("int")

        def block(at):
            rows = F.slice(kept, at + 1, width)
            base = F.element_at(rows, 1)["a"]
            part = F.substring(text, base + 1, F.element_at(rows, -1)["b"] - base)
            return bound(part, lambda p: F.array_join(F.transform(rows, lambda s: F.substring(p, s["a"] - base + 1, s["b"] - s["a"])), tag))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(kept) - 1, width), block), tag)

    return bound(bound(reach, pieces), joined)


def redacted(text: Column) -> Column:
    """The text with each span replaced by ``<SECRET>``; overlapping spans count once, from the first start."""
    return F.when(text.isNull(), text).otherwise(
        bound(all_spans(text), lambda spans: F.when(F.size(spans) == 0, text).otherwise(_without(text, spans, "<SECRET>")))
    )


def redact(docs: DataFrame) -> DataFrame:
    """The documents with secrets taken out of ``text``; all other columns as they were."""
    return docs.withColumn("text", redacted(F.col("text")))


def sql() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (
  SELECT doc_id, 'assign' AS kind, 0 AS rank, string_split_regex(t, {quoted(ASSIGN)}) AS g, regexp_extract_all(t, {quoted(ASSIGN)}) AS m FROM d
  UNION ALL SELECT doc_id, 'access', 1, string_split_regex(t, {quoted(ACCESS)}), regexp_extract_all(t, {quoted(ACCESS)}) FROM d
  UNION ALL SELECT doc_id, 'hex', 2, string_split_regex(t, {quoted(HEX)}), regexp_extract_all(t, {quoted(HEX)}) FROM d
  UNION ALL SELECT doc_id, 'candidate', 3, string_split_regex(t, {quoted(CANDIDATE)}), regexp_extract_all(t, {quoted(CANDIDATE)}) FROM d),
i AS (SELECT doc_id, kind, rank, g, m, unnest(range(1, len(m) + 1)) AS i FROM f WHERE len(m) > 0),
s AS (SELECT doc_id, kind, rank, m[i] AS v,
  (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a FROM i),
e AS (SELECT *, CASE WHEN regexp_full_match(v, '[0-9a-fA-F]+') THEN 'entropy_hex' ELSE 'entropy_text' END AS ek,
  list_max(list_transform(range(1, length(v) - {WINDOW - 2}), lambda k: list_aggregate(string_split(substr(v, k, {WINDOW}), ''), 'entropy'))) AS h
  FROM s WHERE kind = 'candidate' AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND NOT regexp_matches(v, {quoted(ALLOW)})),
k AS (
  SELECT doc_id, kind, rank, a, a + length(v) AS b FROM s WHERE kind IN ('access', 'hex') OR (kind = 'assign' AND length(regexp_extract(v, {quoted(ASSIGN)}, 2)) >= 6)
  UNION ALL SELECT doc_id, ek, CASE ek WHEN 'entropy_hex' THEN 3 ELSE 4 END, a, a + length(v) FROM e
    WHERE h >= CASE ek WHEN 'entropy_hex' THEN {LIMITS["entropy_hex"]} ELSE {LIMITS["entropy_text"]} END),
o AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) AS spans FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN o USING (doc_id)
"""
