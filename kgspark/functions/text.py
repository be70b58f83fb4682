"""Text column functions: keys, normal forms, escapes, renderings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(c) -> Column:
    """White space of any kind off both ends (``trim`` takes blanks only)."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def relation_key(c) -> Column:
    """Lookup key of a relation label: lower case, spaces and underscores to hyphens, no hyphens at the ends."""
    low = F.lower(strip(F.coalesce(_c(c), F.lit(""))))
    return F.regexp_replace(F.regexp_replace(low, r"(?U)[\s_]+", "-"), "^-+|-+$", "")


def label_norm(c) -> Column:
    """Knowledge-base form: lower case; spaces, underscores, hyphens and middle dots to one blank."""
    return F.regexp_replace(F.lower(strip(_c(c))), r"(?U)[\s_\-·]+", " ")


def search_norm(c) -> Column:
    """Retrieval form: lower case; spaces, underscores, hyphens and parentheses to one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(_c(c)), r"(?U)[\s_\-()]+", " "))


def entity_norm(c) -> Column:
    """Entity form: lower case without separators and punctuation."""
    return F.regexp_replace(F.lower(_c(c)), r"(?U)[\s_\-·.,()]", "")


def lower_trim(c) -> Column:
    return F.lower(strip(_c(c)))


def connect_norm(c) -> Column:
    """Form for matching values to literal nodes: lower case, parentheses dropped, one blank for spaces."""
    return F.lower(strip(F.regexp_replace(F.regexp_replace(_c(c), r"[()（）]", ""), r"(?U)\s+", " ")))


def by_kind(label, kind) -> Column:
    """Display form: runs of white space are one blank; every word of a Class starts upper-case, an Instance's first
    letter is upper-case, a Literal loses its quotes. A word starts at a Latin letter, digit or underscore that none of
    these precedes."""
    label, kind = F.regexp_replace(strip(label), r"(?U)\s+", " "), _c(kind)
    first = F.concat(F.upper(F.substring(label, 1, 1)), F.substr(label, F.lit(2)))
    pieces = F.split(label, r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])")
    words = F.array_join(F.transform(pieces, lambda w: F.when(w.rlike("^[a-z]"), F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))).otherwise(w)), "")
    return F.when(kind == "Class", words).when(kind == "Instance", first).when(kind == "Literal", F.regexp_replace(label, "^[\"']|[\"']$", "")).otherwise(label)


def similarity(a, b) -> Column:
    """One less the edit distance over the longer length; equal texts have 1."""
    a, b = _c(a), _c(b)
    return F.when(a == b, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def grams(c, sizes=(2, 3)) -> Column:
    """Character n-grams of the text between blanks, repeats kept."""
    padded = F.concat(F.lit(" "), _c(c), F.lit(" "))

    def of(n: int) -> Column:
        last = F.length(padded) - (n - 1)
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(padded, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.concat(*map(of, sizes))


def language(c) -> Column:
    return F.when(_c(c).rlike("[가-힣]"), F.lit("ko")).otherwise(F.lit("en"))


def iri_local(c) -> Column:
    """Percent-encoded local name: blanks to underscores, all but letters, digits and ``-_.~`` encoded."""
    return F.replace(F.replace(F.url_encode(F.replace(_c(c), F.lit(" "), F.lit("_"))), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def iri_tail(c) -> Column:
    c = _c(c)
    return F.when(F.contains(c, F.lit("#")), F.substring_index(c, "#", -1)).otherwise(F.substring_index(c, "/", -1))


def local_name(c) -> Column:
    """A Turtle-safe name: other characters to underscores, runs and ends of underscores removed, never empty."""
    # One expression within the other: a repeated one would be computed again in each branch.
    s = F.btrim(F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"(?U)(?:[^\w가-힣]|_)+", "_"), F.lit("_"))
    return F.regexp_replace(F.regexp_replace(s, "^$", "unnamed"), "^([0-9])", "_$1")


def escaped(c, pairs) -> Column:
    return reduce(lambda s, p: F.replace(s, F.lit(p[0]), F.lit(p[1])), pairs, F.coalesce(_c(c), F.lit("")))


def turtle_escape(c) -> Column:
    return escaped(c, (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")))


def xml_escape(c) -> Column:
    return escaped(c, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")))


def cypher_escape(c) -> Column:
    return escaped(c, (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n")))


def mermaid_escape(c) -> Column:
    return escaped(c, (('"', "'"), ("[", "("), ("]", ")"), ("\n", " ")))


def tokens(c) -> Column:
    return F.filter(F.split(_c(c), r"(?U)[\s_\-]+"), lambda w: F.length(w) >= 2)


def words(c) -> Column:
    return F.filter(F.split(strip(_c(c)), r"(?U)\s+"), lambda w: w != "")


def statement(subject, predicate, obj) -> Column:
    return F.concat(_c(subject), F.lit(" —"), _c(predicate), F.lit("→ "), _c(obj))


def json_block(c) -> Column:
    """The outermost braces or brackets in a model's answer; null if there are none."""
    c = _c(c)
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    c = F.when(fenced != "", fenced).otherwise(c)
    braces, brackets = F.regexp_extract(c, r"(?s)\{.*\}", 0), F.regexp_extract(c, r"(?s)\[.*\]", 0)
    return F.when(braces != "", braces).when(brackets != "", brackets)


def option(c, listed) -> Column:
    """A choice as a number within 0..size(listed), or as a listed id; null for anything else."""
    c, listed = strip(_c(c)), _c(listed)
    number = F.when(c.rlike("^[0-9]{1,9}$"), c.cast("int"))
    place = F.array_position(listed, c).cast("int")
    return F.when(number <= F.size(listed), number).when(number.isNull() & (place > 0), place)


def polynomial_hash(c) -> Column:
    """h * 31 + code, modulo 2**32, over the characters."""
    return F.aggregate(F.split(_c(c), ""), F.lit(0).cast("long"), lambda h, x: F.when(x == "", h).otherwise((h * 31 + F.ascii(x)) % (2**32)))
