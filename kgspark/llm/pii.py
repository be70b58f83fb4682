"""Personal data by anchor expansion.

An Aho-Corasick automaton finds at-signs, schemes, digits, plus signs and identifier cues in one pass over the whole
text; a small deterministic parser then expands each anchor to its boundaries and validates it.

Kinds and their rules, in rank order:
  email, ip, card, phone   the base kinds: leftmost, non-overlapping within a kind, failing matches dropped
  account                  IBAN (mod 97) or an identifier of 7 to 30 digits and dashes after an account cue
  address                  web address with credentials, or a house number (1 to 5 digits) beside a street cue, with up
                           to three names of 30 letters at most between
Null and empty texts have no spans. Repeated rows give repeated results, ties of start stand by kind as listed. Very
long texts are read whole, one at a time. An empty table gives an empty result; columns other than the id and the text
are not read. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone", "account", "address")
BASE = KINDS[:4]
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "cuenta", "compte", "passport", "ssn")
STREET_CUES = ("street", "avenue", "road", "straße", "strasse", "rue", "calle")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[\x20:=#.]{0,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{1,4}){3,8})(?![A-Za-z0-9])")
_IDENT = re.compile(r"(?:\x20?(?:number|no|nr))?[\x20:=#.]{1,4}([A-Za-z]{0,3}[0-9][0-9-]{5,28}[0-9])(?![A-Za-z0-9])", re.I)
_USERINFO = re.compile(r"[^\s/@:]+:[^\s/@]+@[A-Za-z0-9.-]+(?::[0-9]+)?")
_NUMBER_AFTER = re.compile(r"(?:\x20[^\W\d_]{1,30}){0,3}\x20([0-9]{1,5}[a-z]?)(?!\w)")
_NUMBER_BEFORE = re.compile(r"(?<!\w)([0-9]{1,5}[a-z]?)(?:\x20[^\W\d_]{1,30}){0,3}\x20?[^\W\d_]{0,30}$")
#: The longest that _NUMBER_BEFORE can match.
_BEFORE = 6 + 3 * 31 + 1 + 30


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _iban(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    a.add_word("://", ("scheme", 3))
    for kind, cues in (("account", ACCOUNT_CUES), ("street", STREET_CUES)):
        for cue in cues:
            for form in {cue, cue.capitalize(), cue.upper()}:
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def find(text: str, anchors) -> list[tuple[int, int, int]]:
    """Spans (start, rank of kind, end) of one text, sorted."""
    out: list[tuple[int, int, int]] = []
    done = [0] * len(KINDS)
    last = -2
    for end, (kind, size) in anchors.iter(text):
        at = end - size + 1
        if kind == "digit":
            run_starts, last = last != at - 1, at
            if not run_starts:
                continue
            if at >= done[1] and (m := _IP.match(text, at)):
                done[1] = m.end()
                if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.groups())):
                    out.append((at, 1, m.end()))
            if at >= done[2] and (m := _CARD.match(text, at)):
                done[2] = m.end()
                if m.end() - at <= 38:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        out.append((at, 2, m.end()))
        elif kind == "at":
            if m := _DOMAIN.match(text, at + 1):
                start = at
                while start > done[0] and text[start - 1] in LOCAL:
                    start -= 1
                if start < at:
                    done[0] = m.end()
                    out.append((start, 0, m.end()))
        elif kind == "plus":
            if m := _PHONE.match(text, at):
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append((at, 3, m.end()))
        elif kind == "scheme":
            start = at
            while start > done[5] and text[start - 1].isalpha() and text[start - 1].isascii():
                start -= 1
            if start < at and start >= done[5] and (m := _USERINFO.match(text, at + 3)):
                done[5] = m.end()
                out.append((start, 5, m.end()))
        elif (at and text[at - 1].isalpha()) or at < done[4 if kind == "account" else 5]:
            continue
        elif kind == "account":
            m = _IBAN.match(text, end + 1)
            if not (m and _iban(m[1])):
                m = _IDENT.match(text, end + 1)
            if m:
                done[4] = m.end(1)
                out.append((m.start(1), 4, m.end(1)))
        elif m := _NUMBER_AFTER.match(text, end + 1):
            done[5] = m.end(1)
            out.append((at, 5, m.end(1)))
        elif m := _NUMBER_BEFORE.search(text, max(done[5], at - _BEFORE), at):
            done[5] = end + 1
            out.append((m.start(1), 5, end + 1))
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: the id and its spans as parallel arrays ``kind``, ``start``, ``end``."""
    from kgspark.llm._common import map_columns

    def make():
        anchors = automaton()

        def f(ids, texts):
            found = [find(t or "", anchors) for t in texts]
            return (
                ids,
                [[KINDS[k] for _, k, _ in x] for x in found],
                [[s for s, _, _ in x] for x in found],
                [[e for _, _, e in x] for x in found],
            )

        return f

    return map_columns(docs, [id_col, text_col], f"{id_col} long, kind array<string>, start array<int>, end array<int>", make)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind's tag; overlapping spans take the earliest, longest first."""
    out, at = [], 0
    for s, k, e in sorted(spans, key=lambda x: (x[0], -x[2], x[1])):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k]}>"]
            at = e
    return "".join([*out, text[at:]])


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of ``detect``'s rows, by column functions."""
    from pyspark.sql import functions as F

    every = F.arrays_zip("kind", "start", "end")
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter(every, lambda x: x["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("kind", lambda x: x == k)).cast("long").alias(f"n_{k}")
    return found.select(
        id_col,
        *(count(k) for k in BASE),
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(every, line), ",").alias("spans"),
    )


def brute(text: str) -> tuple[dict[str, list[tuple[int, int]]], str]:
    """The base kinds by plain regular expressions, for tests."""
    text = text or ""
    got = {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15],
    }
    spans = sorted((s, BASE.index(k), e) for k, v in got.items() for s, e in v)
    return got, hashlib.sha256(joined(spans).encode()).hexdigest()
