"""Personal data: regular expressions propose, checksums confirm, context scores.

Everything is a JVM expression on the rows of one scan: no shuffle, no Python.

Java's split and find walk over a text alike, so the pieces between the matches
and the matches themselves give each match's place: a match ends where the
lengths of all pieces and matches up to it have run. The piece before a match
also holds its context words.

Every pattern is written so that a text is read once: a long run of word
characters is entered only at its start (or at the end of the match before),
where the plain pattern would try every place in it, and groups repeat
possessively, which Java runs as a loop rather than by recursion.

Defined results: a null text is an empty one; very long texts are read whole;
null ids and repeated rows keep one row per input row; of spans that start alike the
kinds' order decides; an empty table gives none; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.shared import running_totals

_LOCAL = "A-Za-z0-9._%+-"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
BASE = ("email", "ip", "card", "phone")
SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def mod97(code: Column) -> Column:
    """The remainder of an IBAN, its first four characters moved to the end, letters read as 10 to 35."""
    plain = F.regexp_replace(code, " ", "")
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    zero = F.lit(0).cast("long")

    def step(rest: Column, c: Column) -> Column:
        n = F.ascii(c)
        return F.when(n < 58, (rest * 10 + n - 48) % 97).otherwise((rest * 100 + n - 55) % 97)

    return F.aggregate(F.split(moved, ""), zero, lambda rest, c: F.when(c == "", rest).otherwise(step(rest, c)))


def _confirm_card(hit: Column) -> Column:
    return F.length(_digits(hit)).between(13, 19) & F.call_function("luhn_check", _digits(hit))


@dataclass(frozen=True)
class Kind:
    """pattern: proposes; needs: a string without which there is no match; confirm: checks a match;
    score: of a confirmed match, near: context words (lower case) that raise it by a quarter."""

    name: str
    pattern: str
    needs: str
    confirm: Callable[[Column], Column]
    score: float
    near: str


KINDS = (
    Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda h: F.lit(True), 0.75, "mail|contact|write|reach"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", ".", lambda h: h.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), 0.6, "ip|host|server|login|address"),
    Kind("card", r"[0-9](?:[ -]?[0-9]){12,}+", "", _confirm_card, 0.75, "card|visa|credit|pay|account"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", lambda h: F.length(_digits(h)).between(9, 15), 0.6, "phone|tel|call|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", lambda h: F.length(F.regexp_replace(h, " ", "")).between(15, 34) & (mod97(h) == 1), 0.75, "iban|bank|account|konto"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", lambda h: ~h.rlike("^(?:000|666|9)|-00-|-0000$"), 0.35, "ssn|social|security|taxpayer"),
)
#: Code points of context on either side, the score from which an added kind counts, what context adds.
CONTEXT, LEAST, NEAR = 48, 0.5, 0.25


def find_pii(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """docs with the column spans: kind, start, end (code points, end exclusive), score; by kind, then start."""
    given = [F.col(f"`{c}`") for c in docs.columns if c != "spans"]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    none = F.array().cast("array<string>")

    def where_possible(kind: Kind, made: Column) -> Column:
        return F.when(whole.contains(kind.needs), made).otherwise(none) if kind.needs else made

    hits = docs.select(*given, *(where_possible(k, F.regexp_extract_all(whole, F.lit(k.pattern), F.lit(0))).alias(f"__hit_{k.name}") for k in kinds))
    cut = hits.select("*", *(F.when(F.size(f"__hit_{k.name}") > 0, F.split(whole, k.pattern, -1)).otherwise(none).alias(f"__cut_{k.name}") for k in kinds))
    ends = cut.select("*", *(running_totals(F.zip_with(f"__cut_{k.name}", f"__hit_{k.name}", lambda p, h: F.length(p).cast("long") + F.coalesce(F.length(h), F.lit(0)))).alias(f"__end_{k.name}") for k in kinds))

    def spans(k: Kind) -> Column:
        hit, cuts = F.col(f"__hit_{k.name}"), F.col(f"__cut_{k.name}")
        rows = F.arrays_zip(hit.alias("hit"), F.slice(F.col(f"__end_{k.name}"), 1, F.size(hit)).alias("end"), F.slice(cuts, 1, F.size(hit)).alias("before"), F.slice(cuts, 2, F.size(hit)).alias("after"))
        good = F.filter(rows, lambda r: k.confirm(r["hit"]))

        def span(r: Column) -> Column:
            near = F.lower(F.concat_ws(" ", F.right(r["before"], F.lit(CONTEXT)), F.left(r["after"], F.lit(CONTEXT)))).rlike(rf"\b(?:{k.near})")
            return F.struct(F.lit(k.name).alias("kind"), (r["end"] - F.length(r["hit"])).alias("start"), r["end"].alias("end"), (F.lit(k.score) + F.when(near, NEAR).otherwise(0.0)).alias("score"))

        found = F.transform(good, span)
        if k.name not in BASE:
            found = F.filter(found, lambda s: s["score"] >= LEAST)
        return F.when(F.size(hit) > 0, found).otherwise(F.array().cast(SPAN))

    kept = [c for c in docs.columns if c != "spans"]
    return ends.select(*(F.col(f"`{c}`") for c in kept), F.concat(*(spans(k) for k in kinds)).cast(SPAN).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each confirmed span's text replaced by [KIND]; of overlapping spans the leftmost, then longest, counts."""
    found = find_pii(docs, text)
    none = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        out = F.concat(acc["out"], F.substring(whole, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct((-s["back"]).alias("at"), out.alias("out")))

    done = F.aggregate(ordered, none, step, lambda acc: F.concat(acc["out"], F.substring(whole, acc["at"].cast("int") + 1, F.lit(2**31 - 1))))
    return found.withColumn("redacted", done)


def pii_digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts and places of what find_pii() found."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return find_pii(docs.select("doc_id", "text")).select(
        "doc_id",
        *map(count, BASE),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("max_score"),
    )
