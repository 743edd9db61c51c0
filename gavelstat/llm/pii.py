"""Personal data in texts, found with SQL functions alone.

Regular expressions propose spans, checks confirm them (digit counts, Luhn, ISO 7064 mod 97, number ranges) and
words shortly before a span raise its score; spans that reach KEEP stay.  The four base kinds start above KEEP,
so that context never removes them; further kinds need a checksum or context.

Patterns are written so that a scan takes linear time: possessive repeats, and no start inside a run that has
already failed.  None can match across a line break.  Positions are running sums of the lengths of the pieces
between matches, taken in blocks of BLOCK, so that texts with very many matches stay affordable.

Defined results: a null text is empty; a text without matches gives zero counts and an empty list; repeated rows
give repeated results; an empty table gives none.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Score from which a span stays.
KEEP = 0.5
#: Code points before a span in which context words count, and what they add.
REACH, BONUS = 40, 0.3
BLOCK = 128


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _between(found: Column, low: int, high: int) -> Column:
    return F.length(_digits(found)).between(low, high)


def luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits has a right check digit."""
    padded = F.lpad(digits, 19, "0")
    total = F.lit(0)
    for i in range(19):
        d = F.substring(padded, i + 1, 1).cast("int")
        total = total + (d if i % 2 == 0 else 2 * d - F.when(d > 4, 9).otherwise(0))
    return total % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number in the international form has right check digits."""
    bare = F.regexp_replace(account, "[^A-Z0-9]", "")
    turned = F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4))

    def step(rest: Column, symbol: Column) -> Column:
        code = F.ascii(symbol)
        return F.when(code >= 65, rest * 100 + code - 55).otherwise(rest * 10 + code - 48) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda r, s: F.when(s == "", r).otherwise(step(r, s))) == 1


def _small_parts(found: Column) -> Column:
    big = lambda part: F.length(F.ltrim(part, F.lit("0"))) > 3
    value = lambda part: F.substring(F.concat(F.lit("000"), part), -3, 3).cast("int") > 255
    return ~F.exists(F.split(found, r"\."), lambda part: big(part) | value(part))


@dataclass(frozen=True)
class Kind:
    name: str
    #: A character that every match has; texts without it aren't searched.
    sign: str
    pattern: str
    valid: object
    score: float
    context: tuple[str, ...]


KINDS = [
    Kind(
        "email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda found: F.lit(True), 0.9, ("mail", "contact"),
    ),
    Kind("ip", ".", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _small_parts, 0.6, ("ip", "host", "server")),
    Kind(
        "card", "", r"[0-9](?:[\x20-]?[0-9])++", lambda found: _between(found, 14, 19) & luhn(_digits(found)),
        0.8, ("card", "visa", "credit"),
    ),
    Kind(
        "phone", "+", r"\+[0-9][\x20().0-9-]+[0-9]", lambda found: _between(found, 10, 15), 0.6,
        ("phone", "call", "tel", "mobile"),
    ),
    Kind(
        "iban", "",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}"
        r"(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}+(?:\x20[A-Z0-9]{1,4})?)(?![A-Za-z0-9])",
        mod97, 0.7, ("iban", "account", "bank"),
    ),
    Kind(
        "tax_id", "-", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda found: F.lit(True), 0.3,
        ("ssn", "social security", "tax"),
    ),
]
BASE = [k.name for k in KINDS[:4]]


def find(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans``: an array of (start, kind number, kind, end, score) in order, code points, end exclusive."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for kind in KINDS:
        rows = _add_spans(rows, kind)
    return rows.select("doc_id", F.array_sort(F.concat(*[F.col(k.name) for k in KINDS])).alias("spans"))


def _add_spans(rows: DataFrame, kind: Kind) -> DataFrame:
    """A column of the kind's valid spans.  Each step is a column of its own, so that none is computed twice."""
    text, pattern = F.col("text"), F.lit(kind.pattern)
    maybe = text.contains(kind.sign) if kind.sign else text.rlike("[0-9]")
    rows = rows.withColumn("_found", F.when(maybe, F.regexp_extract_all(text, pattern, F.lit(0))))
    some = F.size("_found") > 0
    widths = F.transform(F.split(text, kind.pattern, -1), F.length)
    rows = rows.withColumn("_gaps", F.when(some, widths))
    sums = F.zip_with(F.slice("_gaps", 1, F.size("_found")), "_found", lambda gap, found: gap + F.length(found))
    rows = rows.withColumn("_width", F.when(some, sums))
    part = lambda b, n: F.aggregate(F.slice("_width", b * BLOCK + 1, n), F.lit(0), lambda s, x: s + x)
    blocks = F.transform(
        F.sequence(F.lit(0), ((F.size("_width") - 1) / BLOCK).cast("int")), lambda b: part(b, F.lit(BLOCK))
    )
    upto = F.aggregate(blocks, F.array(F.lit(0)), lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + s)))
    rows = rows.withColumn("_upto", F.when(some, upto))

    def span(found: Column, i: Column) -> Column:
        b = (i / BLOCK).cast("int")
        end = F.element_at("_upto", b + 1) + part(b, i % BLOCK + 1)
        start = end - F.length(found)
        near = F.lower(F.substr(text, F.greatest(start - REACH, F.lit(0)) + 1, F.least(start, F.lit(REACH))))
        hint = F.lit(False)
        for word in kind.context:
            hint = hint | near.contains(word)
        score = F.lit(kind.score) + F.when(hint, BONUS).otherwise(0.0)
        return F.struct(
            start.alias("start"), F.lit(KINDS.index(kind)).alias("nth"), F.lit(kind.name).alias("kind"),
            end.alias("end"), F.least(score, F.lit(1.0)).alias("score"), kind.valid(found).alias("valid"),
        )

    judged = F.filter(F.transform("_found", span), lambda s: s["valid"] & (s["score"] >= KEEP))
    bare = F.transform(judged, lambda s: s.dropFields("valid"))
    none = F.array().cast("array<struct<start:int,nth:int,kind:string,end:int,score:double>>")
    return rows.withColumn(kind.name, F.when(some, bare).otherwise(none)).drop("_found", "_gaps", "_width", "_upto")


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def summary(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["nth"] < len(BASE))
    counts = [
        F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")  # noqa: B023  called at once
        for k in BASE
    ]
    return found.select(
        "doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )
