"""Personal data in whole texts, by DataFrame functions alone.

A regular expression per kind proposes spans, leftmost and not overlapping; validators confirm them (Luhn for cards,
mod 97 for IBANs, ranges of the parts and digit counts for addresses and phones); words nearby raise or lower the
score. Positions come from the lengths of the matches and of the gaps between them, in code points, end exclusive.
Running sums go over blocks of BLOCK spans, so that time follows the text and its spans and not their square.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPANS = "array<struct<s:int,e:int,m:string,near:string>>"
#: Code points before a span, back to the one before it of its kind at most, in which context words count.
CONTEXT = 48
#: Score from which spans of the kinds that a contract doesn't fix count.
LEAST = 0.5
BLOCK = 64


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """Whether the digits of text pass the Luhn check."""
    values = F.transform(
        F.filter(F.split(F.reverse(_digits(text)), ""), lambda c: c != ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int")),
    )
    return F.aggregate(values, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether an IBAN's check digits hold: the first four characters to the end, A as 10 and so on, remainder 1."""
    bare = F.regexp_replace(text, "[^A-Z0-9]", "")
    turned = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))
    letters = F.filter(F.split(turned, ""), lambda c: c != "")
    value = lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    return F.aggregate(letters, F.lit(0), lambda a, c: (F.when(F.ascii(c) >= 65, a * 100).otherwise(a * 10) + value(c)) % 97) == 1


def _octets(text: Column) -> Column:
    return F.forall(F.split(text, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _phone(text: Column) -> Column:
    return F.length(_digits(text)).between(10, 15)


def _mixed(text: Column) -> Column:
    """Letters and digits, no word and no number."""
    return text.rlike("[A-Za-z]") & text.rlike("[0-9]")


def _any(text: Column) -> Column:
    return F.lit(True)


@dataclass(frozen=True)
class Kind:
    """A kind of span: hint is a cheaper pattern that every text with a match fits; the order breaks ties of start.
    What lead matches at the beginning of a match is no part of the span."""

    name: str
    order: int
    hint: str
    pattern: str
    valid: Callable[[Column], Column]
    score: float
    context: str
    base: bool = True
    lead: str = ""


_NAMED = r"(?i)(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|auth)[\"'\x20]{0,3}[=:][\x20]{0,2}[\"']?"
#: email and card are the contract's patterns, written so that a failed start is not tried again inside the same
#: run of characters; what they match (cards: with 14 to 19 digits) is the same.
KINDS = (
    Kind("email", 0, "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", _any, 0.9, r"mail|contact|write|@"),
    Kind("ip", 1, r"[0-9]\.[0-9]", r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _octets, 0.7, r"\bip\b|address|server|host|login"),
    Kind(
        "card", 2, r"[0-9][\x20-]?[0-9]", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
        luhn, 0.8, r"card|visa|credit|debit|pay",
    ),
    Kind("phone", 3, r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", _phone, 0.7, r"phone|tel|call|mobile|fax|whatsapp"),
    Kind(
        "iban", 4, r"[A-Z]{2}[0-9]{2}",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        mod97, 0.6, r"iban|account|bank|transfer", False,
    ),
    Kind(
        "key", 5, r"AKIA|gh[oprsu]_|xox[abprs]-|eyJ|PRIVATE KEY",
        r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![0-9A-Z])|gh[oprsu]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+"
        r"|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)|-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----",
        _any, 0.9, r"key|token|secret", False,
    ),
    Kind("secret", 6, _NAMED, _NAMED + r"[A-Za-z0-9+/_.~-]{16,}+", _mixed, 0.6, r"key|token|secret|login|password", False, "^" + _NAMED),
)
#: Words that speak against personal data.
AGAINST = r"\b(?:example|test|dummy|sample|version)\b(?![.-])"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _blocks(values: Column) -> Column:
    """An array cut into arrays of BLOCK."""

    def cut(some: Column) -> Column:
        n = F.ceil(F.size(some) / BLOCK).cast("int")
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.slice(some, i * BLOCK + 1, BLOCK))

    return _let(values, cut)


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """The sums (under join) of each int of an array and all before it: within blocks first, then over their ends."""

    def plain(some: Column) -> Column:
        begin = F.array().cast("array<int>")
        return F.aggregate(some, begin, lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x).otherwise(join(F.element_at(acc, -1), x)))))

    def joined(inner: Column) -> Column:
        ends = plain(F.transform(inner, lambda b: F.element_at(b, -1)))
        moved = lambda t: F.transform(inner, lambda b, i: F.when(i == 0, b).otherwise(F.transform(b, lambda x: join(F.get(t, i - 1), x))))
        return _let(ends, lambda t: F.flatten(moved(t)))

    return _let(F.transform(_blocks(values), plain), joined)


def _add(a: Column, b: Column) -> Column:
    return a + b


def _spans(text: Column, kind: Kind) -> Column:
    """s, e, m (the match) and near (the text before it) of the valid spans."""
    none = F.array().cast(_SPANS)
    matches, gaps = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), F.split(text, kind.pattern, -1)
    # the gap after the last match is nobody's: zip only as many as there are matches
    pieces = F.transform(matches, lambda m, i: F.struct(m.alias("m"), i.alias("i")))

    def placed(both: Column) -> Column:
        sizes = F.transform(both["p"], lambda x: F.length(F.get(both["g"], x["i"])) + F.length(x["m"]))

        def span(x: Column, end: Column) -> Column:
            value = F.regexp_replace(x["m"], kind.lead, "") if kind.lead else x["m"]
            near = F.lower(F.right(F.get(both["g"], x["i"]), F.lit(CONTEXT)))
            return F.struct((end - F.length(value)).alias("s"), end.alias("e"), value.alias("m"), near.alias("near"))

        return _let(_running(sizes, _add), lambda ends: F.transform(both["p"], lambda x: span(x, F.get(ends, x["i"]))))

    found = _let(F.struct(pieces.alias("p"), gaps.alias("g")), lambda both: F.when(F.size(both["p"]) > 0, placed(both)).otherwise(none))
    return F.when(text.rlike(kind.hint), F.filter(found, lambda x: kind.valid(x["m"]))).otherwise(none)


def _scored(spans: Column, kind: Kind) -> Column:
    def one(x: Column) -> Column:
        more, less = F.when(x["near"].rlike(kind.context), 0.1).otherwise(0.0), F.when(x["near"].rlike(AGAINST), 0.2).otherwise(0.0)
        return F.struct(
            x["s"].alias("start"), F.lit(kind.order).alias("order"), x["e"].alias("end"), F.lit(kind.name).alias("kind"), F.lit(kind.base).alias("base"),
            F.round(F.lit(kind.score) + more - less, 6).alias("score"),
        )

    return F.transform(spans, one)


def _with_found(docs: DataFrame, kinds: tuple[Kind, ...]) -> DataFrame:
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    rows = rows.select("doc_id", "_text", *[_spans(F.col("_text"), k).alias(f"_{k.name}") for k in kinds])
    return rows.select("doc_id", "_text", F.array_sort(F.concat(*[_scored(F.col(f"_{k.name}"), k) for k in kinds])).alias("found"))


def find(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """doc_id and found, the array of (start, order, end, kind, base, score) by start, then kind, of every row.

    Null and empty texts have no spans; repeated rows give repeated results; an empty table gives no rows; other
    columns are ignored. Nothing is shuffled.
    """
    return _with_found(docs, kinds).select("doc_id", "found")


def redact(docs: DataFrame, least: float = LEAST, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """doc_id, text with each span of a score of at least least replaced by its kind in brackets, n_redacted.

    Spans that overlap are replaced as one, by the kind of the one that starts first. A null text comes back empty;
    repeated rows give repeated results; an empty table gives no rows; other columns are ignored.
    """
    rows = _with_found(docs, kinds).select("doc_id", "_text", F.filter("found", lambda x: x["score"] >= least).alias("found"))
    reach = _running(F.transform("found", lambda x: x["end"]), F.greatest).alias("reach")
    rows = rows.select("doc_id", "_text", "found", reach)
    first = F.filter(
        F.transform("found", lambda x, i: F.struct(x["start"].alias("s"), x["kind"].alias("k"), i.alias("i"))),
        lambda x: (x["i"] == 0) | (x["s"] >= F.get(F.col("reach"), x["i"] - 1)),
    )
    rows = rows.select("doc_id", "_text", "reach", first.alias("first"))
    ends = F.transform("first", lambda x, k: F.get(F.col("reach"), F.coalesce(F.get(F.col("first"), k + 1)["i"], F.size("reach")) - 1))
    rows = rows.select("doc_id", "_text", F.zip_with("first", ends, lambda x, e: F.struct(x["s"].alias("s"), x["k"].alias("k"), e.alias("e"))).alias("cuts"))
    rows = rows.select("doc_id", "_text", F.size("cuts").alias("n"), F.try_element_at("cuts", F.lit(-1))["e"].alias("last"), _blocks(F.col("cuts")).alias("blocks"))
    begins = F.transform("blocks", lambda b, i: F.when(i == 0, F.lit(0)).otherwise(F.element_at(F.get(F.col("blocks"), i - 1), -1)["e"]))

    def block(b: Column, at: Column) -> Column:
        part = F.substring(F.col("_text"), at + 1, F.element_at(b, -1)["e"] - at)

        def gap(p: Column, x: Column, k: Column) -> Column:
            start = F.when(k == 0, at).otherwise(F.get(b, k - 1)["e"])
            return F.concat(F.substring(p, start - at + 1, x["s"] - start), F.lit("["), x["k"], F.lit("]"))

        return _let(part, lambda p: F.array_join(F.transform(b, lambda x, k: gap(p, x, k)), ""))

    text = F.concat(F.array_join(F.zip_with("blocks", begins, block), ""), F.substr(F.col("_text"), F.coalesce("last", F.lit(0)) + 1))
    return rows.select("doc_id", text.alias("text"), F.col("n").alias("n_redacted"))


def digest(found: DataFrame, least: float = LEAST) -> DataFrame:
    """The columns of the contract from find()'s result: base spans all, those of other kinds if they score least."""
    named = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    text = lambda spans: F.array_join(F.transform(spans, named), ",")
    count = lambda name: F.size(F.filter("found", lambda x: x["kind"] == name)).cast("long").alias(f"n_{name}")
    counted = [count(k.name) for k in KINDS if k.base]
    base = F.sha2(text(F.filter("found", lambda x: x["base"])).cast("binary"), 256)
    every = text(F.filter("found", lambda x: x["base"] | (x["score"] >= least)))
    return found.select("doc_id", *counted, base.alias("base_sha256"), every.alias("spans"))
