"""Personal data by regular expressions, checksums and context, in column expressions only.

A pattern's matches and the gaps between them (``split`` by the same pattern) alternate, so
summing lengths gives every match its place in code points. Kinds are worked off one after
the other; only short spans leave the text.

Base kinds (e-mail, IP address, card, phone) are taken as found, when their check holds.
Added kinds carry a score: what the pattern alone is worth, more for a checksum that holds
(mod 97), more for a word of its context close by. Spans that reach ``ACCEPT`` stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"

#: Characters of an account number by country, from the public registry and its list of countries in part.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """Account numbers: of a known country as long as its numbers are, so that the next word stays outside; of another one as long as it goes, but not into one of a known country."""
    known = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")
    exact = [rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items()]
    other = rf"(?!{known})[A-Z]{{2}}[0-9]{{2}}(?:\x20(?!(?:{known})[0-9]{{2}})[A-Z0-9]|[A-Z0-9]){{11,30}}+"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join([*exact, other])})(?![A-Za-z0-9])"


#: Patterns proposing spans. Guards let a match start only where a run of its first
#: characters starts (or where the last match ended), and possessive repeats never look
#: back, so a text is read once whatever it holds.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Added kinds: pattern, words of its context, score of the pattern alone.
ADDED = {
    "iban": (_iban(), r"iban|bank|account|konto|compte|cuenta", 0.2),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"ssn|social security|sozialversicherung", 0.4),
    "local_phone": (r"(?<![0-9+.(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", r"phone|tel|call|mobile|telefon|téléphone|fax", 0.4),
}
KINDS = (*BASE, *ADDED)
CHECKSUM = 0.5
CONTEXT = 0.3
ACCEPT = 0.6
#: Code points before and after a span that count as its context.
NEAR = 40
#: Capitals of the letters that context words are written in (the last is the kelvin sign), and their small letters.
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\u00c9\u212a"
SMALL = "abcdefghijklmnopqrstuvwxyz\u00e9k"
#: Cheap test that a text can hold a kind at all.
NEEDS = {"email": "@", "phone": "+"}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    places = F.sequence(F.lit(1), F.length(digits))
    from_right = F.transform(places, lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int"))
    doubled = F.transform(from_right, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number, its first four characters moved to the end and letters read as 10 to 35, leaves 1 of 97."""
    moved = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))
    values = F.transform(
        F.filter(F.split(moved, ""), lambda c: c != ""),
        lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55),
    )
    return F.aggregate(values, F.lit(0), lambda a, v: F.when(v > 9, (a * 100 + v) % 97).otherwise((a * 10 + v) % 97)) == 1


def _part_fits(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))


def _valid(kind: str, value: Column) -> Column:
    if kind == "email" or kind in ADDED:
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), _part_fits)
    n = F.length(_digits(value))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(_digits(value))).otherwise(False)
    return n.between(9, 15)


def _matches(text: Column, kind: str, pattern: str) -> tuple[Column, Column]:
    there = text.contains(NEEDS[kind]) if kind in NEEDS else text.rlike("[0-9]")
    none = F.array().cast("array<string>")
    found = F.when(there, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
    gaps = F.when(F.size("__found") > 0, F.split(text, pattern, -1)).otherwise(none)
    return found, gaps


def _spans(kind: str) -> Column:
    """Spans of the matches in ``__found`` whose check holds, placed by the gaps before them.

    One walk over the matches; only spans that stay are gathered, so numbers without end in
    a text cost one step each.
    """
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("kept"))
    steps = F.arrays_zip(F.col("__found").alias("hit"), F.slice("__gaps", 1, F.size("__found")).alias("gap"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), x["hit"].alias("value"))
        kept = F.when(_valid(kind, x["hit"]), F.concat(state["kept"], F.array(span))).otherwise(state["kept"])
        return F.struct(end.alias("at"), kept.alias("kept"))

    return F.aggregate(steps, start, step, lambda s: s["kept"])


def _small(text: Column) -> Column:
    """As ``lower``, as far as context words can tell: a dotted capital I becomes two characters, other letters stay letters.

    Not ``lower`` and ``upper``: the first use in an executor fills tables for all of Unicode,
    gigabytes of garbage that leave its heap hundreds of megabytes larger.
    """
    return F.translate(F.replace(text, F.lit("\u0130"), F.lit("i\u0307")), CAPITALS, SMALL)


def _scored(kind: str, text: Column, span: Column) -> Column:
    _, words, alone = ADDED[kind]
    near = _small(F.substring(text, F.greatest(span["start"] - NEAR, F.lit(0)) + 1, span["end"] - span["start"] + 2 * NEAR))
    close = F.when(near.rlike(rf"(?<!\p{{L}})(?:{words})(?!\p{{L}})"), CONTEXT).otherwise(0.0)
    proven = F.when(mod97(F.regexp_replace(span["value"], " ", "")), CHECKSUM).otherwise(0.0) if kind == "iban" else F.lit(0.0)
    return F.lit(alone) + close + proven


def _taken() -> Column:
    """Base spans, all of which are taken."""
    return F.transform("__spans", lambda s: _span(s, F.lit(1.0)))


def _accepted(kind: str) -> Column:
    """Added spans that score enough."""
    scored = F.transform("__spans", lambda s: _span(s, _scored(kind, F.col("__text"), s)))
    return F.filter(scored, lambda s: s["score"] >= ACCEPT)


def _span(s: Column, score: Column) -> Column:
    return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score"))


def find_spans(docs: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """``docs`` plus an array of spans (kind, start, end, score), ordered by kind as listed in ``KINDS``, then start.

    Places are code points, end exclusive. Null and empty texts have no spans.
    """
    names = [f"__s_{kind}" for kind in KINDS]
    out = docs.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    for kind, name in zip(KINDS, names, strict=True):
        pattern = BASE[kind] if kind in BASE else ADDED[kind][0]
        found, gaps = _matches(F.col("__text"), kind, pattern)
        out = out.withColumn("__found", found).withColumn("__gaps", gaps).withColumn("__spans", _spans(kind))
        spans = _taken() if kind in BASE else _accepted(kind)
        out = out.withColumn(name, spans.cast(SPAN)).drop("__found", "__gaps", "__spans")
    return out.withColumn(into, F.concat(*names)).drop("__text", *names)


def written(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(kind: str) -> Column:
    return F.filter("spans", lambda s: s["kind"] == kind)


def is_base(span: Column) -> Column:
    return span["kind"].isin(*BASE)


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, a count per base kind, base_sha256 of the base spans, all spans as text."""
    found = find_spans(docs.select("doc_id", "text")).drop("text")
    base = F.filter("spans", is_base)
    counts = [F.size(_of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; n_chars follows the new text, null texts stay null.

    Of overlapping spans the earlier, then the longer one decides; what the other one adds
    beyond it goes too.
    """
    columns = docs.columns
    found = find_spans(docs, into="__all")
    ordered = F.array_sort(
        F.transform("__all", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind")))
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, s: Column) -> Column:
        end = F.greatest(state["at"], -s["back"])
        before = F.substring(F.col("text"), state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        mark = F.when(s["start"] >= state["at"], F.concat(before, F.lit("["), F.translate(s["kind"], SMALL, CAPITALS), F.lit("]"))).otherwise("")
        return F.struct(end.alias("at"), F.concat(state["parts"], F.array(mark)).alias("parts"))

    def finish(state: Column) -> Column:
        rest = F.substring(F.col("text"), state["at"] + 1, F.length(F.col("text")))
        return F.concat(F.array_join(state["parts"], ""), rest)

    clean = F.when(F.size("__all") == 0, F.col("text")).otherwise(F.aggregate(ordered, start, step, finish))
    found = found.withColumn("__clean", clean).withColumn("text", F.col("__clean"))
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        found = found.withColumn("n_chars", F.when(F.size("__all") == 0, F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return found.select(*[f"`{c}`" for c in columns])
