"""License scans: Dice coefficient of word bigrams against templates, in column expressions only.

Every line of a text, and the text as a whole, is a unit. It is lower-cased and cut into
words; the set of its word bigrams is compared with each template's. For a coefficient of
``LEAST`` or more, set sizes can differ by no more than a fixed factor, so a unit meets only
the templates of fitting size, and most units meet none.

Passages, runs of words wherever lines break, are units too: for each template, those that
start and end with a bigram of it and span up to 1, 1.25 or 1.5 times its words. They find
notices wrapped over lines and notices inside a line. Only texts with a word that no find can
do without are searched for them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least Dice coefficient of a find.
LEAST = 0.7

# Customary notices and texts of public licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the Software), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions"
    ),
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Released into the public domain under CC0 1.0.",
}


def words_of(text: str) -> list[str]:
    """Words as the column expression cuts them: runs of ASCII letters and digits, lower case."""
    return re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def bigrams_of(text: str) -> list[str]:
    words = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _pairs(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>"))


def size_bounds(n: int, least: float = LEAST) -> tuple[int, int]:
    """Fewest and most bigrams a unit can have next to ``n`` of a template: 2 min / (a + b) must reach ``least``."""
    factor = least / (2 - least)
    return int(-(-n * factor // 1)), int(n / factor)


def _telling(text: str, least: float) -> set[str]:
    """Words, the longest first, of which a unit like the template has one: too many of its bigrams hold them for all to be missing."""
    grams, found = bigrams_of(text), set()
    missing = len(grams) - size_bounds(len(grams), least)[0]
    for word in sorted(set(words_of(text)), key=lambda w: (-len(w), w)):
        if sum(not found.isdisjoint(g.split(" ")) for g in grams) > missing:
            break
        found.add(word)
    return found


def _quoted(name: str) -> str:
    return name.replace("\\", "\\\\").replace("'", "\\'")


def _passages(order: int, name: str, text: str, own: str, least: float) -> Column:
    """Passages like a template, from the places ``own`` of its bigrams among the text's ``__pairs``."""
    n = len(bigrams_of(text))
    need, most = size_bounds(n, least)
    spans = sorted({int(len(words_of(text)) * x + 0.5) - 1 for x in (1, 1.25, 1.5)})
    # As many bigrams as a find needs must be near. A passage ends with the last bigram of the template in its span.
    near = f"get({own}, j + {max(need, 1) - 1}).at < p.at + {spans[-1]}"
    within = f"transform(array({', '.join(map(str, spans))}), s -> filter(slice({own}, j + 1, s), y -> y.at < p.at + s))"
    common = f"transform({within}, w -> named_struct('n', element_at(w, -1).at - p.at + 1, 'common', size(array_distinct(w.pair))))"
    sized = f"transform({common}, z -> named_struct('at', p.at, 'n', z.n, 'common', z.common, 'unit', size(array_distinct(slice(__pairs, p.at, z.n)))))"
    each = f"flatten(filter(transform({own}, (p, j) -> CASE WHEN {near} THEN {sized} END), x -> x IS NOT NULL))"
    dice = f"CASE WHEN z.unit BETWEEN {need} AND {most} THEN 2.0D * z.common / (z.unit + {n}) ELSE 0.0D END"
    judged = f"named_struct('common', z.common, 'dice', {dice}, 'order', {-order}, 'back', -z.at, 'last', z.at + z.n, 'name', '{_quoted(name)}')"
    return F.expr(f"filter(transform({each}, z -> {judged}), x -> x.dice >= {least!r}D)")


def _listed(grams: list[str]) -> str:
    """Bigrams (letters, digits and a space) as SQL literals; one column for each would take long to build."""
    return ", ".join(f"'{g}'" for g in grams)


def _places_in(grams: list[str]) -> Column:
    return F.expr(f"filter(__places, x -> x.pair IN ({_listed(grams)}))")


def _apart(passages: Column) -> Column:
    """Of passages that overlap, the one with most bigrams in common; then the most alike, the first in the list, the first in the text."""
    ordered = F.array_sort(F.transform(passages, lambda x: F.struct((-x["back"]).alias("at"), x.alias("x"))))
    kind = "array<struct<common:int,dice:double,order:int,back:int,last:int,name:string>>"
    start = F.struct(F.array().cast(kind).alias("done"), F.array().cast(kind).alias("now"))

    def step(state: Column, y: Column) -> Column:
        now = F.get(state["now"], F.lit(0))
        apart = F.coalesce(y["at"] > now["last"], F.lit(True))
        return F.struct(
            F.when(apart, F.concat(state["done"], state["now"])).otherwise(state["done"]).alias("done"),
            F.when(apart | (y["x"] > now), F.array(y["x"])).otherwise(state["now"]).alias("now"),
        )

    return F.aggregate(ordered, start, step, lambda s: F.concat(s["done"], s["now"]))


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """Per document: doc_id, licenses (names, sorted, comma-joined), n_units (lines, texts and passages that match), best (largest coefficient, 0 if none).

    A unit counts for the template it is most like, the first in the list on equal
    coefficients. Of passages that overlap one counts; it does not when half of its words are
    in lines that match or when the text as a whole matches the same template. Null, empty
    and blank texts have no unit that matches. Repeated rows are scanned each; an empty table
    gives no rows.
    """
    templates = {name: t for name, t in (TEMPLATES if templates is None else templates).items() if bigrams_of(t)}
    grams = {name: bigrams_of(t) for name, t in templates.items()}
    bounds = [size_bounds(len(g), least) for g in grams.values()]
    low, high = min(a for a, _ in bounds), max(b for _, b in bounds)
    telling = "|".join(sorted(set().union(*[_telling(t, least) for t in templates.values()])))
    any_gram = sorted(set().union(*grams.values()))

    each = []
    for order, (name, g) in enumerate(grams.items()):
        a, b = size_bounds(len(g), least)
        dice = f"CASE WHEN size(g) BETWEEN {a} AND {b} THEN 2.0D * size(array_intersect(g, array({_listed(g)}))) / (size(g) + {len(g)}) ELSE 0.0D END"
        each.append(f"named_struct('dice', {dice}, 'order', {-order}, 'name', '{_quoted(name)}')")
    likeness = f"array_max(array({', '.join(each)}))"

    def liked(words: str) -> str:
        """What a unit, its words given, counts for; null if nothing."""
        pairs = "zip_with(slice(w, 1, size(w) - 1), slice(w, 2, size(w) - 1), (c, d) -> concat(c, ' ', d))"
        fitting = f"filter(transform(filter(array({words}), w -> size(w) > {low}), w -> array_distinct({pairs})), g -> size(g) BETWEEN {low} AND {high})"
        return f"get(filter(transform({fitting}, g -> {likeness}), x -> x.dice >= {least!r}D), 0)"

    text = F.coalesce(F.col("text"), F.lit(""))
    cut = docs.select("doc_id", F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("__low"))
    cut = cut.select(
        "doc_id",
        F.transform(F.split("__low", "\n"), lambda x: F.regexp_extract_all(x, F.lit("[a-z0-9]+"), F.lit(0))).alias("__lines"),
        F.col("__low").rlike(f"(?<![a-z0-9])(?:{telling})(?![a-z0-9])").alias("__search"),
    )
    units = cut.select(
        "doc_id", "__lines", "__search", F.flatten("__lines").alias("__words"), F.expr(f"transform(__lines, u -> {liked('u')})").alias("__by_line")
    )
    units = units.select(
        "doc_id", "__lines", "__search", "__words", "__by_line", F.when(F.size("__lines") > 1, F.expr(liked("__words"))).alias("__whole")
    )
    none = F.array().cast("array<string>")
    units = units.withColumn("__pairs", F.when(F.col("__search"), _pairs(F.col("__words"))).otherwise(none))
    places = F.expr(f"transform(__pairs, (p, i) -> CASE WHEN p IN ({_listed(any_gram)}) THEN named_struct('at', i + 1, 'pair', p) END)")
    units = units.withColumn("__places", F.filter(places, lambda x: x.isNotNull()))
    own = [f"__own_{k}" for k in range(len(grams))]
    units = units.select("*", *[_places_in(g).alias(c) for c, g in zip(own, grams.values(), strict=True)])
    found = F.concat(*[_passages(k, name, t, own[k], least) for k, (name, t) in enumerate(templates.items())])
    units = units.withColumn("__found", found).drop(*own).withColumn("__found", _apart(F.col("__found")))
    inside = F.flatten(F.transform(F.arrays_zip(F.col("__lines").alias("words"), F.col("__by_line").alias("hit")), lambda x: F.array_repeat(x["hit"].isNotNull(), F.size(x["words"]))))
    units = units.withColumn("__inside", F.when(F.size("__found") > 0, inside))

    def adds(x: Column) -> Column:
        n = x["last"] + x["back"] + 1
        taken = F.size(F.filter(F.slice("__inside", -x["back"], n), lambda y: y))
        return (2 * taken < n) & F.coalesce(x["name"] != F.col("__whole")["name"], F.lit(True))

    hit = lambda x: F.struct(x["dice"].alias("dice"), x["name"].alias("name"))
    hits = F.concat(F.transform("__by_line", lambda x: F.when(x.isNotNull(), hit(x))), F.array(F.when(F.col("__whole").isNotNull(), hit(F.col("__whole")))), F.transform(F.filter("__found", adds), hit))
    found = units.select("doc_id", F.filter(hits, lambda x: x.isNotNull()).alias("__hits"))
    return found.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct(F.col("__hits.name"))), ",").alias("licenses"),
        F.size("__hits").cast("long").alias("n_units"),
        F.coalesce(F.round(F.array_max(F.col("__hits.dice")), 6), F.lit(0.0)).alias("best"),
    )
