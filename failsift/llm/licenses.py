"""Licence scan: Dice coefficient over word bigrams between normalised text and templates.

A unit is a line of a document, the document as a whole where it has several lines, or a window
of words: notices that are wrapped over lines or stand within a line. Text
is lower-cased and every run of other characters than letters and digits becomes a blank.
With A and B the sets of word bigrams, the score is 2|A∩B| / (|A|+|B|); a score of at least t
needs t/(2-t) <= |A|/|B| <= (2-t)/t, so templates outside these bounds are not compared.
Units that share no bigram with any template are dropped first. All of it is a projection
over the scanned rows, with the templates as literals: no row is shuffled.

A window begins and ends with a bigram of its template, may cross lines and has at most
(2-t)/t times as many bigrams, repeats counted. It spans one alignment of the template with the
text, or two that begin close to each other, as words put in or left out move what follows.
Of windows that overlap, the one with most bigrams of its template stays, in one pass by start;
a line or document that matches with as many stands for the windows in it.
Windows are looked for where the document holds enough of a template's bigrams, which is asked
only of documents that hold a word without which they cannot. No step
compares notices with each other, so a text of nothing but notices has a bounded number of
windows per notice.

Defined cases: null and empty texts and units of fewer than two words match nothing; a
document without match has a null licence, score 0 and 0 matches. Equal scores go to the
template first by name. Every row of the input, repeated ones included, gives one row. Null
ids are kept. No rows give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Wording of public licence notices.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "apache-2.0-warranty": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met:",
    "bsd-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "mit": "Released under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:"
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def bigrams_in_order(text: str) -> list[str]:
    words = re.sub(r"[^\w]+|_+", " ", text.lower()).split()
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def template_bigrams(text: str) -> list[str]:
    return sorted(set(bigrams_in_order(text)))


def known_bigrams(templates: dict[str, str]) -> list[str]:
    return sorted({b for text in templates.values() for b in template_bigrams(text)})


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def constants(values: list) -> Column:
    """A constant array of strings, folded to one literal by the optimizer."""
    return F.split(F.lit("|".join(map(str, values))), r"\|")


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def bigrams_of(words: Column) -> Column:
    """The distinct word bigrams; ``words`` must hold at least two."""
    return F.array_distinct(
        F.zip_with(
            F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b)
        )
    )


def template_table(templates: dict[str, str], threshold: float) -> Column:
    """The templates as one constant array: bigrams, their numbers in the order of the text, bounds."""
    least, most = threshold / (2 - threshold), (2 - threshold) / threshold
    known, rows = known_bigrams(templates), []
    for name, text in sorted(templates.items()):
        own, numbers = template_bigrams(text), [known.index(b) + 1 for b in bigrams_in_order(text)]
        longest = int(len(own) * most + 1e-9)
        rows.append(
            F.struct(
                F.lit(name).alias("licence"),
                constants(own).alias("own"),
                F.lit(len(own)).alias("size"),
                F.lit(len(own) * least).alias("low"),
                F.lit(len(own) * most).alias("high"),
                constants(numbers).cast("array<bigint>").alias("numbers"),
                F.lit(max(1, math.ceil(len(own) * least - 1e-9))).alias("need"),
                F.lit(longest).alias("longest"),
                F.lit(max(0, longest - len(numbers))).alias("slack"),
            )
        )
    return F.array(*rows)


def best_of_units(units: Column, table: Column, known: list[str], threshold: float) -> Column:
    """Per unit its words and its best template, (order, licence, shared bigrams), if one matches."""

    def best(s: Column) -> Column:
        possible = F.filter(
            table,
            lambda t: s["size"].between(t["low"], t["high"]) & (F.size(s["shared"]) * 2.0 / (s["size"] + t["size"]) >= threshold),
        )
        scores = F.transform(
            possible,
            lambda t: bound(
                F.size(F.array_intersect(t["own"], s["shared"])),
                lambda both: F.struct(
                    (-(both * 2.0 / (s["size"] + t["size"]))).alias("order"), t["licence"].alias("licence"), both.alias("shared")
                ),
            ),
        )
        return F.array_min(F.filter(scores, lambda b: b["order"] <= -threshold))

    def matched(words: Column) -> Column:
        shared = bound(
            bigrams_of(words),
            lambda b: F.struct(F.size(b).alias("size"), F.filter(b, lambda x: x.isin(known)).alias("shared")),
        )
        chosen = F.when(F.size(words) >= 2, bound(shared, lambda s: F.when(F.size(s["shared"]) > 0, best(s))))
        return F.struct(F.size(words).alias("words"), chosen.alias("best"))

    return F.transform(F.transform(units, words_of), matched)


def telling_words(own: list[str], need: int) -> list[str]:
    """Long words of which a text with ``need`` of the bigrams ``own`` holds at least one."""
    left, words = set(own), []
    while len(own) - len(left) <= len(own) - need:
        words.append(max({w for b in left for w in b.split()}, key=lambda w: (len(w), w)))
        left = {b for b in left if words[-1] not in b.split()}
    return words


def windows_of(grams: Column, table: Column, known: list[str], threshold: float) -> Column:
    """(start, end, shared, order, licence) of the windows of ``grams`` that match, by start.

    A place of a template's bigram tells where the template would begin, its offset. A window
    reaches from one offset to where the template that begins at the same or a later offset would
    end, and is cut to the template's first and last bigram in it.
    """

    def search(t: Column, ids: Column) -> Column:
        def window(start: Column, end: Column, ks: Column) -> Column:
            """The cut window as one number, null if it holds too few places of the template."""
            places = F.transform(F.slice(ks, start + 1, end - start + 1), lambda k, i: F.when(k > 0, start + i))
            return bound(
                F.filter(places, lambda p: p.isNotNull()),
                lambda p: F.when(
                    F.size(p) >= t["need"], F.shiftleft(F.element_at(p, 1).cast("long"), 32) + F.element_at(p, -1)
                ),
            )

        def from_offset(o: Column, i: Column, offsets: Column, ks: Column) -> Column:
            ends = F.filter(F.slice(offsets, i + 1, t["slack"] + 1), lambda e: e <= o + t["slack"])
            start, last = F.greatest(o, F.lit(0)), F.size(ks) - 1
            return F.transform(ends, lambda e: window(start, F.least(e + F.size(t["numbers"]) - 1, last), ks))

        def scored(start: Column, end: Column, ks: Column) -> Column:
            size = end - start + 1
            both = F.size(F.array_distinct(F.filter(F.slice(ks, start + 1, size), lambda k: k > 0)))
            return bound(
                both,
                lambda n: F.struct(
                    start.alias("start"),
                    end.alias("end"),
                    n.alias("shared"),
                    (-(n * 2.0 / (F.size(F.array_distinct(F.slice(grams, start + 1, size))) + t["size"]))).alias("order"),
                    t["licence"].alias("licence"),
                ),
            )

        def from_offsets(offsets: Column, ks: Column) -> Column:
            cut = F.array_distinct(F.flatten(F.transform(offsets, lambda o, i: from_offset(o, i, offsets, ks))))
            spans = F.filter(
                F.transform(
                    F.filter(cut, lambda w: w.isNotNull()),
                    lambda w: F.struct(F.shiftright(w, 32).cast("int").alias("start"), w.bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("end")),
                ),
                lambda w: w["end"] - w["start"] < t["longest"],
            )
            return F.filter(F.transform(spans, lambda w: scored(w["start"], w["end"], ks)), lambda w: w["order"] <= -threshold)

        def from_places(ks: Column) -> Column:
            begins = F.filter(F.transform(ks, lambda k, p: F.when(k > 0, p - k + 1)), lambda o: o.isNotNull())
            return bound(F.sort_array(F.array_distinct(begins)), lambda offsets: from_offsets(offsets, ks))

        # Place of each bigram in the template, from 1; 0 for others.
        return bound(F.transform(ids, lambda n: F.when(n > 0, F.array_position(t["numbers"], n)).otherwise(0).cast("int")), from_places)

    def from_ids(ids: Column) -> Column:
        held = F.array_distinct(F.filter(ids, lambda n: n > 0))
        sought = bound(held, lambda h: F.filter(table, lambda t: F.size(F.array_intersect(t["numbers"], h)) >= t["need"]))
        return F.sort_array(F.flatten(F.transform(sought, lambda t: search(t, ids))))

    return bound(F.transform(grams, lambda g: F.when(g.isin(known), F.array_position(constants(known), g)).otherwise(0)), from_ids)


def outstanding(windows: Column, units: Column, lines: Column) -> Column:
    """The windows that meet no line, and are not the document, that matches with as many bigrams."""

    def per_bigram(u: Column) -> Column:
        shared = F.coalesce(u["best"]["shared"], F.lit(0))
        return F.when(u["words"] > 0, F.concat(F.array_repeat(shared, u["words"] - 1), F.array(F.lit(0)))).otherwise(
            F.array().cast("array<int>")
        )

    whole = F.coalesce(F.element_at(units, -1)["best"]["shared"], F.lit(0))
    return bound(
        F.flatten(F.transform(F.slice(units, 1, lines), per_bigram)),
        lambda cover: F.filter(
            windows,
            lambda w: (w["shared"] > whole)
            & (w["shared"] > F.array_max(F.slice(cover, w["start"] + 1, w["end"] - w["start"] + 1))),
        ),
    )


_WINDOW = "struct<start:int,end:int,shared:int,order:double,licence:string>"
_SUMMARY = "struct<matches:int,best:struct<order:double,licence:string>,licences:array<string>>"


def summary(windows: Column) -> Column:
    """Number, best and licences of the windows left of those that overlap, in one pass by start."""

    def close(state: Column) -> Column:
        last, done = state["last"], state["done"]
        best = F.struct(last["order"].alias("order"), last["licence"].alias("licence"))
        return F.when(
            last.isNotNull(),
            F.struct(
                (done["matches"] + 1).alias("matches"),
                F.least(F.coalesce(done["best"], best), best).alias("best"),
                F.array_union(done["licences"], F.array(last["licence"])).alias("licences"),
            ),
        ).otherwise(done).cast(_SUMMARY)

    def take(state: Column, w: Column) -> Column:
        last = state["last"]
        apart = last.isNull() | (w["start"] > last["end"])
        better = (w["shared"] > last["shared"]) | ((w["shared"] == last["shared"]) & (w["order"] < last["order"]))
        return F.struct(
            F.when(apart | better, w).otherwise(last).cast(_WINDOW).alias("last"),
            F.when(apart, close(state)).otherwise(state["done"]).cast(_SUMMARY).alias("done"),
        )

    start = F.struct(F.lit(None).cast(_WINDOW).alias("last"), nothing().alias("done"))
    return F.aggregate(windows.cast(f"array<{_WINDOW}>"), start, take, close)


def nothing() -> Column:
    return F.struct(
        F.lit(0).alias("matches"),
        F.lit(None).cast("struct<order:double,licence:string>").alias("best"),
        F.array().cast("array<string>").alias("licences"),
    ).cast(_SUMMARY)


def scan_licences(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, licence and score of the best unit, matches (units that match), licences (all found)."""
    known, table = known_bigrams(templates), template_table(templates, threshold)
    least = threshold / (2 - threshold)
    sets = [template_bigrams(text) for text in templates.values()]
    telling = sorted({w for own in sets for w in telling_words(own, max(1, math.ceil(len(own) * least - 1e-9)))})

    def more(text: Column, units: Column, lines: Column) -> Column:
        """The summary of the windows; most texts hold no telling word."""
        windows = lambda words: bound(
            F.zip_with(
                F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b)
            ),
            lambda grams: windows_of(grams, table, known, threshold),
        )
        searched = bound(words_of(text), lambda words: F.when(F.size(words) >= 2, windows(words)))
        found = bound(searched, lambda w: F.when(F.size(w) > 0, summary(outstanding(w, units, lines))))
        possible = bound(F.lower(text), lambda low: functools.reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in telling]))
        return F.coalesce(F.when(possible, found), nothing())

    def result(text: Column, units: Column, lines: Column) -> Column:
        matched = F.filter(F.transform(units, lambda u: u["best"]), lambda b: b.isNotNull())
        return bound(
            F.struct(matched.alias("units"), more(text, units, lines).alias("windows")),
            lambda r: F.struct(
                F.least(
                    F.array_min(F.transform(r["units"], lambda b: F.struct(b["order"].alias("order"), b["licence"].alias("licence")))),
                    r["windows"]["best"],
                ).alias("best"),
                (F.size(r["units"]) + r["windows"]["matches"]).alias("matches"),
                F.array_union(F.transform(r["units"], lambda b: b["licence"]), r["windows"]["licences"]).alias("licences"),
            ),
        )

    def scanned(lines: Column) -> Column:
        units = F.when(F.size(lines) > 1, F.concat(lines, F.array(F.col("text")))).otherwise(lines)
        return bound(best_of_units(units, table, known, threshold), lambda u: result(F.col("text"), u, F.size(lines)))

    found = docs.select("doc_id", F.when(F.col("text").isNotNull(), bound(F.split("text", "\n"), scanned)).alias("found"))
    return found.select(
        "doc_id",
        F.col("found.best.licence").alias("licence"),
        F.coalesce(-F.col("found.best.order"), F.lit(0.0)).alias("score"),
        F.coalesce("found.matches", F.lit(0)).alias("matches"),
        F.coalesce(F.array_join(F.sort_array("found.licences"), ","), F.lit("")).alias("licences"),
    )
