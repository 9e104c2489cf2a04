"""License scan: normalised text against licence templates, by Dice over word bigrams.

All of it is DataFrame expressions on one row at a time; nothing is shuffled.  A text is
cut into lines and into paragraphs of several lines.  Two bounds leave few of these
to compare.  Dice over bigram sets of sizes a and b is 2 s / (a + b) with s shared and
s <= min(a, b), so at a level t only pairs with b t / (2 - t) <= a <= b (2 - t) / t
can reach it.  And a pair that does shares at least t / (2 - t) of the template's
bigrams, so of any set of more than the remaining ones at least one: for each template
such a set is chosen by its longest words, and units without any of those are out.
"""

from __future__ import annotations

import re
from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import text_or_empty

LEVEL = 0.8

# Statements and notices of public licences, as people write them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def normal_words(text: str) -> list[str]:
    """Words of a template, as normalised() makes them of ASCII text."""
    return re.findall(r"[a-z0-9]+", text.lower())


def bigram_set(words: list[str]) -> list[str]:
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def needed_words(templates, level: float) -> list[str]:
    """Words of which every unit that reaches the level has one."""
    least = level / (2 - level)
    words = set()
    for _, text in templates:
        pairs = bigram_set(normal_words(text))
        # At least ceil(least * b) of b bigrams are shared, so one of any b - that + 1.
        enough = min(len(pairs), floor(len(pairs) * (1 - least) + 1e-9) + 1)
        by_length = sorted(pairs, key=lambda p: (-max(map(len, p.split())), p))
        words |= {max(p.split(), key=len) for p in by_length[:enough]}
    return sorted(words)


def normalised(text: Column) -> Column:
    """Lower case, every run of other characters than ASCII letters, digits and line ends as one blank."""
    return F.regexp_replace(F.lower(text), r"[^a-z0-9\n]+", " ")


def units(text: Column) -> Column:
    """Lines, and paragraphs of more than one line, of a normalised text."""
    lines = F.split(text, r" *\n *")
    paragraphs = F.filter(F.split(text, r" *\n *\n[ \n]*"), lambda p: F.contains(F.trim(F.translate(p, "\n", "\v")), F.lit("\v")))
    joined = F.transform(paragraphs, lambda p: F.regexp_replace(p, r" *\n *", " "))
    return F.transform(F.concat(lines, joined), lambda u: F.trim(u))


def pairs_of(unit: Column) -> Column:
    """The set of word bigrams of a unit."""
    words = F.split(unit, " ")
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b)))


def license_scan(docs: DataFrame, templates=TEMPLATES, level: float = LEVEL) -> DataFrame:
    """docs (doc_id, text, ...) -> row for row: doc_id, n_matches, license, dice, licenses.

    n_matches: units that reach the level with some template.  license, dice: the best match
    of the text, ties to the smaller license, dice to 6 places; null if there is none.
    licenses: all matched, distinct, in order, joined by commas; empty if there are none.
    Null and empty texts match nothing; repeated rows and null doc_ids are kept; other
    columns are not read.  No rows give no rows.
    """
    sizes = [len(bigram_set(normal_words(t))) for _, t in templates]
    narrow, wide = level / (2 - level), (2 - level) / level
    fewest, most = int(min(sizes) * narrow), int(max(sizes) * wide) + 1
    known = F.array(*[
        F.struct(F.lit(name).alias("license"), F.array(*map(F.lit, bigram_set(normal_words(t)))).alias("pairs"), F.lit(n).alias("n"))
        for (name, t), n in zip(templates, sizes, strict=True)
    ])
    any_needed = r"(?:^|[^a-z0-9])(?:" + "|".join(needed_words(templates, level)) + r")(?:[^a-z0-9]|$)"
    blanks = lambda u: F.length(u) - F.length(F.replace(u, F.lit(" "), F.lit("")))
    text = F.lower(text_or_empty())
    # Texts without any needed word are out before they are normalised.
    cut = F.when(text.rlike(any_needed), F.filter(units(normalised(text)), lambda u: u.rlike(any_needed) & (blanks(u) >= fewest)))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), cut.alias("units"))

    def against(unit: Column) -> Column:
        pairs, size = unit["pairs"], F.size(unit["pairs"])
        near = F.filter(known, lambda t: (size >= t["n"] * narrow - 1e-9) & (size <= t["n"] * wide + 1e-9))
        dice = lambda t: F.lit(2.0) * F.size(F.array_intersect(pairs, t["pairs"])) / (size + t["n"])
        matches = F.transform(near, lambda t: F.struct(F.round(-dice(t), 6).alias("minus"), t["license"].alias("license")))
        return F.filter(matches, lambda m: m["minus"] <= -level + 1e-9)

    named = F.transform("units", lambda u: F.struct(pairs_of(u).alias("pairs")))
    few = F.filter(named, lambda u: F.size(u["pairs"]) <= most)
    found = found.withColumn("matches", F.filter(F.transform(few, against), lambda m: F.size(m) > 0))
    best = F.array_min(F.flatten("matches"))
    best_of_each = F.transform("matches", lambda m: F.array_min(m)["license"])
    return found.select(
        "doc_id",
        F.coalesce(F.size("matches"), F.lit(0)).cast("long").alias("n_matches"),
        best["license"].alias("license"),
        (-best["minus"]).alias("dice"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(best_of_each)), ","), F.lit("")).alias("licenses"),
    )


def license_sql(templates=TEMPLATES, level: float = LEVEL) -> str:
    """The same rows in DuckDB's SQL, over all units and without the bounds; a unit that shares no bigram has a Dice of 0."""
    quoted = ", ".join("('{}', {})".format(n, "[" + ", ".join(f"'{p}'" for p in bigram_set(normal_words(t))) + "]") for n, t in templates)
    return f"""
WITH templates(license, pairs) AS (VALUES {quoted}),
normal AS (SELECT row_number() OVER () AS rid, doc_id, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\\n]+', ' ', 'g') AS text FROM documents),
cut AS (
  SELECT rid, regexp_split_to_array(text, ' *\\n *') AS lines,
         list_filter(regexp_split_to_array(text, ' *\\n *\\n[ \\n]*'), lambda p: contains(trim(p, E' \\n'), E'\\n') AND contains(trim(replace(p, E'\\n', E'\\v'), ' '), E'\\v')) AS paragraphs FROM normal),
units AS (SELECT rid, pos, trim(unit) AS unit FROM (
  SELECT rid, unnest(list_concat(lines, list_transform(paragraphs, lambda p: regexp_replace(p, ' *\\n *', ' ', 'g')))) AS unit,
         unnest(range(len(lines) + len(paragraphs))) AS pos FROM cut)),
words AS (SELECT rid, pos, string_split(unit, ' ') AS w FROM units),
pairs AS (SELECT rid, pos, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS p FROM words WHERE len(w) >= 2),
grams AS (SELECT rid, pos, len(p) AS n, unnest(p) AS g FROM pairs),
known AS (SELECT license, len(pairs) AS m, unnest(pairs) AS g FROM templates),
dice AS (SELECT rid, pos, license, 2.0 * count(*) / (n + m) AS dice FROM grams JOIN known USING (g) GROUP BY rid, pos, license, n, m),
good AS (SELECT rid, pos, license, round(dice, 6) AS dice, row_number() OVER (PARTITION BY rid, pos ORDER BY round(dice, 6) DESC, license) AS place
  FROM dice WHERE dice >= {level} - 1e-9),
best AS (SELECT * FROM good WHERE place = 1),
per_doc AS (
  SELECT rid, count(*) AS n, arg_min(license, (-dice, license)) AS license, max(dice) AS dice,
         string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM best GROUP BY rid)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_matches, license, dice, coalesce(licenses, '') AS licenses
FROM normal LEFT JOIN per_doc USING (rid)
"""
