"""License scan: runs of words of texts against licence templates, by DataFrame functions alone.

A notice may be wrapped over lines or stand inside a longer one, so what is compared
with a template is any run of consecutive words of the normalised text whose number of
bigrams is within the size bounds of the template.  A run that begins or ends with a bigram
the template lacks is no better without it, so only runs between two of the template's
bigrams are looked at, and only where enough of them stand close together.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import id_and_text

SIMILARITY = 0.8

# The notices by which works are put under common licences.
TEMPLATES = {
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-4.0": "Licensed under CC BY-ND 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def normal(text: str) -> list[str]:
    """Lower-case runs of ASCII letters and digits."""
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def bigrams(words: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def size_bounds(size: int, similarity: float = SIMILARITY) -> tuple[int, int]:
    """Counts of bigrams beyond which a Dice coefficient of ``similarity`` can't be reached.

    2 c / (a + b) <= 2 min(a, b) / (a + b), so b is between a s / (2 - s) and a (2 - s) / s.
    """
    return math.ceil(size * similarity / (2 - similarity) - 1e-9), math.floor(size * (2 - similarity) / similarity + 1e-9)


def needed_pairs(b: set[str], similarity: float = SIMILARITY) -> list[str]:
    """Bigrams of which every run that matches a template of bigrams ``b`` holds one at least.

    A match shares c of the template's bigrams with c >= |b| s / (2 - s), so it has one
    of any |b| - c + 1 of them: those of the most letters are taken, as they are rare.
    """
    return sorted(b, key=lambda p: (-len(p), p))[: len(b) - size_bounds(len(b), similarity)[0] + 1]


def _with(value: Column, of) -> Column:
    """``of(value)`` as an array of one: a lambda binds the value, so it is computed once."""
    return F.transform(F.array(value), of)


def _best_run(grams: Column, b: set[str], similarity: float) -> Column:
    """The greatest Dice coefficient of a run of ``grams`` with the template ``b``; null if none is near."""
    lo, hi = size_bounds(len(b), similarity)
    template = F.array(*map(F.lit, sorted(b)))

    def from_hits(hits: Column) -> Column:  # places of the template's bigrams
        last = F.size(hits) - 1

        def dice(start: Column, end: Column) -> Column:
            first = F.get(hits, start)
            run = F.array_distinct(F.slice(grams, first + 1, F.get(hits, end) - first + 1))
            return F.get(_with(run, lambda r: 2.0 * F.size(F.array_intersect(r, template)) / (F.size(r) + len(b))), F.lit(0))

        def from_start(start: Column) -> Column:
            ends = F.sequence(start + (lo - 1), F.least(start + (hi - 1), last))
            return F.array_max(F.transform(F.filter(ends, lambda e: F.get(hits, e) - F.get(hits, start) < hi), lambda e: dice(start, e)))

        starts = F.when(last >= lo - 1, F.sequence(F.lit(0), last - (lo - 1))).otherwise(F.array().cast("array<int>"))
        return F.array_max(F.transform(F.filter(starts, lambda p: F.get(hits, p + (lo - 1)) - F.get(hits, p) < hi), from_start))

    places = F.transform(grams, lambda g, i: F.when(F.array_contains(template, g), i))
    return F.get(_with(F.filter(places, lambda i: i.isNotNull()), from_hits), F.lit(0))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_licenses, licenses (sorted identifiers), best: a row for every row of ``docs``.

    A text holds a licence if some run of its consecutive words has a Dice coefficient of at
    least ``similarity`` with the template, both as sets of word bigrams; the run has as many
    bigrams as the size bounds of the template allow.  ``best`` is the greatest coefficient of
    all licences found, 0 without one.  Texts without any bigram that a match needs are passed over.

    Null and empty texts have no licence; texts of any length are read whole; repeated rows
    and null identifiers give a row each; a template without two words matches nothing;
    further columns are ignored; an empty table gives no rows.
    """
    templates = TEMPLATES if templates is None else templates
    parsed = {k: bigrams(normal(t)) for k, t in sorted(templates.items())}
    parsed = {k: b for k, b in parsed.items() if b}
    found = empty = F.array().cast("array<struct<id:string,dice:double>>")
    if parsed:
        needed = {k: needed_pairs(b, similarity) for k, b in parsed.items()}
        pairs = sorted({p for ps in needed.values() for p in ps})
        either = lambda tests: reduce(Column.__or__, tests)
        likely = lambda t: either(reduce(Column.__and__, [F.contains(t, F.lit(w)) for w in p.split()]) for p in pairs)
        holds = lambda n, ps: either(F.contains(n, F.lit(f" {p} ")) for p in ps)

        def of_text(n: Column) -> Column:  # normalised, with a space before and behind each word
            words = F.filter(F.split(n, " "), lambda w: w != "")
            grams = _with(words, lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b)))
            tests = lambda g: F.array(*(F.struct(F.lit(k).alias("id"), F.when(holds(n, needed[k]), _best_run(g, b, similarity)).alias("dice")) for k, b in parsed.items()))
            return F.filter(F.flatten(F.transform(grams, tests)), lambda t: t["dice"] >= similarity)

        plain = F.transform(F.filter(F.array(F.lower("text")), likely), lambda t: F.concat(F.lit(" "), F.regexp_replace(t, "[^a-z0-9]+", " "), F.lit(" ")))
        found = F.flatten(F.transform(F.filter(plain, lambda n: holds(n, pairs)), of_text))
    rows = id_and_text(docs).select("doc_id", F.coalesce(found, empty).alias("found"))
    return rows.select(
        "doc_id",
        F.size("found").cast("long").alias("n_licenses"),
        F.array_join(F.transform("found", lambda f: f["id"]), ",").alias("licenses"),
        F.round(F.coalesce(F.array_max(F.transform("found", lambda f: f["dice"])), F.lit(0.0)), 6).alias("best"),
    )


def sql(templates: dict[str, str] | None = None, similarity: float = SIMILARITY) -> str:
    """The same rows by DuckDB: all runs between two bigrams of a template, by joins."""
    parsed = {k: sorted(bigrams(normal(t))) for k, t in sorted((templates or TEMPLATES).items())}
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(k)}, [{', '.join(map(quote, b))}], {', '.join(map(str, size_bounds(len(b), similarity)))})" for k, b in parsed.items() if b)
    return f"""
    WITH template(id, grams, least, most) AS (VALUES {rows}),
    part AS (SELECT id, unnest(grams) AS g FROM template),
    docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
    word AS (SELECT r, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM docs),
    gram AS (SELECT r, unnest(range(1, len(w))) AS i, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM word WHERE len(w) > 1),
    hit AS (SELECT r, id, i FROM gram JOIN part USING (g)),
    run AS (SELECT a.r, a.id, a.i AS first, b.i AS last FROM hit a JOIN hit b ON a.r = b.r AND a.id = b.id JOIN template t ON t.id = a.id WHERE b.i - a.i + 1 BETWEEN least AND most),
    place AS (SELECT r, id, first, last, unnest(range(first, last + 1)) AS i FROM run),
    held AS (SELECT DISTINCT p.r, p.id, first, last, g, part.g IS NOT NULL AS common FROM place p JOIN gram USING (r, i) LEFT JOIN part USING (id, g)),
    score AS (SELECT r, id, 2.0 * count_if(common) / (count(*) + max(len(grams))) AS dice FROM held JOIN template USING (id) GROUP BY r, id, first, last),
    best AS (SELECT r, count(DISTINCT id) AS n, string_agg(DISTINCT id, ',' ORDER BY id) AS ids, max(dice) AS dice FROM score WHERE dice >= {similarity} GROUP BY r)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_licenses, coalesce(ids, '') AS licenses, round(coalesce(dice, 0.0)::DOUBLE, 6) AS best
    FROM docs LEFT JOIN best USING (r)"""
