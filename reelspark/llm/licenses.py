"""License scans: runs of lines of normalised text compared to license templates by the Dice coefficient of their word bigrams."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm.common import read, text_or_empty

#: Notices by which texts are commonly licensed and short licenses in full, by SPDX-like name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
THRESHOLD = 0.8
#: Lower-case runs of letters, digits and inner dots are words; everything else parts them.
WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
#: Characters of texts worked on before rows are handed back.
SLICE = 4_000_000


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Sizes that a bigram set may have to reach the threshold against a set of n: Dice is at most 2 min / (n + size)."""
    return math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)


class Templates:
    """Bigram sets of templates, and an index from a bigram to the templates that have it."""

    def __init__(self, templates: dict[str, str], threshold: float) -> None:
        self.threshold = threshold
        self.names, self.sizes, self.bounds, self.index = [], [], [], {}
        for name, text in sorted(templates.items()):
            words = WORD.findall(text.lower())
            own = set(zip(words, words[1:]))
            if own:
                for b in own:
                    self.index.setdefault(b, []).append(len(self.names))
                self.names.append(name)
                self.sizes.append(len(own))
                self.bounds.append(size_bounds(len(own), threshold))
        #: Second words of bigrams by the first: what most words have none of.
        self.firsts = {b[0] for b in self.index}

    def found(self, text: str) -> list[tuple[int, int, str, float]]:
        """First and last line (from 1), name and Dice coefficient of the templates in a text, see scan_licenses."""
        low = text.lower()
        words = WORD.findall(low)
        if self.firsts.isdisjoint(words):
            return []
        hits: dict[int, list[int]] = {}
        for k, b in enumerate(zip(words, words[1:])):
            if b[0] in self.firsts:
                for t in self.index.get(b, ()):
                    hits.setdefault(t, []).append(k)
        # a run alike enough shares at least what the smallest set allowed does
        near = {t: at for t, at in hits.items() if len({(words[k], words[k + 1]) for k in at}) >= self.bounds[t][0]}
        if not near:
            return []
        line = [i for i, x in enumerate(low.split("\n"), 1) for _ in WORD.findall(x)]
        starts = {}
        for k, i in enumerate(line):
            starts.setdefault(i, k)
        made = [c for t, at in near.items() for c in self._runs(t, at, words, line, starts)]
        made.sort(key=lambda c: (-c[3], c[1] - c[0], c[0], c[2]))
        kept: list[tuple[int, int, str, float]] = []
        for c in made:
            if all(c[1] < o[0] or o[1] < c[0] for o in kept):
                kept.append(c)
        return sorted(kept)

    def _runs(self, t: int, at: list[int], words: list[str], line: list[int], starts: dict[int, int]) -> Iterator[tuple[int, int, str, float]]:
        """Runs of lines alike a template: a run begins and ends at lines with bigrams of it, as leaving out others makes it more alike, and is
        grown line by line as long as its own bigrams are within the bounds."""
        lo, hi = self.bounds[t]
        ends = sorted({line[k + 1] for k in at})
        for first in sorted({line[k] for k in at}):
            seen, shared, k = set(), 0, starts[first]
            for last in ends:
                if last < first:
                    continue
                while k + 1 < len(words) and line[k + 1] <= last:
                    b = (words[k], words[k + 1])
                    if b not in seen:
                        seen.add(b)
                        shared += t in self.index.get(b, ())
                    k += 1
                if len(seen) > hi:
                    break
                dice = 2.0 * shared / (len(seen) + self.sizes[t])
                if len(seen) >= lo and dice >= self.threshold:
                    yield first, last, self.names[t], dice


FOUND = "doc_id long, n_lines long, licenses array<struct<line:int,last_line:int,name:string,dice:double>>"


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, n_lines, licenses (array of line, last_line, name, dice, in order of line).

    Runs of consecutive lines are compared to templates, so a license is found however it is wrapped. Of all runs whose distinct word bigrams, those over line ends
    included, have a Dice coefficient of the threshold or more with a template's, the most alike stays first (ties: the fewest lines, the first line, the first name), then
    the next that shares no line with those. An index of the templates' bigrams tells which templates have enough of theirs in a text, by the bounds of sizes that can reach
    the threshold; most texts have none, and nothing is lost. Texts are scanned whole. Null and empty texts have no license and one line; repeated rows and null ids are
    scanned each; templates of fewer than two words are ignored; an empty table gives none. No row is shuffled; the index goes to the tasks and is as large as the templates."""
    known = Templates(templates, threshold)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, held = [], 0
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                found = [{"line": a, "last_line": b, "name": n, "dice": d} for a, b, n, d in known.found(text)]
                out.append((None if pd.isna(doc_id) else int(doc_id), text.count("\n") + 1, found))
                held += len(text)
                if held >= SLICE:
                    yield _frame(out)
                    out, held = [], 0
            if out:
                yield _frame(out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")).mapInPandas(scan, FOUND)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["doc_id", "n_lines", "licenses"]).astype({"doc_id": "Int64"})


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read(spark, sf_dir, "documents"))
    told = F.array_join(F.transform("licenses", lambda s: F.concat(s["line"].cast("string"), F.lit("-"), s["last_line"].cast("string"), F.lit(":"), s["name"])), ",")
    return found.select("doc_id", "n_lines", F.size("licenses").cast("long").alias("n_licenses"), F.coalesce(F.array_max(F.transform("licenses", lambda s: s["dice"])), F.lit(0.0)).alias("best_dice"), told.alias("licenses"))


QUERIES = {"op4_license_scan": op4_license_scan}
_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+(?:\.[\p{{N}}]+)*')".format
_VALUES = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in sorted(TEMPLATES.items()))
#: Every run of lines that begins and ends with a template's bigram, then one candidate after the other, best first, where no line is taken.
ORACLE = {
    "op4_license_scan": f"""
WITH RECURSIVE t(name, text) AS (VALUES {_VALUES}), tw AS (SELECT name, {_WORDS("text")} AS w FROM t), tb AS (SELECT DISTINCT name, w[i] || ' ' || w[i + 1] AS b FROM tw, unnest(range(1, len(w))) u(i)), tn AS (SELECT name, count(*) AS n FROM tb GROUP BY name),
l AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
s AS (SELECT r, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM l),
x AS (SELECT r, k, unnest({_WORDS("line")}) AS w, generate_subscripts({_WORDS("line")}, 1) AS i FROM s),
y AS (SELECT r, k AS a, w, lead(k) OVER o AS z, lead(w) OVER o AS v FROM x WINDOW o AS (PARTITION BY r ORDER BY k, i)),
b AS (SELECT r, a, z, w || ' ' || v AS b FROM y WHERE v IS NOT NULL),
h AS (SELECT r, name, a, z, b FROM b JOIN tb USING (b)),
near AS (SELECT r, name, any_value(n) AS n FROM h JOIN tn USING (name) GROUP BY r, name HAVING count(DISTINCT b) >= {THRESHOLD} / 2 * (any_value(n) + any_value(n) * {THRESHOLD} / (2 - {THRESHOLD})) - 1e-9),
p AS (SELECT DISTINCT near.r, near.name, near.n, h.a, e.z FROM near JOIN h USING (r, name) JOIN h e ON e.r = near.r AND e.name = near.name AND e.z >= h.a),
m AS (SELECT p.r, p.name, p.n, p.a, p.z, count(DISTINCT b.b) AS size, count(DISTINCT tb.b) AS shared FROM p JOIN b ON b.r = p.r AND b.a >= p.a AND b.z <= p.z LEFT JOIN tb ON tb.name = p.name AND tb.b = b.b GROUP BY ALL),
d AS (SELECT r, a, z, name, 2.0 * shared / (size + n) AS dice FROM m WHERE 2.0 * shared / (size + n) >= {THRESHOLD}),
c AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY dice DESC, z - a, a, name) AS i FROM d),
g AS (SELECT DISTINCT r, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(a BIGINT, z BIGINT, name VARCHAR, dice DOUBLE)[]) AS kept FROM c
UNION ALL SELECT c.r, c.i, CASE WHEN len(list_filter(kept, lambda o: NOT (c.z < o.a OR o.z < c.a))) > 0 THEN kept ELSE list_append(kept, {{'a': c.a, 'z': c.z, 'name': c.name, 'dice': CAST(c.dice AS DOUBLE)}}) END FROM g JOIN c ON c.r = g.r AND c.i = g.i + 1),
f AS (SELECT r, arg_max(kept, i) AS kept FROM g GROUP BY r), q AS (SELECT r, unnest(kept) AS o FROM f),
told AS (SELECT r, count(*) AS n, max(o.dice) AS dice, string_agg(o.a || '-' || o.z || ':' || o.name, ',' ORDER BY o.a) AS told FROM q GROUP BY r)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, coalesce(n, 0) AS n_licenses, CAST(coalesce(dice, 0.0) AS DOUBLE) AS best_dice, coalesce(told, '') AS licenses FROM l LEFT JOIN told USING (r)
"""
}
