"""Licence scans: an exact set-similarity join of text blocks with licence templates, with DataFrame functions only.

A token is two words that follow each other, so word order counts. Templates are of any length; those of up to 8, 16, 32, ...
words share blocks of twice as many words, a new one every so many, so a template in the text lies wholly in some block. A
template of n different tokens is met by a block that holds at least ceil(threshold * n) of them. Tokens are ordered by how
often they occur in the whole corpus, rarest first (tokens of no template can never be shared and are left out); then any
matching pair shares a token of both prefixes (prefix filter), the block has enough tokens (length filter), and the tokens
after the first shared one suffice (position filter). Survivors are verified by their full intersection, so no block above
the threshold is missed.

The text is normalised and searched once; what is kept is the places of template tokens. Only blocks with a token of some
template's prefix are looked at. Templates are a bounded parameter: their tokens, counts and prefixes are small whatever the
corpus. A text is worked on in pieces of at least PIECE words, so the time grows with its length.

Null text is empty; rows are scanned one by one, so ids may repeat or be missing. An empty table gives no rows. Extra columns
are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.shared import materialise

#: Phrases whose places are counted, with their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Public licences and common notices, with labels.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("bsd-3-clause", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("cc-by", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc-by", "licensed under cc by 4.0"),
    ("cc-by-nc", "licensed under cc by nc 4.0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4.0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "licensed under the gnu general public license"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
THRESHOLD = 0.8
SHORTEST = 8  # words of the smallest class of templates
PIECE = 4096
STEP = 64  # words between marks in a piece
MOST_TOKENS = 20_000  # of all templates together


def normal(text: str = "text") -> Column:
    """Words of a text, A-Z lower-cased, joined by one space.

    lower() maps two characters beyond ASCII to ASCII letters; they are first made another letter beyond ASCII.
    """
    kept = F.translate(F.coalesce(F.col(text), F.lit("")), "Kİ", "éé")
    return F.trim(F.regexp_replace(F.lower(kept), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]++", " "))


def split_words(joined: Column) -> Column:
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, " "))


def bind(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often it is used."""
    return F.transform(F.array(value), body)[0]


def plain_words(text: str) -> list[str]:
    """The words of a template, as of a text."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return "".join(c if ord(c) > 127 or c in "0123456789abcdefghijklmnopqrstuvwxyz" else " " for c in lower).split(" ")


def _starts(w: Column, joined: Column, phrase: str) -> Column:
    parts = phrase.split()
    here = lambda i: reduce(lambda a, b: a & b, [F.get(w, i + k) == p for k, p in enumerate(parts)])
    seek = F.filter(F.sequence(F.lit(0), F.size(w) - 1), here)
    return F.when(F.contains(F.concat(F.lit(" "), joined, F.lit(" ")), F.lit(f" {phrase} ")), seek).otherwise(F.array().cast("array<int>"))


class Templates:
    """Templates as sets of token numbers, and the classes of their lengths."""

    def __init__(self, templates: Sequence[tuple[str, str]], threshold: float) -> None:
        listed = [(label, [w for w in plain_words(text) if w]) for label, text in templates]
        if any(len(words) < 2 for _, words in listed):
            raise ValueError("a template needs two words or more")
        pairs = [list(zip(words, words[1:], strict=False)) for _, words in listed]
        self.tokens = sorted({p for ps in pairs for p in ps})
        if len(self.tokens) > MOST_TOKENS:
            raise ValueError(f"the templates hold {len(self.tokens)} different tokens; at most {MOST_TOKENS} are allowed")
        number = {t: i for i, t in enumerate(self.tokens)}
        self.labels = [label for label, _ in listed]
        self.sets = [sorted({number[p] for p in ps}) for ps in pairs]
        self.need = [math.ceil(threshold * len(s) - 1e-9) for s in self.sets]
        self.classes = [max(SHORTEST, 1 << (len(words) - 1).bit_length()) for _, words in listed]
        self.piece = max(PIECE, 2 * max(self.classes, default=0))
        self.overlap = 2 * max(self.classes, default=0)
        self.buckets = 1 << max(1, 2 * len(self.tokens)).bit_length()

    def number_of(self, token: Column) -> Column:
        """The token's number, null for others: a hash table in a constant."""
        table: list[list[str]] = [[] for _ in range(self.buckets)]
        for i, (a, b) in enumerate(self.tokens):
            table[zlib.crc32(f"{a} {b}".encode()) % self.buckets].append(f"named_struct('t', '{a} {b}', 'i', {i})")
        cells = ", ".join(f"array({', '.join(cell)})" for cell in table)
        found = F.filter(F.get(F.expr(f"array({cells})"), (F.crc32(token) % self.buckets).cast("int")), lambda e: e["t"] == token)
        return F.get(found, F.lit(0))["i"]

    def hits(self, words: Column) -> Column:
        """array<struct<pos, id>>: the template tokens among words, in order."""
        firsts = sorted({a for a, _ in self.tokens})
        token = lambda w, i: F.when(w.isin(firsts), F.struct(i.alias("pos"), self.number_of(F.concat(w, F.lit(" "), F.get(words, i + 1))).alias("id")))
        return F.filter(F.transform(words, token), lambda h: h["id"].isNotNull())


def token_places(docs: DataFrame, templates: Templates, phrases: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """doc_id, n_words, at (for each phrase the places of its first words), pieces (for each the template tokens and their places in it)."""
    def row(joined: Column) -> Column:
        def found(w: Column) -> Column:
            starts = F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(templates.piece))
            part = lambda s: bind(F.slice(w, s + 1, F.lit(templates.piece + templates.overlap)), templates.hits)
            pieces = F.filter(F.transform(starts, part), lambda p: F.size(p) > 0) if templates.tokens else F.array().cast("array<array<struct<pos:int,id:int>>>")
            return F.struct(F.size(w).cast("long").alias("n_words"), F.array(*[_starts(w, joined, p) for p, _ in phrases]).cast("array<array<int>>").alias("at"), pieces.alias("pieces"))

        return bind(split_words(joined), found)

    return docs.select("doc_id", bind(normal(), row).alias("found")).select("doc_id", "found.*")


class Index:
    """Templates with their tokens in global order, rarest first."""

    def __init__(self, templates: Templates, counts: dict[int, int]) -> None:
        order = sorted(range(len(templates.tokens)), key=lambda t: (counts.get(t, 0), t))
        self.rank = [0] * len(order)
        for r, t in enumerate(order):
            self.rank[t] = r
        sets = [sorted(self.rank[t] for t in s) for s in templates.sets]
        self.prefixes = [
            (c, r, k, label, p, need, own)
            for k, (label, own, need, c) in enumerate(zip(templates.labels, sets, templates.need, templates.classes, strict=True))
            for p, r in enumerate(own[: len(own) - need + 1])
        ]


def licence_blocks(places: DataFrame, templates: Templates, index: Index) -> DataFrame:
    """number, template, label, containment of each pair of a block and a template above the threshold."""
    spark = places.sparkSession
    prefix = spark.createDataFrame(index.prefixes, "words int, rank int, template int, label string, t_pos int, need int, t_ranks array<int>")
    rank_of = F.expr(f"array({', '.join(map(str, index.rank))})")
    pieces = places.select("number", F.explode("pieces").alias("hits"))
    ranked = pieces.select("number", F.transform("hits", lambda h: F.struct(h["pos"].alias("pos"), F.get(rank_of, h["id"]).alias("rank"))).alias("hits"))
    classes = sorted(set(templates.classes))
    rare = {c: sorted({r for words, r, *_ in index.prefixes if words == c}) for c in classes}
    ranked = ranked.where(F.exists("hits", lambda h: h["rank"].isin(sorted(set().union(*rare.values())))))
    # how many hits stand before every STEP-th word, so that a block's are found without a search
    total = templates.piece + templates.overlap
    counted = ranked.select("number", "hits", F.transform(F.sequence(F.lit(0), F.lit(total), F.lit(STEP)), lambda s: F.size(F.filter("hits", lambda h: h["pos"] < s))).alias("marks"))

    def blocks(c: int) -> Column:
        near = F.filter("hits", lambda h: h["rank"].isin(rare[c]))
        starts = F.array_distinct(F.flatten(F.transform(near, lambda h: F.array((F.floor(h["pos"] / c) * c).cast("int"), (F.floor(h["pos"] / c) * c - c).cast("int")))))

        def block(s: Column) -> Column:
            low, high = F.get("marks", F.floor(s / STEP).cast("int")), F.get("marks", F.least(F.ceil((s + 2 * c) / STEP), F.lit(total // STEP)).cast("int"))
            own = F.filter(F.slice("hits", low + 1, high - low), lambda h: (h["pos"] >= s) & (h["pos"] < s + 2 * c - 1))
            return F.struct(F.lit(c).alias("words"), F.array_sort(F.array_distinct(F.transform(own, lambda h: h["rank"]))).alias("ranks"))

        return F.transform(F.filter(starts, lambda s: (s >= 0) & (s < templates.piece)), block)

    least = min(templates.need, default=1)
    found = counted.select("number", F.explode(F.concat(*[blocks(c) for c in classes])).alias("b")).select("number", "b.*").where(F.size("ranks") >= least)
    shared = found.select("*", F.posexplode("ranks").alias("pos", "rank")).join(F.broadcast(prefix), ["words", "rank"])  # the bounded templates
    fits = (F.size("ranks") >= F.col("need")) & (1 + F.least(F.size("ranks") - F.col("pos") - 1, F.size("t_ranks") - F.col("t_pos") - 1) >= F.col("need"))
    first = ~F.arrays_overlap(F.slice("ranks", 1, F.col("pos")), F.slice("t_ranks", 1, F.col("t_pos")))
    overlap = F.size(F.array_intersect("ranks", "t_ranks"))
    verified = shared.where(fits & first).select("number", "template", "label", "need", overlap.alias("overlap"), (overlap / F.size("t_ranks")).alias("containment"))
    return verified.where(F.col("overlap") >= F.col("need")).drop("overlap", "need")


def scan_licences(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, phrases: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs (doc_id, text).

    score: the largest containment found; a phrase found in full counts 1.
    """
    known = Templates(templates, threshold)
    places = materialise(token_places(docs, known, phrases).withColumn("number", F.monotonically_increasing_id()), "licences")
    both = places.withColumn("more", F.array().cast("array<string>")).withColumn("best", F.lit(0.0))
    if known.tokens:
        seen = places.select(F.explode("pieces").alias("p")).select(F.explode("p").alias("h")).where(F.col("h.pos") < known.piece).groupBy("h.id").count()
        index = Index(known, {r["id"]: r["count"] for r in seen.collect()})  # one number for each token of the templates
        met = licence_blocks(places, known, index).groupBy("number").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
        both = places.drop("pieces").join(met, "number", "left")
    at = F.flatten("at")
    own = F.array_compact(F.array(*[F.when(F.size(F.col("at")[i]) > 0, F.lit(label)) for i, (_, label) in enumerate(phrases)]).cast("array<string>"))
    score = F.when(F.size(at) > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    join = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return both.select(
        "doc_id", "n_words", F.size(at).cast("long").alias("n_base"), F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
        join(own).alias("base_labels"), join(F.concat(own, F.coalesce("more", F.array().cast("array<string>")))).alias("labels"), score.alias("score"),
    )


def oracle(templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, phrases: Sequence[tuple[str, str]] = PHRASES) -> str:
    """DuckDB SQL for scan_licences: every block against every template."""
    known = Templates(templates, threshold)
    listed = ", ".join(f"('{label}', {c}, {[' '.join(known.tokens[t]) for t in own]!r}, {need})" for label, c, own, need in zip(known.labels, known.classes, known.sets, known.need, strict=True))
    named = ", ".join(f"('{label}', {phrase.split()!r})" for phrase, label in phrases)
    return rf"""
WITH split AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
templates(label, size, own, need) AS (VALUES {listed}),
phrases(label, parts) AS (VALUES {named}),
places AS (
  SELECT row, label, unnest(list_filter(range(len(words)), lambda i: words[i + 1 : i + len(parts)] = parts)) AS place FROM split, phrases),
pairs AS (SELECT row, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) AS tokens FROM split),
blocks AS (SELECT row, size, tokens[s + 1 : s + 2 * size - 1] AS block FROM pairs, (SELECT DISTINCT size FROM templates), unnest(range(0, len(tokens), size)) AS t(s)),
met AS (
  SELECT row, label, len(list_intersect(block, own)) / CAST(len(own) AS DOUBLE) AS containment FROM blocks JOIN templates USING (size) WHERE len(list_intersect(block, own)) >= need),
base AS (SELECT row, count(*) AS n, min(place) AS first, max(place) AS last, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY row),
more AS (SELECT row, max(containment) AS best FROM met GROUP BY row),
named AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT row, label FROM met UNION SELECT row, label FROM places) GROUP BY row)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, CAST(b.first AS BIGINT) AS first_word, CAST(b.last AS BIGINT) AS last_word, coalesce(b.labels, '') AS base_labels,
       coalesce(n.labels, '') AS labels, CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(m.best, 0.0) END AS score
FROM split LEFT JOIN base b USING (row) LEFT JOIN more m USING (row) LEFT JOIN named n USING (row)
"""
