"""License scans: phrase places and an exact set-similarity join of text blocks with templates.

Blocks are lines, paragraphs (lines up to one without words) and, as notices are wrapped
over lines, the words on both sides of each line break, for each short template as many
as it can have there. Short templates are notices, which lines and
breaks are compared with; long ones are whole paragraphs of license texts, which lines
and paragraphs are compared with, so that the common words of a long paragraph don't
pass for a notice. A text is cut into blocks only if it has enough of some template as a
whole, since its blocks can't have more. The tokens of the templates are ordered by their frequency in the
whole corpus, rarest first. A block that holds at least the share THRESHOLD of a
template's tokens must hold one of the template's first n - ceil(THRESHOLD * n) + 1
tokens in that order (prefix filter), must have ceil(THRESHOLD * n) template words at
least (length filter), and where such a token is at place i of the template and place j
of the block's ordered template words, min(i, j) before it and min(n - i, m - j) from it
on must suffice (positional filter). What passes is verified on the full sets, so the
join is exact. DataFrame functions only.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import Scratch

#: phrase, label; a place is where the words stand one after the other.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: label, wording; notices and short forms of public licenses.
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "released under the bsd license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4.0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4.0"),
    ("cc-by-4.0", "licensed under cc by 4.0"),
    ("cc0", "cc0 1.0 universal public domain dedication"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: label, wording; paragraphs of public license texts.
PARAGRAPHS = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
)
THRESHOLD = 0.8
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAPS_IN_LINE = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _count_words(spaced: Column) -> Column:
    return F.when(spaced == "  ", 0).otherwise(F.char_length(spaced) - F.char_length(F.replace(spaced, F.lit(" "), F.lit(""))) - 1).cast("long")


def _places(spaced: Column, phrase: str) -> Column:
    """The number of the word at which each place of the phrase starts."""
    found, words = f" {'  '.join(phrase.split())} ", phrase.count(" ") + 1
    # each word gets two spaces of its own, so that places may follow one another; a cut is left before each place's words
    doubled = F.replace(spaced, F.lit(" "), F.lit("  "))
    pieces = F.split(F.replace(doubled, F.lit(found), F.lit(f"\x01{'  ' * words}")), "\x01")
    spaces = lambda p: F.char_length(p) - F.char_length(F.replace(p, F.lit(" "), F.lit("")))
    sums = F.aggregate(
        F.slice(pieces, 1, F.size(pieces) - 1),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, p: F.struct((acc["at"] + spaces(p)).alias("at"), F.concat(acc["out"], F.array(((acc["at"] + spaces(p) - 1) / 2).cast("int"))).alias("out")),
    )
    found = f" {phrase} "
    return F.when(F.instr(spaced, found) > 0, sums["out"]).otherwise(F.array().cast("array<int>"))


def _distinct_words(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)))


def _template_rows() -> list[tuple[int, str, list[str], int]]:
    """Number, label, distinct words, and how many words a notice has on one side of a line break at most (-1: a paragraph)."""
    notices = [(label, _distinct_words(text), len(re.findall(r"[^ .]+", text)) - 1) for label, text in NOTICES]
    return [(k, *t) for k, t in enumerate([*notices, *((label, _distinct_words(text), -1) for label, text in PARAGRAPHS)])]


def least(n: int) -> int:
    return math.ceil(THRESHOLD * n - 1e-9)


#: What a block is compared with: all templates, long ones, or (from 1 on) the notices that reach so far around a break.
_LINE, _PARAGRAPH = 0, -1


def _normal(text: Column) -> Column:
    """Lower case, one space between words, lines without spaces at their ends, nothing empty at either end."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(text, _UPPER, _LOWER), _GAPS_IN_LINE, " "), " *\n *", "\n"), F.lit(" \n"))


def _blocks(normal: Column, vocabulary: list[str], rows: list[tuple[int, str, list[str], int]]) -> Column:
    """array<struct<kind, words>>: template words, in order of the text, of each block with as many as any template needs."""
    own = lambda ws: F.array_distinct(F.filter(ws, lambda w: w.isin(vocabulary)))
    short = min(least(len(ws)) for _, _, ws, around in rows if around > 0)
    long = min(least(len(ws)) for _, _, ws, around in rows if around < 0)
    reach = sorted({around for *_, around in rows if around > 0})
    block = lambda kind, ws: F.struct((F.lit(kind) if isinstance(kind, int) else kind).alias("kind"), ws.alias("words"))
    many = lambda bs: F.filter(bs, lambda b: F.size(b["words"]) >= F.when(b["kind"] == _PARAGRAPH, long).otherwise(short))
    lines = lambda p: F.transform(F.split(p, "\n"), lambda x: block(_LINE, own(F.split(x, " "))))
    # a word before a break ends with a line feed; it goes after the few words are cut out, as a lambda computes anew what it names
    near = lambda ws, i, n: F.transform(F.slice(ws, F.greatest(i - (n - 1), F.lit(1)), F.least(i, F.lit(n) if isinstance(n, int) else n) + n), lambda w: F.rtrim(w, F.lit("\n")))

    def around(p: Column) -> Column:
        def at(ws: Column) -> Column:
            breaks = F.filter(F.sequence(F.lit(1), F.size(ws)), lambda i: F.endswith(F.element_at(ws, i), F.lit("\n")))
            close = F.filter(breaks, lambda i: F.size(own(near(ws, i, reach[-1]))) >= short)
            return F.flatten(F.transform(close, lambda i: F.transform(F.array(*map(F.lit, reach)), lambda n: block(n, own(near(ws, i, n))))))

        return F.flatten(F.transform(F.array(F.split(F.replace(p, F.lit("\n"), F.lit("\n ")), " ")), at))

    def of(p: Column) -> Column:
        single = many(lines(p))
        return F.when(F.contains(p, F.lit("\n")), F.concat(single, many(F.array(block(_PARAGRAPH, own(F.split(p, "[ \n]"))))))).otherwise(single)

    held = F.flatten(F.filter(F.transform(F.split(normal, "\n\n+"), of), lambda bs: F.size(bs) > 0))
    return F.when(F.contains(normal, F.lit("\n")), F.concat(held, many(around(F.regexp_replace(normal, "\n+", "\n"))))).otherwise(held)


def _may_hold(own: Column, rows: list[tuple[int, str, list[str], int]]) -> Column:
    """Whether a text with these template words has enough of any template: its blocks can't have more."""
    return reduce(Column.__or__, [F.size(F.array_intersect(own, F.array(*map(F.lit, ws)))) >= least(len(ws)) for _, _, ws, _ in rows])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License labels of each document, one output row per input row.

    Null text counts as empty; repeated rows are repeated; other columns are ignored.
    Result: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    where score is the highest containment of a template in a block, 1 for base places, else 0.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "licenses")
    rows = _template_rows()
    vocabulary = sorted({w for _, _, ws, _ in rows for w in ws})

    text = F.coalesce(docs[text_col], F.lit(""))
    spaced = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), _GAPS, " ")), F.lit(" "))
    src = docs.select(docs[id_col].alias("_id"), text.alias("_text"), spaced.alias("_spaced"))
    src = src.select("*", F.array_distinct(F.filter(F.split("_spaced", " "), lambda w: w.isin(vocabulary))).alias("_own"))
    # texts are read once; row numbers are written with what was found, so that later stages and lost executors see the same ones
    blocks = F.when(_may_hold(F.col("_own"), rows), _blocks(_normal(F.col("_text")), vocabulary, rows))
    read = src.select("_id", "_own", _count_words(F.col("_spaced")).alias("n_words"), *[_places(F.col("_spaced"), p).alias(f"_p{k}") for k, (p, _) in enumerate(PHRASES)], blocks.alias("_blocks"))
    read = scratch.table(read.withColumn("_row", F.monotonically_increasing_id()), "read")

    # corpus frequency: the number of texts that hold the token
    counts = read.select(F.explode("_own").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    order = {r.token: (r.n, r.token) for r in counts.collect()}  # at most one row for each template word
    each = read.where(F.size("_blocks") > 0).select("_row", F.explode("_blocks").alias("_b")).select("_row", F.col("_b.kind").alias("_kind"), F.col("_b.words").alias("_words"))
    by_rank = sorted(vocabulary, key=lambda w: order.get(w, (0, w)))
    rank = {w: k for k, w in enumerate(by_rank)}
    prefixes = []
    for k, _, ws, around in rows:
        first = sorted(ws, key=rank.__getitem__)[: len(ws) - least(len(ws)) + 1]
        prefixes += [(k, around, len(ws), least(len(ws)), pos, w) for pos, w in enumerate(first)]
    prefix = spark.createDataFrame(prefixes, "template int, around int, n int, need int, i int, token string")
    templates = spark.createDataFrame([r[:3] for r in rows], "template int, label string, tokens array<string>")

    # F.broadcast: the templates are a constant of this module, about a thousand tokens
    ordered = each.select("_row", "_kind", F.array_intersect(F.array(*map(F.lit, by_rank)), "_words").alias("_words"))
    hits = ordered.select("_row", "_kind", "_words", F.posexplode("_words").alias("j", "token")).join(F.broadcast(prefix), "token")
    fits = F.when(F.col("_kind") == _LINE, True).when(F.col("_kind") == _PARAGRAPH, F.col("around") < 0).otherwise(F.col("around") == F.col("_kind"))
    m = F.size("_words")
    hits = hits.where(fits & (m >= F.col("need")) & (F.least("i", "j") + F.least(F.col("n") - F.col("i"), m - F.col("j")) >= F.col("need")))
    verified = hits.join(F.broadcast(templates), "template").select("_row", "label", "n", "need", F.size(F.array_intersect("_words", "tokens")).alias("both"))
    verified = verified.where("both >= need")
    per_row = verified.groupBy("_row").agg(F.collect_set("label").alias("_labels"), F.max(F.col("both") / F.col("n")).alias("_score"))

    every = F.concat(*[f"_p{k}" for k in range(len(PHRASES))])
    named = F.array_compact(F.array(*[F.when(F.size(f"_p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)]))
    out = read.drop("_blocks", "_own").join(per_row, "_row", "left")
    return out.select(
        F.col("_id").alias("doc_id"),
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(named)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(named, F.coalesce("_labels", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size(every) > 0, 1.0).otherwise(F.coalesce("_score", F.lit(0.0))).alias("score"),
    )


def oracle(table: str = "documents") -> str:
    """The same in DuckDB SQL, without the filters."""
    words = lambda x: rf"regexp_extract_all(translate({x}, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    places = " UNION ALL ".join(
        f"SELECT row_no, i, '{label}' AS label FROM (SELECT row_no, w, unnest(range(1, len(w) - {len(p.split()) - 2})) AS i FROM d) WHERE " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split())) for p, label in PHRASES
    )
    values = ", ".join(f"({k}, '{label}', {around}, {ws!r})" for k, label, ws, around in _template_rows())
    reach = sorted({around for *_, around in _template_rows() if around > 0})
    return rf"""
WITH t AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS txt FROM {table}),
d AS (SELECT row_no, doc_id, {words("txt")} AS w FROM t),
p AS ({places}),
b AS (SELECT row_no, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, list(DISTINCT label) AS ls FROM p GROUP BY row_no),
m(template, label, around, tokens) AS (VALUES {values}),
z AS (SELECT row_no, trim(regexp_replace(regexp_replace(translate(txt, '{_UPPER}', '{_LOWER}'), '{_GAPS_IN_LINE}', ' ', 'g'), ' *\n *', chr(10), 'g'), ' ' || chr(10)) AS x FROM t),
q AS (SELECT row_no, unnest(regexp_split_to_array(x, '\n\n+')) AS par FROM z),
r AS (SELECT row_no, string_split(regexp_replace(x, '\n+', chr(10) || ' ', 'g'), ' ') AS ws FROM z WHERE contains(x, chr(10))),
o AS (SELECT row_no, ws, unnest(range(1, len(ws) + 1)) AS i FROM r),
k AS (SELECT row_no, 0 AS kind, string_split(unnest(string_split(par, chr(10))), ' ') AS bw FROM q
  UNION ALL SELECT row_no, -1, regexp_split_to_array(par, '[ \n]') FROM q WHERE contains(par, chr(10))
  UNION ALL SELECT row_no, n, list_transform(ws[greatest(i - n + 1, 1):i + n], lambda w: rtrim(w, chr(10))) FROM o, (SELECT unnest({reach}) AS n) WHERE ends_with(ws[i], chr(10))),
v AS (SELECT row_no, list(DISTINCT label) AS ls, max(len(list_intersect(tokens, bw)) / len(tokens)) AS score FROM k, m
  WHERE (kind = 0 OR kind = -1 AND around < 0 OR kind = around AND around > 0) AND len(list_intersect(tokens, bw)) >= ceil({THRESHOLD} * len(tokens) - 1e-9) GROUP BY row_no)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(b.ls, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.ls, []), coalesce(v.ls, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(score, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN b USING (row_no) LEFT JOIN v USING (row_no)"""
