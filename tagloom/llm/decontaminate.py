"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A mask keeps some word positions of a window and ignores the others. The hashes of all
windows of all texts are joined with those of the test items; around each hit the item is
laid over the text, and the best run of 13 positions (all, in shorter items) must agree
in at least 80 % of its words. The masks together hit every such run with every choice
of substituted positions, so nothing that would be verified is missed: three masks of
five words for items of nine words or more, four of four words for items of five to
eight. Of fewer words no substitution leaves 80 %, and every text has them in passing:
such items match where they are a whole line, found by a join of line hashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import Scratch

#: Kept positions of each mask, and the least words of the items that it serves.
MASKS = ((0, 1, 2, 3, 5), (0, 1, 2, 4, 6), (0, 2, 5, 6, 7))
SHORT_MASKS = ((0, 1, 2, 3), (0, 2, 3, 4), (0, 1, 3, 4), (0, 1, 2, 4))
SEEDED, SHORT = 9, 5
#: Positions of the run that is verified, and the share that must agree.
RUN, AGREE = 13, 0.8
#: Characters of all test items up to which their seeds are broadcast; beyond, the seeds are joined by shuffle.
BROADCAST_CHARS = 8 << 20
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    cut = F.split(F.trim(F.regexp_replace(F.lower(text), _GAPS, " ")), " ")
    return F.transform(F.filter(cut, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seed(words: Column, at: Column, mask: tuple[int, ...]) -> Column:
    """The hash of a mask's kept words; null where the window goes over the end."""
    picked = [F.get(words, at + o) for o in mask]
    return F.when(picked[-1].isNotNull(), F.xxhash64(F.array(*map(F.lit, mask)), *picked))


def _seeds(rows: DataFrame, words: str, masks: tuple[tuple[int, ...], ...], *keep: str) -> DataFrame:
    at = rows.select(*keep, words, F.posexplode(words).alias("_pos", "_w"))
    return at.select(*keep, words, "_pos", F.explode(F.array(*[_seed(F.col(words), F.col("_pos"), m) for m in masks])).alias("_seed")).where(F.col("_seed").isNotNull())


def _whole_lines(src: DataFrame, items: DataFrame, small: bool) -> DataFrame:
    """Items of fewer than SHORT words where they are a whole line: _id, _th, _item, _start, _n, _best, _all."""
    tiny = items.where(F.size("_iw") < SHORT).select("_item", F.xxhash64("_iw").alias("_h"), F.col("_iw").alias("_t"))
    lines = src.select("_id", "_th", F.split("_text", "\n").alias("_lines"))
    each = lines.select("_id", "_th", "_lines", F.posexplode("_lines").alias("_k", "_line")).withColumn("_lw", _words(F.col("_line")))
    each = each.where(F.size("_lw").between(1, SHORT - 1)).withColumn("_h", F.xxhash64("_lw"))
    hit = each.join(F.broadcast(tiny) if small else tiny, "_h").where("_lw = _t")
    before = F.when(F.col("_k") > 0, F.size(_words(F.array_join(F.slice("_lines", 1, F.greatest("_k", F.lit(1))), "\n")))).otherwise(0)
    n = F.size("_t")
    return hit.select("_id", "_th", "_item", before.alias("_start"), n.alias("_n"), n.alias("_best"), n.alias("_all"))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs of a document and a test item that it holds: doc_id, text_hash, item_id, start_word, matched, agreed, n_words.

    start_word is the word of the document at which the item's first word would stand (it
    may be negative), matched the agreeing words of the best run, agreed those of the whole
    item. Null texts hold nothing; repeated documents give the same pair once; repeated
    items give a pair for each item id; other columns are ignored.
    """
    items = benchmark.select(F.col(item_col).alias("_item"), _words(F.coalesce(F.col(item_text), F.lit(""))).alias("_iw"), F.char_length(item_text).alias("_chars")).where(F.size("_iw") > 0)
    n = F.size("_iw")
    has = items.agg(F.coalesce(F.sum("_chars"), F.lit(0)).alias("chars"), F.count(F.when(n < SHORT, 1)).alias("tiny"), F.count(F.when(n.between(SHORT, SEEDED - 1), 1)).alias("short")).first()
    items = items.select("_item", "_iw").distinct()
    # masks of a length that no item has find nothing, so texts are not hashed with them
    families = [(MASKS, n >= SEEDED)] + ([(SHORT_MASKS, n.between(SHORT, SEEDED - 1))] if has.short else [])
    seeds = reduce(DataFrame.unionByName, [_seeds(items.where(fits), "_iw", masks, "_item") for masks, fits in families])
    seeds = seeds.select("_item", "_iw", F.col("_pos").alias("_ipos"), "_seed")
    masks = sum((m for m, _ in families), ())
    small = has.chars <= BROADCAST_CHARS
    src = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = src.select("_id", "_th", _words(F.col("_text")).alias("_dw"))
    if small:
        hits = _seeds(rows, "_dw", masks, "_id", "_th").join(F.broadcast(seeds.select("_item", "_ipos", "_seed", F.size("_iw").alias("_n"))), "_seed")
        # the stretch of the document under the item, from the first position that both have
        hits = hits.select("_id", "_th", "_item", (F.col("_pos") - F.col("_ipos")).alias("_start"), "_n", "_dw")
        laid = hits.select("_id", "_th", "_item", "_start", F.slice("_dw", F.greatest("_start", F.lit(0)) + 1, F.col("_n") + F.least("_start", F.lit(0))).alias("_under")).distinct()
    else:
        hits = _seeds(rows, "_dw", masks, "_id", "_th").select("_id", "_th", "_pos", "_seed").join(seeds.select("_item", "_ipos", "_seed", F.size("_iw").alias("_n")), "_seed")
        hits = hits.select("_id", "_th", "_item", (F.col("_pos") - F.col("_ipos")).alias("_start"), "_n").distinct()
        laid = hits.join(rows.dropDuplicates(["_id", "_th"]), (rows["_id"].eqNullSafe(hits["_id"])) & (rows["_th"] == hits["_th"])).select(
            hits["_id"], hits["_th"], "_item", "_start", F.slice("_dw", F.greatest("_start", F.lit(0)) + 1, F.col("_n") + F.least("_start", F.lit(0))).alias("_under")
        )
    over = items.groupBy("_item", "_iw").count().drop("count")
    laid = laid.join(F.broadcast(over) if small else over, "_item")
    run = F.least(F.lit(RUN), n)
    need = F.ceil(run * F.lit(AGREE) - 1e-9)
    # where the item starts before the document's first word, get() is null at negative places
    same = F.transform("_iw", lambda w, k: F.coalesce(F.get("_under", k + F.least("_start", F.lit(0))) == w, F.lit(False)).cast("int"))
    flagged = laid.select("_id", "_th", "_item", "_start", n.alias("_n"), run.alias("_run"), need.alias("_need"), same.alias("_same"))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.col("_n") - F.col("_run") + 1), lambda k: F.aggregate(F.slice("_same", k, F.col("_run")), F.lit(0), lambda a, x: a + x)))
    found = flagged.select("_id", "_th", "_item", "_start", "_n", "_need", best.alias("_best"), F.aggregate("_same", F.lit(0), lambda a, x: a + x).alias("_all")).where(F.col("_best") >= F.col("_need")).drop("_need")
    if has.tiny:
        found = found.unionByName(_whole_lines(src, items, small))
    top = found.groupBy("_id", "_th", "_item").agg(F.max(F.struct("_best", "_all", (-F.col("_start")).alias("_back"))).alias("_m"), F.max("_n").alias("_n"))
    return top.select(F.col("_id").alias("doc_id"), F.col("_th").alias("text_hash"), F.col("_item").alias("item_id"), (-F.col("_m._back")).cast("long").alias("start_word"), F.col("_m._best").cast("long").alias("matched"), F.col("_m._all").cast("long").alias("agreed"), F.col("_n").cast("long").alias("n_words"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no test item; all their columns."""
    held = Scratch(docs.sparkSession, "decontaminate").table(overlaps(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th")).distinct(), "held")
    return docs.join(held, docs["doc_id"].eqNullSafe(held["_id"]) & (F.xxhash64(docs["text"]) == held["_th"]), "left_anti")


def oracle(docs: str = "documents", items: str = "benchmark") -> str:
    """The same in DuckDB SQL, with the seeds as strings."""
    words = lambda x: rf"list_filter(string_split(trim(regexp_replace(lower({x}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')), ' '), lambda w: w <> '')"
    seeds = lambda t, w, least: " UNION ALL ".join(f"SELECT *, '{mask}' || concat_ws(' ', {', '.join(f'{w}[p + {o + 1}]' for o in mask)}) AS seed FROM {t} WHERE p + {mask[-1] + 1} <= len({w}){least[mask]}" for mask in least)
    masks = {m: f" AND len(iw) >= {SEEDED}" for m in MASKS} | {m: f" AND len(iw) BETWEEN {SHORT} AND {SEEDED - 1}" for m in SHORT_MASKS}
    return rf"""
WITH d AS (SELECT DISTINCT doc_id, text, {words("coalesce(text, '')")} AS dw FROM {docs}),
i AS (SELECT DISTINCT item_id, {words("coalesce(text, '')")} AS iw FROM {items}),
dp AS (SELECT doc_id, text, dw, unnest(range(len(dw))) AS p FROM d),
ip AS (SELECT item_id, iw, unnest(range(len(iw))) AS p FROM i),
ds AS ({seeds("dp", "dw", dict.fromkeys(masks, ""))}), s AS ({seeds("ip", "iw", masks)}),
h AS (SELECT DISTINCT doc_id, text, dw, item_id, iw, ds.p - s.p AS start FROM ds JOIN s USING (seed)),
f AS (SELECT doc_id, text, item_id, start, len(iw) AS n, least({RUN}, len(iw)) AS run, list_transform(range(len(iw)), lambda k: CASE WHEN start + k >= 0 AND dw[start + k + 1] = iw[k + 1] THEN 1 ELSE 0 END) AS same FROM h),
b AS (SELECT doc_id, text, item_id, start, n, list_max(list_transform(range(1, n - run + 2), lambda k: list_sum(same[k:k + run - 1]))) AS best, list_sum(same) AS agreed, ceil({AGREE} * run - 1e-9) AS need FROM f),
l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM d),
u AS (SELECT doc_id, text, {words("array_to_string(ls[1:k - 1], chr(10))")} AS bw, {words("ls[k]")} AS lw FROM l),
a AS (SELECT doc_id, text, item_id, start, n, best, agreed FROM b WHERE best >= need
  UNION ALL SELECT doc_id, text, item_id, len(bw), len(iw), len(iw), len(iw) FROM u JOIN i ON lw = iw WHERE len(iw) BETWEEN 1 AND {SHORT - 1})
SELECT doc_id, item_id, arg_max(start, (best, agreed, -start))::BIGINT AS start_word, max(best)::BIGINT AS matched, arg_max(agreed, (best, agreed, -start))::BIGINT AS agreed, max(n)::BIGINT AS n_words
FROM a GROUP BY doc_id, text, item_id"""
