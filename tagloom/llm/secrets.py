"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Spans are found per document by regular expressions; positions come from the lengths
of the pieces between matches. Each candidate value is hashed, and the corpus counts
the distinct owners and repositories that hold the hash: a value that many owners hold,
or that stands in many repositories of however few owners, is a copied example; one of a
single owner that isn't copied so is live-looking. Opaque tokens, which no keyword
announces, count as secrets only if they are live-looking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import Scratch


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join([*map(_either, ("password", "passwd", "secret", "token")), f"{_either('api')}_?{_either('key')}"])
ASSIGN = rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind, pattern, group that is the value, least length of the value; in the order in which equal starts are listed.
BASE = (("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]{24,}", 0, 24))
#: The method's own kinds.
ADDED = (
    ("github", r"gh[pousr]_[A-Za-z0-9]{30,}", 0, 34),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28),
    ("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 27),
    ("opaque", r"[A-Za-z0-9+/_-]{20,}", 0, 20),
)
KINDS = (*BASE, *ADDED)
#: Any text that holds a span matches this.
ANY = rf"""(?:{_KEYS})["']?\x20*[:=]|AKIA[A-Z0-9]{{16}}|-----BEGIN |[A-Za-z0-9+/_-]{{20}}|eyJ[A-Za-z0-9_-]{{8,}}\."""
#: Owners up to which a value looks live, and from which it is a copied example, as it is from so many repositories on.
LIVE_OWNERS, EXAMPLE_OWNERS, EXAMPLE_REPOS = 1, 3, 5

_SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string,hash:string>>"


def _spans(text: Column, rank: int) -> Column:
    """The spans of one kind, in order."""
    kind, pattern, group, least = KINDS[rank]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    steps = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), whole.alias("whole"), value.alias("value"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["piece"])
        end = start + F.char_length(x["whole"])
        ok = F.char_length(x["value"]) >= least
        if kind == "opaque":
            ok = ok & x["value"].rlike("[0-9]") & x["value"].rlike("[A-Z]") & x["value"].rlike("[a-z]")
        span = F.struct(start.cast("long").alias("start"), F.lit(rank).alias("rank"), end.cast("long").alias("end"), F.lit(kind).alias("kind"), F.sha2(x["value"], 256).alias("hash"))
        # the last piece has no match after it
        return F.when(ok, F.struct(end.cast("long").alias("at"), F.concat(acc["out"], F.array(span)).cast(_SPAN).alias("out"))).otherwise(F.struct(F.coalesce(end, acc["at"]).cast("long").alias("at"), acc["out"].alias("out")))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPAN).alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(steps, zero, step)["out"]).otherwise(F.array().cast(_SPAN))


def _example(s: Column) -> Column:
    return (s["owners"] >= EXAMPLE_OWNERS) | (s["repos"] >= EXAMPLE_REPOS)


def _live(s: Column) -> Column:
    return (s["owners"] <= LIVE_OWNERS) & ~_example(s)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo: Column | None = None, keep: list[str] | None = None, redacted: bool = False) -> DataFrame:
    """Secrets of each document with the ownership of their values, one output row per input row.

    Null text counts as empty. A null owner or repository is one unknown owner or
    repository. Repeated rows are repeated in the result and count once for frequency.
    `repo` is a column of the repository, by default the owner. Columns of `keep` pass
    through; others are ignored. Result: doc_id, n_assign, n_access, n_hex, base_sha256,
    spans, n_live, n_example, max_owners, max_repos, live (array of spans to act on), kept columns;
    `redacted` adds the text with those spans replaced.
    """
    spark, keep = docs.sparkSession, keep or []
    scratch = Scratch(spark, "secrets")
    text = F.coalesce(docs[text_col], F.lit(""))
    src = docs.select(
        docs[id_col].alias("_id"), text.alias("_text"), F.coalesce(docs[owner_col].cast("string"), F.lit("")).alias("_owner"), F.coalesce((docs[owner_col] if repo is None else repo).cast("string"), F.lit("")).alias("_repo"), *[docs[c].alias(f"k_{c}") for c in keep]
    )
    hit = F.col("_text").rlike(ANY)
    kept = [f"k_{c}" for c in keep]
    found = src.where(hit).select("_id", "_owner", "_repo", *kept, *(["_text"] if redacted else []), F.array_sort(F.concat(*[_spans(F.col("_text"), k) for k in range(len(KINDS))])).alias("_spans"))
    found = scratch.table(found.withColumn("_row", F.monotonically_increasing_id()), "spans")

    each = found.select("_row", "_owner", "_repo", F.explode("_spans").alias("_s")).select("_row", "_owner", "_repo", "_s", F.col("_s.hash").alias("_hash"))
    # distinct first, so that a value that a third of all rows hold is a few rows before it is counted
    stats = each.select("_hash", "_owner", "_repo").distinct().groupBy("_hash", "_owner").agg(F.count("*").alias("_repos")).groupBy("_hash").agg(F.count("*").alias("_owners"), F.sum("_repos").alias("_repos"))
    # written first, so that the value that a third of all rows hold is dealt anew where it is joined
    stats = scratch.table(stats, "stats")
    judged = each.join(stats, "_hash").select("_row", F.struct("_s.start", "_s.rank", "_s.end", "_s.kind", F.col("_owners").alias("owners"), F.col("_repos").alias("repos")).alias("_s"))
    per_row = judged.groupBy("_row").agg(F.array_sort(F.collect_list("_s")).alias("_judged"))
    full = found.join(per_row, "_row", "left")

    base = F.filter("_spans", lambda s: s["rank"] < len(BASE))
    judged_all = F.coalesce(F.col("_judged"), F.expr("array()").cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,owners:bigint,repos:bigint>>"))
    shown = F.filter(judged_all, lambda s: (s["kind"] != "opaque") | _live(s))
    count = lambda k: F.size(F.filter("_spans", lambda s: s["rank"] == k)).cast("long")
    acted = F.filter(shown, lambda s: ~_example(s))
    dirty = full.select(
        F.col("_id").alias("doc_id"),
        *[count(k).alias(f"n_{KINDS[k][0]}") for k in range(len(BASE))],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(shown).alias("spans"),
        F.size(F.filter(judged_all, _live)).cast("long").alias("n_live"),
        F.size(F.filter(judged_all, _example)).cast("long").alias("n_example"),
        F.coalesce(F.array_max(F.transform(judged_all, lambda s: s["owners"])), F.lit(0)).cast("long").alias("max_owners"),
        F.coalesce(F.array_max(F.transform(judged_all, lambda s: s["repos"])), F.lit(0)).cast("long").alias("max_repos"),
        acted.alias("live"),
        *([redact(F.col("_text"), acted).alias("redacted")] if redacted else []),
        *[F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)],
    )
    zero = F.lit(0).cast("long")
    clean = src.where(~hit).select(
        F.col("_id").alias("doc_id"), *[zero.alias(f"n_{k[0]}") for k in BASE], F.sha2(F.lit(""), 256).alias("base_sha256"), F.lit("").alias("spans"), zero.alias("n_live"), zero.alias("n_example"), zero.alias("max_owners"), zero.alias("max_repos"), F.expr("array()").cast(dirty.schema["live"].dataType).alias("live"), *([F.col("_text").alias("redacted")] if redacted else []), *[F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)]
    )
    return dirty.unionByName(clean)


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """Text with each run of overlapping spans replaced by `mark`; spans ordered by start."""

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].cast("int").alias("at"), piece.alias("out"))).otherwise(F.struct(F.greatest(acc["at"], s["end"].cast("int")).alias("at"), acc["out"].alias("out")))

    cast = F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end")))
    done = F.aggregate(cast, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    return F.when(F.size(spans) > 0, F.concat(done["out"], F.substring(text, done["at"] + 1, F.char_length(text)))).otherwise(text)


def oracle(table: str = "documents") -> str:
    """The same in DuckDB SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        more = " AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')" if kind == "opaque" else ""
        parts.append(
            f"SELECT row_no, owner, repo, s AS start, {rank} AS rank, s + length(w) AS fin, '{kind}' AS kind, sha256(v) AS hash FROM (SELECT row_no, owner, repo, unnest(list_transform(range(1, len(ws) + 1), lambda i: list_sum(list_transform(ps[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(ws[1:i - 1], lambda p: length(p))), 0)))::BIGINT AS s, unnest(ws) AS w, unnest(vs) AS v FROM (SELECT row_no, owner, repo, regexp_split_to_array(txt, {q(pattern)}) AS ps, regexp_extract_all(txt, {q(pattern)}, 0) AS ws, regexp_extract_all(txt, {q(pattern)}, {group}) AS vs FROM t WHERE regexp_matches(txt, {q(pattern)}))) WHERE length(v) >= {least}{more}"
        )
    return f"""
WITH t AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(source, '') AS owner, coalesce(source || '/' || lang, '') AS repo, coalesce(text, '') AS txt FROM {table}),
s AS ({" UNION ALL ".join(parts)}),
o AS (SELECT hash, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repo)) AS repos FROM s GROUP BY hash),
g AS (SELECT *, owners >= {EXAMPLE_OWNERS} OR repos >= {EXAMPLE_REPOS} AS example FROM o),
j AS (SELECT s.*, owners, repos, example, owners <= {LIVE_OWNERS} AND NOT example AS live FROM s JOIN g USING (hash)),
a AS (SELECT row_no,
  count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  coalesce(string_agg(kind || ':' || start || ':' || fin, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}), '') AS base,
  coalesce(string_agg(kind || ':' || start || ':' || fin, ',' ORDER BY start, rank) FILTER (kind <> 'opaque' OR live), '') AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (example) AS n_example, max(owners) AS max_owners, max(repos) AS max_repos FROM j GROUP BY row_no)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example, coalesce(max_owners, 0)::BIGINT AS max_owners, coalesce(max_repos, 0)::BIGINT AS max_repos
FROM t LEFT JOIN a USING (row_no)"""
