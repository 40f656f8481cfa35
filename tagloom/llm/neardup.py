"""MinHash near-dedup with tensored banding, verified on full shingle sets.

Two small collections of M sketches, each of R minhashes, give M * M table keys: a key
is a pair of a sketch of the first and one of the second collection. So 2 * M * R
minhashes serve M * M tables of 2 * R rows.

Texts with equal shingle sets are one class. In each table bucket every class meets the
bucket's first member in one order of all classes, so that the members of a large group
meet few others; links are confirmed on the full sets, and components grow from them. In
buckets that then hold several components, members of other components than its own meet
a member picked at random for the bucket. What is left goes through an exact
prefix-filter join: shingles that only one component has come first, then rarer ones
before frequent ones, and sets of Jaccard similarity 0.8 share one of their first fifth
in that order. So no bucket is expanded into all its pairs, and no link is lost that any
bucket holds. Two texts of similarity 0.8 share no bucket with a chance of 8e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import Scratch, arrow_map, release, texts_of

#: Sketches of a collection, minhashes of a sketch.
M, R = 10, 2
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
_MULTIPLIERS = np.random.default_rng(20240229).integers(1, 2**63, 2 * M * R, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MEMORY = 200_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _C2
    x = (x ^ x >> np.uint64(27)) * _C3
    return x ^ x >> np.uint64(31)


class Shingler:
    """Distinct word shingles of a text as sorted 64-bit hashes."""

    def __init__(self, width: int = 2):
        self.width, self.known = width, {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known, hashed = self.known, []
        for w in words:
            h = known.get(w)
            if h is None:
                if len(known) >= _MEMORY:
                    known.clear()
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            hashed.append(h)
        h = np.array(hashed, np.uint64)
        k = min(self.width, len(h))
        out = _mix(h[: len(h) - k + 1] + np.uint64(k))
        for n in range(1, k):
            out = _mix(out * _C1 + h[n : len(h) - k + 1 + n])
        return np.unique(out)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """All minhashes of a set, the upper halves of products with odd random numbers."""
    low = np.full(len(_MULTIPLIERS), 2**32 - 1, np.uint64)
    for at in range(0, len(shingles), 4096):
        low = np.minimum(low, ((shingles[at : at + 4096, None] * _MULTIPLIERS) >> np.uint64(32)).min(axis=0))
    return low.astype(np.uint32).view(np.int32)


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for b in batches:
            n, high, low, sigs = [], [], [], []
            for t in texts_of(b.column(1)):
                s = shingle(t)
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                n.append(len(s))
                high.append((d >> 64) - (1 << 63))
                low.append((d & (1 << 64) - 1) - (1 << 63))
                sigs.append(sketch(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(sigs, pa.list_(pa.int32()))], names=["doc_id", "n", "k1", "k2", "sig"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle(t).view(np.int64) for t in texts_of(b.column(1))], pa.list_(pa.int64()))], names=["id", "set"])

    return run


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, label) of every id in edges (a, b); label is the least id of its component.

    Each round gives every id the least id among itself and its neighbours as parent,
    follows parents to their roots, and contracts the edges; rounds end when no edge is left.
    """
    live = scratch.table(edges.where("a <> b").distinct(), "edges")
    labels = None
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        parent = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
        parent = scratch.table(parent, "parents")
        while True:  # follow parents; chains halve each time
            up = parent.select(F.col("id").alias("_i"), F.col("label").alias("_up"))
            jumped = scratch.table(parent.join(up, parent["label"] == up["_i"]).select("id", F.col("_up").alias("label"), (F.col("_up") != F.col("label")).alias("moved")), "parents")
            moved = not jumped.where("moved").isEmpty()
            parent = jumped.select("id", "label")
            if not moved:
                break
        if labels is None:
            labels = parent
        else:
            p = parent.select(F.col("id").alias("_i"), F.col("label").alias("_up"))
            labels = scratch.table(labels.join(p, labels["label"] == p["_i"], "left").select("id", F.coalesce("_up", "label").alias("label")), "labels")
        pa_, pb = parent.select(F.col("id").alias("_a"), F.col("label").alias("la")), parent.select(F.col("id").alias("_b"), F.col("label").alias("lb"))
        live = scratch.table(live.join(pa_, F.col("a") == F.col("_a")).join(pb, F.col("b") == F.col("_b")).where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("label")).limit(0)


def _confirmed(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    side = lambda x: nodes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"))
    likely = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT).select("a", "b")
    likely = scratch.table(likely.distinct(), f"{name}-likely")
    full = lambda x: sets.select(F.col("id").alias(x), F.col("set").alias(f"s{x}"))
    both = likely.join(full("a"), "a").join(full("b"), "b").select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("both"), (F.size("sa") + F.size("sb")).cast("long").alias("sum"))
    return scratch.table(both.where(F.col("both") * 100 >= (F.col("sum") - F.col("both")) * PERCENT).select("a", "b"), f"{name}-links")


def _grown(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels (id, label) after more links between ids."""
    if links.isEmpty():
        return labels
    up = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"l{c}"))
    between = links.join(up("a"), "a", "left").join(up("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    more = components(between, scratch).select(F.col("id").alias("_i"), F.col("label").alias("_up"))
    lifted = labels.join(more, labels["label"] == more["_i"], "left").select("id", F.coalesce("_up", "label").alias("label"))
    fresh = more.join(labels, more["_i"] == labels["id"], "left_anti").select(F.col("_i").alias("id"), F.col("_up").alias("label"))
    return scratch.table(lifted.unionByName(fresh), "labels")


def _mixed(members: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, id, comp) of the members of buckets that hold several components."""
    known = labels.select(F.col("id").alias("_i"), "label")
    placed = members.select("key", "id").join(known, members["id"] == known["_i"], "left").select("key", "id", F.coalesce("label", "id").alias("comp"))
    keys = scratch.table(placed.groupBy("key").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo <> _hi").select("key"), "mixed-keys")
    return scratch.table(placed.join(keys, "key"), "mixed")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 2) -> DataFrame:
    """Component of each document, one output row per input row.

    Documents without words (null and empty texts among them) have no shingles and are
    linked with nothing. Rows that repeat an id are one document with several texts. Rows
    with a null id are their own documents: component_id is null, kept is true. Other
    columns are ignored. Ids must be integers. Result: doc_id, n_shingles, component_id, kept.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = scratch.table(arrow_map(src, _sketches(shingle_words), "doc_id long, n long, k1 long, k2 long, sig array<int>"), "sketches")
    real = rows.where("n > 0 AND doc_id IS NOT NULL")
    classes = scratch.table(real.groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    # a class stands under its least id; an id that leads several classes brings all its sets
    nodes = classes.select("id", "n")

    half = lambda at: F.transform(F.sequence(F.lit(0), F.lit(M - 1)), lambda k: F.xxhash64(F.get("sig", k * R + at), *[F.get("sig", k * R + at + r) for r in range(1, R)]))
    keyed = classes.select("id", "sig").select("id", F.posexplode(half(0)).alias("_i", "_a"), half(M * R).alias("_bs")).select("id", "_i", "_a", F.posexplode("_bs").alias("_j", "_b")).select("id", F.xxhash64("_i", "_j", "_a", "_b").alias("key"))
    reps = keyed.groupBy("key").agg(F.count("*").alias("_n"), F.min(F.struct(F.xxhash64("id").alias("h"), "id")).alias("_rep")).where("_n > 1").select("key", F.col("_rep.id").alias("rep"))
    # written first, so that a bucket that a third of all classes are in is dealt anew where it is joined
    reps = scratch.table(reps, "reps")
    members = scratch.table(keyed.join(reps, "key").select("key", "id", "rep"), "buckets")
    release(spark)
    active = members.select("id").distinct()
    sets = arrow_map(src.join(active, src["doc_id"] == active["id"]).select("doc_id", "text"), _sets(shingle_words), "id long, set array<long>")
    sets = scratch.table(sets.where(F.size("set") > 0).dropDuplicates(["id", "set"]), "sets")
    release(spark)

    pairs = members.where("id <> rep").select(F.least("id", "rep").alias("a"), F.greatest("id", "rep").alias("b")).distinct()
    links = _confirmed(pairs, nodes, sets, scratch, "star")
    # rows that repeat an id tie the classes of their texts together
    led = rows.where("n > 0 AND doc_id IS NOT NULL").join(classes.select("k1", "k2", "id"), ["k1", "k2"]).select("doc_id", "id").distinct()
    several = led.groupBy("doc_id").agg(F.min("id").alias("_lo"), F.max("id").alias("_hi")).where("_lo <> _hi").select("doc_id")
    ties = scratch.table(led.join(several, "doc_id").select(F.col("doc_id").alias("a"), F.col("id").alias("b")), "ties")
    first = components(links.union(ties), scratch)

    mixed = _mixed(members, first, scratch)
    chosen = mixed.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "id").alias("h"), "id", "comp")).alias("_rep")).select("key", F.col("_rep.id").alias("rep"), F.col("_rep.comp").alias("_comp"))
    again = mixed.join(scratch.table(chosen, "chosen"), "key").where("comp <> _comp").select(F.least("id", "rep").alias("a"), F.greatest("id", "rep").alias("b")).distinct()
    first = _grown(first, _confirmed(again, nodes, sets, scratch, "again"), scratch)
    rest = _left_over(_mixed(mixed, first, scratch), sets, scratch)
    first = _grown(first, _confirmed(rest, nodes, sets, scratch, "rest"), scratch)

    led_all = rows.select("doc_id", "n", "k1", "k2").join(classes.select("k1", "k2", F.col("id").alias("_class")), ["k1", "k2"], "left")
    out = led_all.join(first.select(F.col("id").alias("_class"), "label"), "_class", "left")
    component = F.when(F.col("n") > 0, F.coalesce("label", "_class")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _left_over(mixed: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs of different components in buckets (key, id, comp) that hold several, which share a shingle of their prefixes."""
    ids = scratch.table(mixed.select("id", "comp").distinct(), "left-ids")
    each = sets.join(ids, "id").withColumn("_set", F.monotonically_increasing_id())
    each = scratch.table(each.select("_set", "id", "comp", F.size("set").alias("n"), "set"), "left-sets")
    flat = each.select("_set", "id", "comp", "n", F.explode("set").alias("t"))
    # Shingles that one component alone has can't link it with others. They come first in the order, so they fill
    # prefixes without making pairs; the others follow by frequency, rarest first. Written, so that a frequent one is dealt anew.
    often = flat.groupBy("t").agg(F.count("*").alias("df"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo <> _hi").select("t", "df")
    often = scratch.table(often, "left-shingles")
    ranked = flat.join(often, "t").groupBy("_set", "id", "comp", "n").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("_ts"))
    n_prefix = F.col("n") - F.ceil(F.col("n") * F.lit(PERCENT) / 100 - 1e-9) + 1
    own = F.col("n") - F.size("_ts")
    reach = F.greatest(n_prefix - own, F.lit(0)).cast("int")
    prefix = ranked.select("id", "comp", "n", own.alias("own"), F.posexplode(F.slice("_ts", 1, reach)).alias("_k", "_t")).select("id", "comp", "n", (F.col("own") + F.col("_k")).alias("pos"), F.col("_t.t").alias("t")).distinct()
    prefix = scratch.table(prefix, "prefix")
    # members of a shingle's most frequent component meet the others, not one another
    main = prefix.groupBy("t", "comp").count().groupBy("t").agg(F.max(F.struct("count", "comp")).alias("_m"), F.count("*").alias("_k")).where("_k > 1").select("t", F.col("_m.comp").alias("main"))
    main = scratch.table(main, "main")
    side = lambda df, x: df.select("t", F.col("id").alias(x), F.col("comp").alias(f"c{x}"), F.col("n").alias(f"n{x}"), F.col("pos").alias(f"p{x}"))
    others = side(prefix.join(main, "t").where("comp <> main"), "x")
    # length filter, and positional filter: at the first shared shingle so many can be shared from there on
    close = (F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * PERCENT) & (F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) * (100 + PERCENT) >= (F.col("nx") + F.col("ny")) * PERCENT)
    met = others.join(side(prefix, "y"), "t").where((F.col("cx") != F.col("cy")) & close)
    return scratch.table(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "rest-pairs")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each component; all their columns."""
    found = near_duplicates(docs)
    gone = Scratch(docs.sparkSession, "dedup").table(found.where("NOT kept").select(F.col("doc_id").alias("_id")).distinct(), "gone")
    return docs.join(gone, docs["doc_id"] == gone["_id"], "left_anti")
