"""The pipeline's stages, and all of them together, against plain Python."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers

import corpus_pipeline
from tagloom.llm import decontaminate, quality, secrets

from test_operators import KEY, brute_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def good(docs, labels):
    """Rows that the classifier fitted on the labelled rows accepts."""
    texts = {i: t or "" for i, t, *_ in docs}
    chosen = sorted(i for i in labels if i in texts and zlib.crc32(str(i).encode()) % 4 != 2)
    field = quality.fit([texts[i] for i in chosen], np.array([float(labels[i]) for i in chosen]))
    return [r for r in docs if field.scores([r[1] or ""])[0][0] >= quality.THRESHOLD]


def distinct(docs):
    found, _ = brute_components([(i, t) for i, t, *_ in docs])
    return [r for r in docs if found[r[0]] == r[0]]


def untested(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    out = []
    for r in docs:
        text, held = words(r[1]), False
        for item in filter(None, map(words, items)):
            n, run = len(item), min(decontaminate.RUN, len(item))
            if n < decontaminate.SHORT:
                held |= any(words(line) == item for line in (r[1] or "").split("\n"))
                continue
            for start in range(-n, len(text)):
                same = [0 <= start + k < len(text) and text[start + k] == w for k, w in enumerate(item)]
                held |= max(sum(same[k : k + run]) for k in range(n - run + 1)) >= -(-8 * run // 10)
        if not held:
            out.append(r)
    return out


def redacted(docs):
    found, holders = {}, {}
    for k, (_, text, lang, source, _) in enumerate(docs):
        spans = []
        for rank, (kind, pattern, group, least) in enumerate(secrets.KINDS):
            for m in re.finditer(pattern, text or "", re.A):
                v = m[group]
                if len(v) >= least and (kind != "opaque" or all(re.search(c, v) for c in ("[0-9]", "[A-Z]", "[a-z]"))):
                    spans.append((m.start(), rank, m.end(), kind, v))
                    holders.setdefault(v, set()).add((source or "", "" if source is None or lang is None else f"{source}/{lang}"))
        found[k] = sorted(spans)
    out = []
    for k, (i, text, lang, source, n) in enumerate(docs):
        at, parts = 0, []
        for start, _, end, kind, v in found[k]:
            owners, repos = len({o for o, _ in holders[v]}), len(holders[v])
            if owners >= secrets.EXAMPLE_OWNERS or repos >= secrets.EXAMPLE_REPOS or kind == "opaque" and owners > secrets.LIVE_OWNERS:
                continue
            if start >= at:
                parts += [text[at:start], "[SECRET]"]
            at = max(at, end)
        new = "".join(parts) + text[at:] if parts else text or ""
        out.append((i, new, lang, source, len(new) if parts else n))
    return out


def encoded(docs):
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_padding()
    t.no_truncation()
    out = []
    for i, text, *_ in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The smallest documents with nulls, copies, near copies, test items and secrets among them."""
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    items = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    long = max(docs, key=lambda r: len(r[1] or ""))[1]
    words = long.split()
    back = lambda k: " ".join(reversed(docs[k][1].split()))
    extra = [
        None,
        "",
        long,
        " ".join([*words[:-3], "other", *words[-3:]]),
        f"{docs[0][1]}\n{items[0]}",
        f"{back(0)} token = {KEY} and so on",
        f"{back(1)} password: \"{KEY}aa\" and sk_Abcdef0123456789ABCDEF",
        *[f"{back(k)} api_key={'f' * 30}" for k in range(2, 40)],
    ]
    docs += [(10_000 + k, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", None if t is None else len(t)) for k, t in enumerate(extra)]
    base = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(*r, "x", 1) for r in docs], f"{SCHEMA}, _id string, _row int").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(list(labels.items()), "doc_id long, quality int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([*enumerate(items), (len(items), None)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base), docs, labels, items


def same(frame, want):
    assert sorted(map(tuple, frame.collect()), key=repr) == sorted(want, key=repr)


def test_stages_and_run(spark, tables):
    base, docs, labels, items = tables
    plain = [lambda d: good(d, labels), distinct, lambda d: untested(d, items), redacted]
    frame = spark.read.parquet(f"{base}/documents.parquet")
    for (_, stage), fn in zip(corpus_pipeline.STAGES, plain, strict=False):
        before, docs = len(docs), fn(docs)
        out = stage(spark, frame, base)
        assert out.columns == corpus_pipeline.COLUMNS
        same(out, docs)
        frame = spark.createDataFrame([(*r, 7, "y") for r in docs], f"{SCHEMA}, _text int, _words string")
        assert fn is redacted or len(docs) < before, fn
    assert any("[SECRET]" in r[1] for r in docs) and any("f" * 30 in r[1] for r in docs)
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, base).collect()]
    assert sorted(got) == sorted(encoded(docs))


def test_empty_and_null_tables(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/a/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").collect() == []
    spark.createDataFrame([(None, None, None, None, None), (None, None, None, None, None), (None, "some text", None, None, 9), (1, None, None, None, None)], SCHEMA).write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([(None, None), (1, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/b/labels.parquet")
    spark.createDataFrame([(None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/b/benchmark.parquet")
    # without labels every text is accepted, and rows without id or words are linked with nothing
    got = corpus_pipeline.run(spark, f"{tmp_path}/b").collect()
    assert sorted((x.doc_id is None, x.n_tokens) for x in got)[:1] == [(False, 0)] and len(got) == 4
