"""Corpus operators against brute force, libraries and exact round trips, with awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from tagloom.llm import bpe, chat, decontaminate, licenses, media, neardup, pages, quality, secrets, tokenshards

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label string, key string, ids string, id long"
KEY = "0123456789abcdef0123456789abcdef"


def rows(*texts, start=0):
    return [(start + k, t, "en", f"src{k % 3}", len(t or ""), 1.0, "x", "k", "i", 5) for k, t in enumerate(texts)]


AWKWARD = [None, "", " ", "\n\n", "a", "Élan vital ½ 日本", "a b", "a b", f'token = "{KEY}"', "x" * 50_000, ("lorem ipsum dolor " * 4000).strip(), "🎉 password: hunter2hunter2 🎉", "<|endoftext|> hi", "a\x00b \x1c c"]


@pytest.fixture(scope="module")
def awkward(spark):
    """Null and empty texts, very long ones, repeated rows, a null id, extra columns with names that operators use."""
    data = rows(*AWKWARD)
    return spark.createDataFrame([*data, data[6], (None, "a b c", None, None, None, None, None, None, None, None)], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(spark, empty):
    vocab = public_tokenizers.path("word_bpe_49k.json")
    items = spark.createDataFrame([], "item_id long, text string")
    conversations = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    web = spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for df in (secrets.scan(empty), neardup.near_duplicates(empty), pages.extract(web), chat.format_conversations(conversations), bpe.encode_decode(empty, vocab), decontaminate.overlaps(empty, items), media.media_columns(empty), tokenshards.tokenize_to_shards(empty, public_tokenizers.path("byte_bpe_50k.json")), quality.score(empty, quality.fit_on(empty, labels)), licenses.scan(empty)):
        assert df.collect() == []


# --- secrets ---


def base_spans(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_secret_base_spans(spark):
    r = random.Random(3)
    bits = ["password", "Secret", "api_key", "APIKEY", "token", '"', "'", " ", ":", "=", "= ", "AKIA", "ABCDEFGH12345678", KEY, "abc", "é", "🎉", "\n", "hunter2", "z9-./+", "token=abc", "secret=token:abcdefgh"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(400)]
    got = {x.doc_id: x for x in secrets.scan(spark.createDataFrame(rows(*texts), SCHEMA)).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        want = base_spans(t)
        assert got[k].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (t, want, got[k].spans)
        assert got[k].n_hex == want.count("hex:") and got[k].n_assign == want.count("assign:")
        if want:
            assert set(want.split(",")) <= set(got[k].spans.split(","))


def test_secret_ownership(spark):
    shared, own = f"token = {KEY}", "token = fedcba9876543210fedcba9876543210"
    data = [(k, shared, "en", f"s{k}", 0) for k in range(5)] + [(9, own, "en", "s0", 0), (9, own, "en", "s0", 0), (10, None, None, None, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    got = secrets.scan(df, redacted=True).collect()
    assert len(got) == 8
    assert {x.max_owners for x in got if x.doc_id < 5} == {5} and {x.n_live for x in got if x.doc_id < 5} == {0}
    nine = [x for x in got if x.doc_id == 9]
    assert len(nine) == 2 and all(x.n_live > 0 and x.redacted == "[SECRET]" for x in nine)
    assert all(x.redacted == shared for x in got if x.doc_id < 5)


def test_secret_repositories(spark):
    """A value of few owners is an example once many repositories hold it."""
    from pyspark.sql import functions as F

    few, many = f"token = {KEY}", "token = fedcba9876543210fedcba9876543210"
    data = [(k, few, "s0", f"r{k}") for k in range(3)] + [(10 + k, many, f"s{k % 2}", f"r{k // 2}") for k in range(6)]
    got = secrets.scan(spark.createDataFrame(data, "doc_id long, text string, source string, repo string"), repo=F.col("repo")).collect()
    assert {(x.max_owners, x.max_repos, x.n_live > 0, x.n_example > 0) for x in got if x.doc_id < 10} == {(1, 3, True, False)}
    assert {(x.max_owners, x.max_repos, x.n_live > 0, x.n_example > 0) for x in got if x.doc_id >= 10} == {(2, 6, False, True)}


def test_secrets_awkward(awkward):
    got = secrets.scan(awkward).collect()
    assert len(got) == awkward.count()
    assert sum(x.n_assign for x in got) == 2


# --- near duplicates ---


def brute_components(docs):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.setdefault(i, []).append(frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset([tuple(w)] if w else []))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(s and t and 100 * len(s & t) >= 80 * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, sets


def test_near_duplicates_match_brute_force(spark):
    r = random.Random(11)
    words = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(12):
        base = [r.choice(words) for _ in range(r.choice((1, 3, 12, 40, 120)))]
        for _ in range(r.randint(1, 14)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 12))):
                copy[r.randrange(len(copy))] = r.choice(words)
            texts.append(" ".join(copy) if r.random() < 0.8 else "\t".join(copy).upper())
    texts += ["", None, "  ", texts[0]]
    docs = list(enumerate(texts)) + [(3, texts[-1])]
    df = spark.createDataFrame([(i, t) for i, t in docs], "doc_id long, text string")
    want, sets = brute_components(docs)
    got = neardup.near_duplicates(df).collect()
    assert len(got) == len(docs)
    for x in got:
        assert x.component_id == want[x.doc_id] and x.kept == (x.doc_id == x.component_id)
        assert x.n_shingles in {len(s) for s in sets[x.doc_id]}


def test_near_duplicate_chain_through_one_base(spark):
    """Copies that are linked only through the text they come from, which is not the bucket's first member."""
    base = [f"t{k}" for k in range(100)]
    texts = [" ".join(base[:k] + ["x%d" % k] + base[k + 1 : 50 + k] + ["y%d" % k] + base[51 + k :]) for k in range(0, 48, 2)]
    edited = [" ".join(w if (k * 7 + j) % 11 else f"z{k}_{j}" for j, w in enumerate(base)) for k in range(20)]
    docs = list(enumerate([*edited, *texts, " ".join(base)]))
    want, _ = brute_components(docs)
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x.doc_id: x.component_id for x in got} == want


def test_near_duplicates_awkward(awkward):
    got = neardup.near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    assert all(x.kept and x.component_id is None for x in got if x.doc_id is None)
    assert {(x.component_id, x.kept) for x in got if x.doc_id == 7} == {(6, False)}
    assert all(x.component_id == x.doc_id and x.n_shingles == 0 for x in got if x.doc_id in (0, 1, 2, 3))


def test_components(spark):
    from tagloom.llm.common import Scratch

    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(170)] + [(k, k + 1) for k in range(300, 360)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = neardup.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()
    assert {x.id: x.label for x in got} == {i: find(i) for a, b in edges if a != b for i in (a, b)}


# --- pages ---


def test_pages(spark):
    html = '<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><a href=x>Home</a></nav><div class="ad">Buy this.</div><article><h1>A &amp; B</h1><p><b>One  two.<br><p>Three\n four, and more of it.</article><div class=comments><p>Nice article, thanks a lot.</p></div><footer>&copy; me</footer></body></html>'
    df = spark.createDataFrame([(1, "u", html, "x"), (1, "u", html, "x"), (2, None, None, "x"), (None, "u", "", "x")], "page_id long, url string, html string, text string")
    got = pages.extract(df).collect()
    assert sorted((x.page_id or 0, x.text, x.n_chars) for x in got) == [(0, "", 0), (1, "A & B\nOne two.\nThree four, and more of it.", 42)] + [(1, "A & B\nOne two.\nThree four, and more of it.", 42)] + [(2, "", 0)]


def test_pages_with_faults():
    """Legal and broken html that must not lose the article."""
    said = "One two three four five six, seven eight nine."
    article = f"<article><h1>Title of it</h1><p>{said}</p><p>More of it, and then some more.</p></article>"
    want = f"Title of it\n{said}\nMore of it, and then some more."
    model = pages.fitted()
    for html in (
        f"<html><head><title>T</title><body>{article}",
        f"<title>T<b></title><meta charset=x>{article}",
        f"<html><head><script>for(i=0;i<n;i++){{a('</p>')}}</script></head><body>{article}</body>",
        f"<body><script>if(a<b)document.write('<scr'+'ipt>')</SCRIPT >{article}",
        f"<body><iframe src=x>{article}",
        f"<body><noscript>{article}",
        f"<body><svg><svg><text>no</text></svg><text>no</text></svg>{article}",
        f"<body><p title=it's>{article}",
        f"<body><!-- a > b -->{article}<!-- open",
        f"{article}</body></html><script>",
        f"{article}<div class='x",
        f"<body><img alt='a > b'><!DOCTYPE x>{article}</x></y>",
    ):
        assert model.text(html) == want, html
    assert model.text(f"<body><article><p>When a < b, c <3 and 5 > 4, all is well with us.</p><p>{said}</p></article>") == f"When a < b, c <3 and 5 > 4, all is well with us.\n{said}"
    assert model.text(f"<body><article><p>{said} <a href=x>link</a></p><p>And <a href=y>another<a href=z>one</a> is here.</p></article>") == f"{said} link\nAnd anotherone is here."


def test_pages_in_linear_time():
    import time

    for part in ('<a href="x ', "<div>", "</x><div>", "<b>", "<li>", "<iframe>", "<svg>", "<!-- ", "<p <", "<a b='", "<", "<!", "<script>", "<li><div>", "<div></p>", "<a><div>", "&amp"):
        began = time.process_time()
        pages.parse(part * (1_000_000 // len(part)))
        assert time.process_time() - began < 8, part  # about a second; a quadratic reader takes minutes


def test_pages_table():
    """All pages of the smallest table, as labelled by hand: the article element's blocks are the text."""
    import html as html_lib

    import pyarrow.parquet as pq

    model, rows_ = pages.fitted(), pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    for row in rows_:
        inside = re.search(r"<article>(.*?)(?:</article>|$)", row["html"], re.S)[1]
        blocks = [" ".join(html_lib.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)\b[^>]*>", inside)]
        assert model.text(row["html"]) == "\n".join(filter(None, blocks)), row["page_id"]


def test_pages_held_out():
    r, model, right, total = random.Random(1234), pages.fitted(), 0, 0
    for _ in range(80):
        order = pages._prepare(pages.parse(pages.labelled_page(r)))
        pages._inherit(order)
        p, _ = model.messages(order)
        for node, q in zip(order, p, strict=True):
            if node.tag == "#text":
                total += 1
                right += (q > 0.5) == bool(node.gold)
    assert right / total > 0.98


def test_tree_messages_are_exact():
    """Marginals against enumeration of all labellings."""
    import itertools
    import math

    model, order = pages.fitted(), pages._prepare(pages.parse("<div class=content><p>One two three.</p><ul><li><a href=x>a</a></ul></div><footer>x</footer>"))
    at = {id(n): k for k, n in enumerate(order)}
    weight = np.zeros(len(order))
    z = 0.0
    for labels in itertools.product((0, 1), repeat=len(order)):
        s = sum(y * sum(model.unary[f] for f in n.feats) + (model.pair[pages._GROUPS.get(n.tag, pages._N_GROUPS - 1)][labels[at[id(n.parent)]]][y] if n.parent else 0) for n, y in zip(order, labels, strict=True))
        z += math.exp(s)
        weight += np.array(labels) * math.exp(s)
    assert np.allclose(model.messages(order)[0], weight / z)


# --- chat ---


def test_chat_round_trip(spark):
    r = random.Random(2)
    bits = ["<", ">", "[INST]", "</s>", "\\", "<|end|>", "<|role|>", "|", "\n", "ok", "é", "s>"]
    said = lambda: "".join(r.choice(bits) for _ in range(r.randint(0, 9)))
    data = [(c, t, r.choice(("user", "assistant", "system")), said()) for c in range(40) for t in range(r.randint(1, 5))]
    data += [(99, 0, None, None), (None, 1, "user", "x"), (99, None, "assistant", "y"), data[0]]
    got = {x.conv_id: x for x in chat.format_conversations(chat.with_probe(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")), with_text=True).collect()}
    data += list(chat.PROBE)
    assert len(got) == 43
    for c, x in got.items():
        turns = sorted(((t if t is not None else -(10**9), role or "", text or "") for cc, t, role, text in data if cc == c))
        want = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert x.n_turns == len(turns) and x.turns_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert x.loss_chars == len(loss) and x.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert x.formatted_chars == len(x.formatted)
        assert "".join(chat.unescape(x.formatted[a:b]) for a, b in x.loss_spans) == loss


OTHER = (
    "{% if messages[0].role == 'system' %}<<SYS>>{{ messages[0].text | escape }}<</SYS>>{{ '\\n' }}{% endif %}"
    "{% for m in messages %}{% if loop.first %}<s>{% endif %}[INST]{{ m.role | escape }}[/INST]{% generation %}{% if m.role == 'assistant' %}{{ m.text | escape }}{% endif %}{% endgeneration %}"
    "{% if m.role != 'assistant' %}{{ m.text | escape }}{% endif %}</s>{% if loop.last %}#{% endif %}{% endfor %}"
)


def test_chat_with_another_template(spark):
    """First-turn rules, a system prompt and loop state over whole conversations; extra columns; repeated rows; a null id; a very long conversation."""
    fmt = chat.Format(OTHER, r"(?:<s>)?\[INST\](?P<role>.*?)\[/INST\](?P<text>.*?)</s>", "</s>", r"<<SYS>>.*?<</SYS>>\n|#")
    assert chat.in_order(OTHER) and chat.in_order(chat.CHAT)
    held = "{% set n = messages[1] %}" + OTHER
    assert not chat.in_order(held) and not chat.in_order("{% for m in messages %}{% for k in messages %}{% endfor %}{% endfor %}") and not chat.in_order("{% if messages %}x{% endif %}")
    data = [(1, 0, "system", "be <s> good"), (1, 1, "user", "hi"), (1, 2, "assistant", "[INST] no"), (2, 0, "user", "x" * 300_000), (2, 0, "user", "x" * 300_000), (2, 1, "assistant", "\\"), (None, 0, "user", "a"), (None, 0, "user", "a")]
    data += [(3, k, ("user", "assistant")[k % 2], f"t{k}</s>") for k in range(5000)]
    df = spark.createDataFrame([(*d, "z", 1) for d in data], "conv_id long, turn long, role string, text string, formatted string, n_turns long")
    for f in (fmt, chat.Format(held, fmt.turn, fmt.end, fmt.other)):
        got = chat.format_conversations(df, f, with_text=True).collect()
        assert sorted((x.conv_id or 0, x.n_turns) for x in got) == [(0, 1), (0, 1), (1, 3), (2, 3), (3, 5000)]
        for x in got:
            turns = [("user", "a")] if x.conv_id is None else [d[2:4] for d in data if d[0] == x.conv_id]
            marks = "".join(("<s>" if k == 0 else "") + f"[INST]{role}[/INST]{chat.escape(text)}</s>" + ("#" if k == len(turns) - 1 else "") for k, (role, text) in enumerate(turns))
            assert x.formatted == ("<<SYS>>be <\\s> good<</SYS>>\n" if x.conv_id == 1 else "") + marks
            assert list(chat.read_back(x.formatted, fmt)) == turns
            assert x.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
            loss = "".join(b for a, b in turns if a == "assistant")
            assert (x.loss_chars, x.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
            assert "".join(chat.unescape(x.formatted[a:b]) for a, b in x.loss_spans) == loss
    with pytest.raises(ValueError):
        list(chat.read_back("[INST]user[/INST]", fmt))


def test_template_language():
    assert chat.render("{% for m in ms %}{{ loop.index }}{{ m | upper }}{% if loop.first %}!{% endif %}{% endfor %}", ms=["a", "b"])[0] == "1A!2B"
    assert chat.render("{% set x = 'q' %}{{ x ~ (1 + 2) }}")[0] == "q3"
    assert isinstance(chat.fold(chat.parse("{% if 1 == 1 %}a{% else %}{{ x }}{% endif %}b")).parts[0], chat.Text)
    assert chat.render("{{ x.__class__ }}|{{ x['y'] }}", x={"y": 3})[0] == "|3"
    for bad in ("{{ x() }}", "{% if x %}", "{{ x | eval }}", "{{ 'a }}", "{% endfor %}", "{{ 'a' + 1 }}", "{{ 1 % 0 }}"):
        with pytest.raises(chat.TemplateError):
            chat.render(bad, x="s")


# --- tokens ---


def test_bpe_matches_the_library(spark, awkward):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib, model = Tokenizer.from_file(path), bpe.BpeModel(path)
    r = random.Random(4)
    pool = [*"abcTIİΣσς'sS 12²½<>|-\n\x1c\x85 日語é", "'ll", "<|endoftext|>", "ﬁ", "Å"]
    for _ in range(3000):
        t = "".join(r.choice(pool) for _ in range(r.randint(0, 20)))
        want = lib.encode(t, add_special_tokens=False).ids
        ids = np.frombuffer(model.encode(t), "<u4").astype(np.int64)
        assert ids.tolist() == want
        assert model.decode(ids).decode() == lib.decode(want, skip_special_tokens=False)
    got = bpe.encode_decode(awkward, path, keep=["lang"], with_ids=True).collect()
    assert len(got) == awkward.count()
    texts = dict(enumerate(AWKWARD))
    for x in got:
        if x.doc_id is not None:
            want = lib.encode(texts[x.doc_id] or "", add_special_tokens=False).ids
            assert x.ids == want and x.n_tokens == len(want)
            assert x.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()


def test_token_shards(spark, awkward, monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = tokenshards.tokenize_to_shards(awkward, path).orderBy("start").collect()
    assert len(got) == awkward.count()
    texts, start = dict(enumerate(AWKWARD)), 0
    assert got[0].doc_id is None and [x.doc_id for x in got[1:]] == sorted(x.doc_id for x in got[1:])
    for x in got:
        text = "a b c" if x.doc_id is None else texts[x.doc_id] or ""
        ids = np.array([*lib.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert (x.start, x.n_tokens, x.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_shards_fuzz(spark):
    """Random mixtures of scripts, digits, marks, contractions and all kinds of white space against the library on whole texts."""
    import tokenizers

    r = random.Random(21)
    bits = ["a", "The", " the", "ing", "n't", "'s", "'LL", "’s", "'", "1", "234", "½", "²", "٣", "é", "e\u0301", "ß", "日本", "ไทย", "हिन्दी", "🎉", "👩\u200d💻", "\u200b", "\ufeff", "\u00a0", "\u3000", "\u2028", "\x85", "\x1c", "\x00", "\t", "\n", "\r\n", "\n\n", " ", "  ", "   ", "_", "-", "...", "!?", "<|endoftext|>", "https://x.y/z?q=1", "\\", "ſ", "İ", "ǅ", "Ⅷ", "\U0001d400", "\ue000"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(1, 40))) for _ in range(600)]
    texts += ["".join(chr(r.choice((r.randrange(32, 0x2FF), r.randrange(0x300, 0xD7FF), r.randrange(0xE000, 0x1FFFF)))) for _ in range(30)) for _ in range(200)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    library.no_padding()
    library.no_truncation()
    got = {x.doc_id: x for x in tokenshards.tokenize_to_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()}
    start = 0
    for k, t in enumerate(texts):
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        x = got[k]
        assert (x.start, x.n_tokens, x.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        start += len(ids)


def test_token_shards_ask_the_library_once(monkeypatch):
    """Each distinct word goes to the library once, many in one call and few characters at a time; the ids are those of whole texts."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, asked = Tokenizer.from_file(path), []

    class Counting:
        def encode_batch_fast(self, texts, add_special_tokens):
            asked.append(sum(map(len, texts)))
            return library.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    r = random.Random(8)
    known = ["".join(r.choices("abcdeé", k=9)) + r.choice(("", ".", "'s", "12", "---", "ción,")) for _ in range(3000)]
    texts = [" ".join(r.choices(known, k=100)) for _ in range(300)]
    tok = tokenshards.CachedTokenizer(path)
    tok.library = Counting()
    got = tok.encode(pa.array(texts))
    assert len(asked) <= 2 and sum(asked) < 1.2 * (sum(map(len, known)) + len(known))
    assert [x.tolist() for x in got] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert all(np.array_equal(a, b) for a, b in zip(got, tok.encode(pa.array(texts)), strict=True)) and len(asked) <= 3

    # one text of many characters and no white space, part of a larger array with nulls
    monkeypatch.setattr(tokenshards, "ASKED_CHARS", 500)
    asked.clear()
    odd = [None, "日本。語" * 2000, "", "é" * 3, None, "\u3000 a \u00a0  b\u2003 c\n  '", "'s''s '1 1's"]
    got = tok.encode(pa.array(["cut off", *odd]).slice(1))
    assert [x.tolist() for x in got] == [x.ids for x in library.encode_batch([t or "" for t in odd], add_special_tokens=False)]
    assert max(asked) <= 1100


def test_word_starts_are_cuts():
    """Wherever word_starts marks a byte, the library's pre-tokenizer starts a word; in plain text it marks all but words after a line break, which stay with it."""
    from tokenizers import pre_tokenizers

    cutter, r = pre_tokenizers.ByteLevel(add_prefix_space=False), random.Random(9)
    bits = [*"aZéñ×÷ª½1'._ \n\t\x1c\u00a0\u3000\u2003…日́", "'s", "'ll", "  ", "\x85"]

    def both(t):
        begins = {len(t[:a].encode()) for _, (a, _) in cutter.pre_tokenize_str(t)} - {0}
        return set(np.flatnonzero(tokenshards.word_starts(np.frombuffer(t.encode(), np.uint8))).tolist()), begins

    for _ in range(3000):
        t = "".join(r.choice(bits) for _ in range(r.randrange(1, 25)))
        found, begins = both(t)
        assert found <= begins, t
    t = "The café, señor: 12 (of 30) don't cost 4x; naïve\nlines end. e.g. this"
    found, begins = both(t)
    assert begins - found == {len(t[: t.index("lines")].encode())}


CLASHING = ["_id", "_row", "_text", "_words", "_iw", "_th", "_item", "_spans", "_hash", "_owner", "_repo", "_blocks", "_normal", "id", "n", "k1", "k2", "sig", "set", "key", "comp", "label", "chunks", "record", "digest", "_held", "component_id", "score", "predicted"]


def test_columns_of_any_name(spark):
    """Every operator on documents ignores other columns, whatever their names."""
    from pyspark.sql import functions as F

    texts = ["some words of a text, all rights reserved", f"token = {KEY}", None, "a b c d e f g h i j"]
    plain = spark.createDataFrame(rows(*texts), SCHEMA).select("doc_id", "text", "source")
    more = plain.select("*", *[F.lit(None if k % 2 else k).cast("int").alias(c) for k, c in enumerate(CLASHING)])
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, "a b c d e f g h i j", 5)], "item_id long, text string, _iw int")
    path = public_tokenizers.path("byte_bpe_50k.json")
    for fn in (secrets.scan, neardup.near_duplicates, licenses.scan, media.media_columns, lambda d: decontaminate.overlaps(d, bench), lambda d: quality.score(d, quality.fit_on(d, labels)), lambda d: tokenshards.tokenize_to_shards(d, path), lambda d: bpe.encode_decode(d, public_tokenizers.path("word_bpe_49k.json"))):
        a, b = fn(plain), fn(more)
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert decontaminate.clean(more, bench).columns == more.columns and neardup.deduplicate(more).count() == 4


def test_shard_lookup(tmp_path):
    r = np.random.default_rng(1)
    docs = {int(k): r.integers(0, 50_000, r.integers(0, 400)).astype(np.uint32) for k in np.unique(r.integers(-(10**12), 10**12, 500))}
    w = tokenshards.ShardWriter(f"file://{tmp_path}", 2)
    for k in sorted(docs):
        w.add(tokenshards.key_of(k), docs[k])
    w.close()
    s = tokenshards.ShardReader(w.uri)
    assert len(s.blocks) > 1 and s.docs == len(docs)
    assert all(np.array_equal(s.lookup(k)[0], v) for k, v in docs.items())
    assert sum(bool(s.lookup(k + 1)) for k in docs if k + 1 not in docs) == 0
    assert sum(s.may_hold(k + 1) for k in docs if k + 1 not in docs) < 0.05 * len(docs)
    with open(w.path, "r+b") as f:
        f.seek(100)
        f.write(b"\x00\x01\x02")
    with pytest.raises(Exception):
        list(tokenshards.ShardReader(w.uri))


# --- decontamination ---


def test_overlaps_against_brute_force(spark):
    r = random.Random(8)
    vocabulary = [f"v{k}" for k in range(400)]
    items = [[r.choice(vocabulary) for _ in range(n)] for n in (3, 5, 8, 9, 12, 20, 40, 6, 7, 10, 11, 13, 14, 1)]
    docs = []
    for _ in range(220):
        t = [r.choice(vocabulary) for _ in range(r.randint(0, 60))]
        item = list(r.choice(items))
        for _ in range(r.choice((0, 1, 1, 2, 2, 4, 6))):
            item[r.randrange(len(item))] = r.choice(vocabulary)
        at = r.randint(0, len(t))
        docs.append(t[:at] + item[r.choice((0, 0, 3)) :] + t[at:])
    want = set()
    for d, t in enumerate(docs):
        for i, item in enumerate(items):
            n = len(item)
            if n < 5:  # only whole lines
                want |= {(d, i)} if t == item else set()
                continue
            run = min(decontaminate.RUN, n)
            need = -(-8 * run // 10)
            for start in range(-n, len(t)):
                same = [0 <= start + k < len(t) and t[start + k] == w for k, w in enumerate(item)]
                if max(sum(same[k : k + run]) for k in range(n - run + 1)) >= need:
                    want.add((d, i))
    df = spark.createDataFrame([(k, "! ".join(t).upper()) for k, t in enumerate(docs)] + [(500, None), (None, " ".join(items[6])), (0, "! ".join(docs[0]))], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)] + [(90, None)], "item_id long, text string")
    for limit in (decontaminate.BROADCAST_CHARS, -1):
        keep, decontaminate.BROADCAST_CHARS = decontaminate.BROADCAST_CHARS, limit
        try:
            got = decontaminate.overlaps(df, bench).collect()
        finally:
            decontaminate.BROADCAST_CHARS = keep
        assert {(x.doc_id, x.item_id) for x in got if x.doc_id is not None} == want
        assert [x.item_id for x in got if x.doc_id is None] == [6]
    left = decontaminate.clean(df, bench).collect()
    assert {x.doc_id for x in left} == {k for k in range(len(docs)) if k not in {d for d, _ in want}} | {500}


def test_masks_hit_every_substitution():
    import itertools

    for n in range(decontaminate.SHORT, decontaminate.RUN + 1):
        masks = decontaminate.MASKS if n >= decontaminate.SEEDED else decontaminate.SHORT_MASKS
        for gone in itertools.combinations(range(n), n - -(-8 * n // 10)):
            assert any(all(at + o not in gone for o in m) for m in masks for at in range(n - m[-1])), (n, gone)


def test_short_items_are_whole_lines(spark):
    bench = spark.createDataFrame([(1, "Yes, it is."), (2, "no"), (3, "a b c d e"), (3, "a b c d e"), (4, " "), (5, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so\n yes it is!\nmore", 5), (2, "yes it is so", 5), (3, "no", 5), (3, "no", 5), (4, "no no", 5), (5, "x a b z d e", 5), (6, "a b z d", 5), (None, "first line\n\nNo.\nno", 5), (8, "\n", 5)], "doc_id long, text string, item_id int")
    for limit in (decontaminate.BROADCAST_CHARS, -1):
        keep, decontaminate.BROADCAST_CHARS = decontaminate.BROADCAST_CHARS, limit
        try:
            got = decontaminate.overlaps(docs, bench).collect()
        finally:
            decontaminate.BROADCAST_CHARS = keep
        assert {(x.doc_id, x.item_id, x.start_word, x.matched) for x in got} == {(1, 1, 1, 3), (3, 2, 0, 1), (5, 3, 1, 4), (None, 2, 2, 1)} and len(got) == 4
    long = spark.createDataFrame([(1, "w " * 200_000 + " ".join(f"q{k}" for k in range(20)) + " w" * 200_000)], "doc_id long, text string")
    item = spark.createDataFrame([(7, " ".join(f"q{k}" if k != 9 else "other" for k in range(20)))], "item_id long, text string")
    assert [(x.start_word, x.agreed) for x in decontaminate.overlaps(long, item).collect()] == [(200_000, 19)]


# --- media ---


def test_media(spark, awkward):
    got = media.media_columns(awkward).collect()
    assert len(got) == awkward.count()
    texts = dict(enumerate(AWKWARD))
    for x in got:
        raw = ("a b c" if x.doc_id is None else texts[x.doc_id] or "").encode()
        padded = raw + b" " * (-(-max(1, len(raw)) // 192) * 192 - len(raw))
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
    same = [x for x in got if x.doc_id in (6, 7)]
    assert len({(x.media_sha256, x.media_bytes, x.feature) for x in same}) == 1


def test_chunks():
    r = np.random.default_rng(2)
    data = r.integers(0, 256, 100_000).astype(np.uint8).tobytes()
    h = 0
    for b in data[:500]:
        h = (h * 2 + int(media._GEAR[b])) % 2**32
    assert int(media.gear_hash(data)[499]) == h
    ends = media.cuts(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and max(sizes) <= media.MOST and min(sizes[:-1]) >= media.LEAST
    pieces = set(media._pieces(data))
    moved = set(media._pieces(b"some other start " * 9 + data))
    assert len(pieces & moved) > 0.8 * len(pieces)  # equal passages give equal chunks
    pieces = media._pieces(data)
    digests, sizes = [media.digest_of(c) for c in pieces], [len(c) for c in pieces]
    assert b"".join(own for _, own in media.chunks_of(media.record_of(data, digests, sizes, set()))) == data
    some = media.chunks_of(media.record_of(data, digests, sizes, {0, 2}))
    assert [own for _, own in some] == [None if k in (0, 2) else c for k, c in enumerate(pieces)]
    with pytest.raises(ValueError):
        media.chunks_of(b"RIFF")


def test_media_store_against_brute_force(spark):
    """Shared passages, chunks that repeat inside a payload, texts that differ in final spaces: each chunk is stored once, what is read back is described as stored."""
    r = random.Random(8)
    passage = " ".join(f"w{r.randrange(3000)}" for _ in range(3000))
    texts = [passage + f" end {k}" for k in range(40)] + [passage * 3, "a", "a ", "a  ", "", None, "b" * 70_000, passage + " end 3"] + [" ".join(str(r.random()) for _ in range(r.randrange(1, 900))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    payloads = [media.payload_of(t)[0] for t in texts]
    owner = {}
    for p in sorted(set(payloads), key=lambda p: hashlib.sha256(p).digest()):
        for k, c in enumerate(media._pieces(p)):
            owner.setdefault(media.digest_of(c), (p, k))
    want = {}
    for p in set(payloads):
        pieces = media._pieces(p)
        digests = [media.digest_of(c) for c in pieces]
        record = media.record_of(p, digests, [len(c) for c in pieces], {k for k, d in enumerate(digests) if owner[d] != (p, k)}, media.zstandard.ZstdCompressor(level=media.LEVEL).compress(p))
        want[p] = (hashlib.sha256(p).hexdigest(), len(record), hashlib.sha256(record).hexdigest(), media.features(p))
    got = {x.doc_id: (x.payload_sha256, x.media_bytes, x.media_sha256, x.feature) for x in media.media_columns(df).collect()}
    assert got == {k: want[p] for k, p in enumerate(payloads)}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("media_records")]


def test_features_against_plain_arithmetic():
    for data in (b" " * 192, bytes(range(192)), b"ab" * 96):
        mean = sum(data) // len(data)
        above = [x >= mean for x in data]
        crossings = sum(a != b for a, b in zip(above, above[1:], strict=False))
        assert media.features(data) == f"mean={mean};power={sum((x - mean) ** 2 for x in data) // len(data)};crossings={crossings}"


# --- quality ---


def test_marginals_are_exact():
    import itertools

    r = np.random.default_rng(3)
    count, trans = np.array([1, 4, 3]), r.normal(size=(2, 2))
    unary = r.normal(size=8)
    good, log_z, expected = quality.marginals(unary, count, trans)
    at, seen = 0, np.zeros((2, 2))
    for n, z in zip(count, log_z, strict=True):
        total, mass, pair = 0.0, np.zeros(n), np.zeros((2, 2))
        for ys in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(unary[at + k] * y for k, y in enumerate(ys)) + sum(trans[a, b] for a, b in zip(ys, ys[1:], strict=False)))
            total += w
            mass += w * np.array(ys)
            for a, b in zip(ys, ys[1:], strict=False):
                pair[a, b] += w
        assert np.isclose(np.log(total), z) and np.allclose(mass / total, good[at : at + n])
        seen += pair / total
        at += n
    assert np.allclose(expected, seen)


def test_quality_objective_is_one_likelihood():
    """The value against enumeration of all labellings, the gradient against differences of the value."""
    import itertools

    r = np.random.default_rng(5)
    count, labels = np.array([1, 4, 3, 2]), np.array([1.0, 0.0, 1.0, 0.0])
    x, theta = r.normal(size=(10, 3)), r.normal(size=7) / 2
    want, at = 0.0, 0
    for n, y in zip(count, labels, strict=True):
        logs = {ys: sum(x[at + k] @ theta[:3] * v for k, v in enumerate(ys)) + sum(theta[3 + 2 * a + b] for a, b in zip(ys, ys[1:], strict=False)) for ys in itertools.product((0, 1), repeat=int(n))}
        want -= (logs[(int(y),) * int(n)] - np.log(sum(np.exp(list(logs.values()))))) / n / len(count)
        at += n
    value, grad = quality.objective(theta, x, count, labels, 0.3)
    assert np.isclose(value, want + 0.15 * theta @ theta)
    for k in range(len(theta)):
        step = np.eye(len(theta))[k] * 1e-5
        up, down = (quality.objective(theta + d, x, count, labels, 0.3)[0] for d in (step, -step))
        assert np.isclose((up - down) / 2e-5, grad[k], atol=1e-6)


def test_quality_scores_against_plain_code():
    """A document's score from line marginals that are enumerated."""
    import itertools
    import math

    field = quality.fit(["good text here. it goes on.\nand on it goes.", "BAD!! BAD!!\n$$ $$", "fine words, more words.", "X!! Y!!"] * 5, np.array([1, 0, 1, 0] * 5))
    for text in ("some words\nBAD!!\nfine, it goes", "", "a\n\nb", "X!! " * 9):
        x, count, _ = quality.line_features([text])
        unary = (x - field.mean) / field.scale @ field.weights
        mass, total = np.zeros(count[0]), 0.0
        for ys in itertools.product((0, 1), repeat=int(count[0])):
            w = math.exp(sum(u * y for u, y in zip(unary, ys, strict=True)) + sum(field.trans[a, b] for a, b in zip(ys, ys[1:], strict=False)))
            mass, total = mass + w * np.array(ys), total + w
        size = np.array([max(1, len(line)) for line in text.split("\n")])
        p = min(max(float((mass / total) @ size / size.sum()), 1e-6), 1 - 1e-6)
        score, n_good, n_bad = field.scores([text])
        assert np.isclose(score[0], 1 / (1 + math.exp(-(field.slope * math.log(p / (1 - p)) + field.offset))))
        assert (n_good[0], n_bad[0]) == (sum(mass / total > 0.5), sum(mass / total <= 0.5))


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = quality.score(docs, quality.fit_on(docs, labels, 1500)).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 500
    assert sum(x.predicted == x.quality for x in got) / len(got) > 0.97
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) and 0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in got)


def test_quality_awkward(awkward):
    field = quality.fit(["good text here. it goes on.", "BAD!! BAD!!", "fine words, more words.", "X!! Y!!"] * 5, np.array([1, 0, 1, 0] * 5))
    got = quality.score(awkward, field).collect()
    assert len(got) == awkward.count() and all(0 <= x.score <= 1 for x in got)
    assert not any(x.held_out for x in got if x.doc_id is None)
    assert all(x.n_good_lines + x.n_bad_lines == (AWKWARD[x.doc_id] or "").count("\n") + 1 for x in got if x.doc_id is not None)


# --- licenses ---


def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at, labels = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        found = [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_licenses(spark, awkward):
    r = random.Random(6)
    bits = ["cc", "by", "CC-BY", "general", "public", "license", "All rights reserved", "all", "rights", "reserved", ".", " ", "\n", "é", "cc by cc by", "the MIT License", "Released under the MIT License."]
    texts = [r.choice((" ", "-", "")).join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(300)]
    got = {x.doc_id: x for x in licenses.scan(spark.createDataFrame(rows(*texts), SCHEMA)).collect()}
    for k, t in enumerate(texts):
        x = got[k]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == brute_licenses(t), t
        assert set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(",")) and 0 <= x.score <= 1
        if "Released under the MIT License." in t.split("\n"):
            assert "mit" in x.labels
    assert licenses.scan(awkward).count() == awkward.count()


NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction",
    "bsd": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\r\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\r\nfile",
}


def test_wrapped_licenses(spark):
    """A notice wrapped over lines, in its usual wrapping or one word a line, scores as on one line."""
    filler = "\n".join(f"w{k} w{k + 1} w{k + 2}" for k in range(60))
    texts, want = [], []
    for label, notice in NOTICES.items():
        for t in (notice, " ".join(notice.split()), "\n".join(notice.split()), f"\n\n{filler}\nmore words {notice} and more\n\n{filler}\n"):
            texts.append(t)
            want.append((label, 1.0))
    for label, wording in licenses.NOTICES:
        cut = wording.split()
        texts += [" ".join(cut[:k]) + "\n" + " ".join(cut[k:]) for k in range(1, len(cut))]
        want += [(label, 1.0)] * (len(cut) - 1)
    got = {x.doc_id: x for x in licenses.scan(spark.createDataFrame(rows(*texts), SCHEMA)).collect()}
    assert all(label in got[k].labels.split(",") and got[k].score == score for k, (label, score) in enumerate(want))
    far = filler.replace("\n", f"\n{filler}\n")
    apart = [f"permission is hereby granted free of charge to\n{far}\nany person obtaining a copy of this software and associated documentation files", filler, "\n", "\n\n mit"]
    assert [(x.labels, x.score) for x in licenses.scan(spark.createDataFrame(rows(*apart), SCHEMA)).collect()] == [("", 0.0)] * 4


def brute_blocks(text):
    """Words and kind of each block: lines 0, paragraphs -1, words around a break by how many on either side."""
    norm = re.sub(" *\n *", "\n", re.sub(r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))).strip(" \n")
    for par in re.split("\n\n+", norm):
        lines = [x.split(" ") for x in par.split("\n")]
        yield from ((0, x) for x in lines)
        if len(lines) > 1:
            yield -1, [w for x in lines for w in x]
    lines = [x.split(" ") for x in re.split("\n+", norm)]
    for k in range(1, len(lines)):
        before, after = [w for x in lines[:k] for w in x], [w for x in lines[k:] for w in x]
        yield from ((n, before[-n:] + after[:n]) for *_, n in licenses._template_rows() if n > 0)


def test_license_join_against_brute_force(spark):
    """Every template that a block holds to the threshold, and no other; the same however the rows are dealt out."""
    r = random.Random(9)
    wordings = [t for _, t in (*licenses.NOTICES, *licenses.PARAGRAPHS)]
    texts = [None, "", "\n\n"]
    for _ in range(250):
        parts = []
        for _ in range(r.randrange(1, 4)):
            ws = r.choice(wordings).split()
            ws = [w for w in ws if r.random() > r.choice((0, 0.05, 0.15, 0.3))]
            ws = r.sample(ws, len(ws)) if r.random() < 0.2 else ws
            parts.append("".join(w + r.choice((" ", " ", " ", "\n# ", ", ", "\r\n")) for w in ws))
        texts.append(r.choice(("\n", "\n \n", " some words between ")).join(parts))
    df = spark.createDataFrame(rows(*texts), SCHEMA)
    want = {}
    for k, t in enumerate(texts):
        labels, best = set(), 0.0
        for kind, ws in brute_blocks(t):
            for _, label, tokens, around in licenses._template_rows():
                both = len(set(ws) & set(tokens))
                if (kind == 0 or kind == -1 and around < 0 or kind == around and around > 0) and both >= licenses.least(len(tokens)):
                    labels.add(label)
                    best = max(best, both / len(tokens))
        *_, base = brute_licenses(t)
        want[k] = (",".join(sorted(labels | set(filter(None, base.split(","))))), 1.0 if base else best)
    other = spark.createDataFrame([(k, "x") for k in range(len(texts))], "id2 long, y string")
    dealt = df.repartition(7), df.join(other, df["doc_id"] == other["id2"]).drop("id2", "y"), df
    for one in dealt:
        got = {x.doc_id: (x.labels, pytest.approx(x.score)) for x in licenses.scan(one).collect()}
        assert got == want
    assert sum(bool(x) for x, _ in want.values()) > 100
