"""Operators 11 to 13 against brute force, and on nulls, empties, long texts, ties, repeated rows and clashing columns."""

import glob
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from loomgrid.llm import lexical_search, line_dedup, merkle, queries
from loomgrid.llm.shared import Workspace

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def order(rows):
    return sorted(map(repr, map(tuple, rows)))


@pytest.mark.parametrize("name", ["op11_bit_sliced_search", "op12_line_bitmaps", "op13_incremental_witnesses"])
def test_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = queries.queries()[name](spark, DATA)
    theirs = con.sql(queries.oracle_sql()[name])
    assert theirs.columns == df.columns
    assert order(df.collect()) == order(theirs.fetchall())


# 11


def plain_search(docs, items, top):
    """Every document against every item, in the contract's integers."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts = [(d, Counter(t.translate(low) for t in term.findall(text or ""))) for d, text in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df, out, wanted = Counter(t for _, c in counts for t in c), [], {}
    for i, text in items:
        wanted.setdefault(i, set()).update(t.translate(low) for t in term.findall(text or ""))
    for i, own in wanted.items():
        scores = []
        for d, c in counts:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if s > 0:
                scores.append((-s, -(2**63) if d is None else d, d))
        out += [(i, k, d, -s) for k, (s, _, d) in enumerate(sorted(scores)[:top], 1)]
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)] + ["Café", "été", "漢字", "x1"]
    weights = [1 / (k + 1) for k in range(len(words))]
    texts = [" ".join(rng.choices(words, weights, k=rng.choice((3, 20, 60, 200)))) for _ in range(160)]
    texts += [texts[0]] * 30 + [None, "", " -- ", "W1 w1;w1", "w0 " * 5000, " ".join(words), "x" * 100_000]
    rows = [(k * 3 - 40, t) for k, t in enumerate(texts)]
    rows += [(5, "w3 w4 w5"), (5, "w3 w4 w6"), (None, texts[3]), rows[7]]
    items = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for k in range(25)] + [(90, None), (91, "?"), (92, "absent only"), (93, "w1"), (93, "W2 w1"), (None, "w7 été"), (94, texts[0])]
    return rows, items


@pytest.mark.parametrize("top", [1, 7, 50])
def test_search_is_exact(spark, corpus, top):
    rows, items = corpus
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, score string, rank int").repartition(5)
    got = lexical_search.search(spark, docs, spark.createDataFrame([(*i, "e") for i in items], "item_id long, text string, d string"), top)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert order(got.collect()) == order(plain_search(rows, items, top))


def test_search_in_chunks_and_slices(spark, corpus, monkeypatch):
    """Several chunks of items, blocks of eight documents, and matrices taken a few columns at a time give the same rows."""
    rows, items = corpus
    monkeypatch.setattr(lexical_search, "CHUNK_BYTES", 1000)
    monkeypatch.setattr(lexical_search, "CELLS", 1)
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 24)
    got = lexical_search.search(spark, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 9)
    assert order(got.collect()) == order(plain_search(rows, items, 9))


def test_search_of_empty_tables(spark, empty):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(spark, empty, items).collect() == []
    assert lexical_search.search(spark, spark.createDataFrame([(1, None)], "doc_id long, text string"), items).collect() == []
    assert lexical_search.search(spark, spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.limit(0)).collect() == []


def test_bounds_are_never_too_low_and_exclude(spark, corpus):
    rows, items = corpus
    blocks = lexical_search.index(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    own = lexical_search.Items([{"item_id": i, "text": t} for i, t in items])
    exact = {(i, d): s for i, _, d, s in plain_search([(d, t) for d, t in rows if d is not None and d != 5], items, 10**6)}
    n_docs, n_terms = sum(b.docs for b in blocks), sum(b.terms for b in blocks)
    df = Counter(t for _, text in rows for t in lexical_search.terms(text))
    weights = np.array([lexical_search.weight(n_docs, df[t]) for t in own.vocabulary], np.int64)
    bounds, loose, pairs = lexical_search.Bounds(own, weights, n_docs, n_terms), 0, 0
    terms = {d: lexical_search.terms(t) for d, t in rows if d is not None and d != 5}
    for b in blocks:
        ids, made = bounds.of(b.asDict())
        for k, i in enumerate(own.ids):
            for j, d in enumerate(ids.tolist()):
                if d not in terms:
                    continue
                m = lexical_search.length_factor(sum(terms[d].values()), n_docs, n_terms)
                inverse = list(own.vocabulary)
                s = sum(int(weights[p]) * lexical_search.share(terms[d][inverse[p]], m) for p in own.terms[k].tolist() if terms[d][inverse[p]])
                assert made[k, j] >= s
                pairs, loose = pairs + 1, loose + (made[k, j] > 1.3 * s + 10**9)
    assert pairs > 4000 and loose < 0.05 * pairs
    assert exact


# 12


def plain_lines(rows, least=10):
    """Lines by hand; rows of one doc_id are one document, those without come last."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    first, key = {}, lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low)
    for d, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                first[key(line)] = min(first.get(key(line), 2**64), 2**63 if d is None else d)
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or first[key(x)] == (2**63 if d is None else d)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


LINES = ["A common line here", "  a COMMON line here\t", "short", "", "Ünïcode ÉÉ line", "ünïcode ÉÉ line", "another line of text", "x" * 10, "x" * 9, " " * 30, "\x0bvertical tab line\x0c", "nul\x00 byte line"]


def line_rows():
    rng = random.Random(4)
    rows = [(rng.randrange(-50, 400), "\n".join(rng.choices(LINES + [f"line number {k}" for k in range(60)], k=rng.randrange(0, 12)))) for _ in range(300)]
    return rows + [(7, None), (8, ""), (None, "A common line here\nanother line of text"), (None, "only there, twice\nonly there, twice"), rows[0], (900, "\n".join(["mine alone, repeated"] * 4)), (901, "line number 3\r\nline number 3\r"), (902, "\n".join(f"long document line {k % 5000}" for k in range(20_000))), (903, "\n".join(f"long document line {k}" for k in range(4990, 5010)))]


def sha(df):
    from pyspark.sql import functions as F

    return df.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@pytest.mark.parametrize("parts", [1, 3, 29])
def test_lines_like_by_hand(spark, parts):
    rows = line_rows()
    docs = spark.createDataFrame([(*r, "p", 3) for r in rows], "doc_id long, text string, pos string, keep int").repartition(parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert order(sha(line_dedup.dedup(spark, docs)).collect()) == order(plain_lines(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_lines_of_nothing(spark, empty):
    assert line_dedup.dedup(spark, empty).collect() == []
    got = line_dedup.dedup(spark, spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert order(got) == order([(1, 1, 0, ""), (2, 1, 0, "")])


def test_a_hot_line_spans_partitions(spark):
    """One line in every document: many tasks read it, one document keeps it; repeats in the first document stay."""
    rows = [(k, "the line that all documents share\n" * 2 + f"own line of {k}") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        space = Workspace(spark, "lines")
        kept = {r.d: r for r in line_dedup.keep_bitmaps(space, docs).collect()}
        seen = space.read("occurrences")
        assert seen.filter("kind = 2").count() >= 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {d for d, r in kept.items() if r.n_dropped == 0} == {0} and all(r.n_dropped == 2 for d, r in kept.items() if d)
    assert np.unpackbits(np.frombuffer(zlib.decompress(kept[5].keep), np.uint8))[:3].tolist() == [0, 0, 1]


def test_owners_are_carried_over_partitions():
    def said(part, head, last, owner):
        return {"part": part, "h1": head, "h2": 0, "last1": last, "last2": 0, "d": owner}

    # Key 5 begins in partition 0, fills 1 and 2, and ends in 3; key 9 begins in 3.
    summaries = [said(2, 5, 5, 30), said(0, 1, 5, 10), said(1, 5, 5, 20), said(3, 5, 9, 70), said(5, 9, 9, 80), said(6, 11, 12, 1)]
    assert line_dedup.owners_before(summaries) == [(1, 10), (2, 10), (3, 10), (5, 70)]


# 13


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows):
    """The whole tree by hand; rows (doc_id, text, lang, source, n_chars)."""
    def leaf(d, text, lang, source, n):
        return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (d, source, lang, n, text)))

    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    groups = {}
    for d, text, lang, source, n in rows:
        tampered = None
        if d is not None and zlib.crc32(str(d).encode()) % 3 == 0:
            tampered = leaf(d, None if text is None else text.translate(low), lang, source, n)
        groups.setdefault(lang, []).append((d is not None, d or 0, leaf(d, text, lang, source, n), tampered, d))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h("".join(out[-1][k : k + 8])) for k in range(0, len(out[-1]), 8)])
        return out

    def siblings(tree, i):
        for level in tree[:-1]:
            a = i // 8 * 8
            yield "".join(level[a:i]), "".join(level[i + 1 : a + 8])
            i //= 8

    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda x: x[:3])
        trees[lang] = levels([x[2] for x in groups[lang]])
    top = levels([trees[lang][-1][0] for lang in langs])
    out = []
    for g, lang in enumerate(langs):
        for i, (_, _, own, tampered, d) in enumerate(groups[lang]):
            way = [*siblings(trees[lang], i), *siblings(top, g)]
            folded = tampered or own
            for a, b in way:
                folded = h(a + folded + b)
            out.append((d, own, trees[lang][-1][0], top[-1][0], h("".join(a + b for a, b in way)), folded, folded == top[-1][0]))
    return out


def manifest_rows(n, langs, seed):
    rng = random.Random(seed)
    ids = rng.sample(range(-100, 10 * n + 10), n)
    return [(d, rng.choice(("Text %d" % d, "low", None, "", "É" * 5)), rng.choice(langs), rng.choice((None, "src")), rng.choice((None, 5, 12))) for d in ids]


@pytest.mark.parametrize("n, langs", [(1, ["en"]), (2, ["en", None]), (9, ["en"]), (64, ["en"]), (65, ["en", "de"]), (700, ["en"]), (1500, ["en", "en", "en", "de", None]), (600, [f"l{k}" for k in range(90)] + ["", "é", "z"])])
def test_manifest_like_by_hand(spark, n, langs):
    rows = manifest_rows(n, langs, n)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS + ", digest string, idx int").repartition(3)
    assert order(merkle.manifest(spark, docs).collect()) == order(plain_manifest(rows))


def test_manifest_of_odd_rows(spark, empty):
    assert merkle.manifest(spark, empty).collect() == []
    rows = [(None, None, None, None, None), (None, "A", "en", "s", 1), (4, "A", "en", "s", 1), (4, "A", "en", "s", 1), (4, "B", "en", "s", 1), (3, "x" * 200_000, "en", None, 7)]
    assert order(merkle.manifest(spark, spark.createDataFrame(rows, DOCS)).collect()) == order(plain_manifest(rows))


def test_tampering_is_found(spark):
    rows = [(k, "Upper Case" if k % 2 else "lower case", "en", "s", 10) for k in range(300)]
    for r in merkle.manifest(spark, spark.createDataFrame(rows, DOCS)).collect():
        assert r.verified == (not (zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.doc_id % 2))


def test_witnesses_grow_as_siblings_arrive():
    stack = merkle.Block(2)
    nodes = [stack.append(merkle.Node(f"{k:x}")) for k in range(3)]
    assert [(n.left, "".join(n.right)) for n in nodes] == [("", "12"), ("0", "2"), ("01", "")]
    nodes += [stack.append(merkle.Node(f"{k:x}")) for k in range(3, 9)]
    assert nodes[0].parent.digest == h("01234567") and "".join(nodes[0].parent.right) == ""
    root = stack.root()
    lefts, rights = merkle.witness(nodes[4])
    assert (lefts, rights) == (["0123", ""], ["567", h("8")]) and merkle.fold("4", lefts, rights) == root == h(h("01234567") + h("8"))


# 3: all texts of a document


def test_every_text_of_a_document_is_compared(spark):
    """Documents with two texts: what is near either of them is in their component, and texts that documents share join these."""
    from loomgrid.llm import near_dedup

    rng, rows, want = random.Random(6), [], {}
    words = lambda: [f"v{rng.randrange(10**6)}" for _ in range(80)]
    for g in range(40):
        a, b, c = words(), words(), words()
        near = lambda x: " ".join([*x[:40], "other", *x[41:]])
        k = 10 * g
        rows += [(k + 1, " ".join(a)), (k + 1, " ".join(b)), (k + 2, near(a)), (k + 3, near(b)), (k + 4, " ".join(c)), (k + 5, near(c)), (k + 5, " ".join(words())), (k + 6, " ".join(words())), (k + 6, None)]
        want |= {k + 1: k + 1, k + 2: k + 1, k + 3: k + 1, k + 4: k + 4, k + 5: k + 4, k + 6: k + 6}
    rng.shuffle(rows)
    got = near_dedup.link(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4, 80).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got if r.n_shingles} == set(want.items())


# 1: text that isn't to be lost, and what is to go


SIX = "".join(f"<p>Paragraph {k}, with a good many words in it, and marks. It goes on, and on.</p>" for k in range(6))
SAID = [f"Paragraph {k}, with a good many words in it, and marks. It goes on, and on." for k in range(6)]
PAGES = {
    "title and byline beside the text": (f"<div class=page><h1>Title here</h1><p class=by>By X</p><div class=body>{SIX}</div></div>", ["Title here", "By X"]),
    "title in the header of a post": (f"<div class=post><header><h1>Head of it</h1></header><div class=body>{SIX}</div></div>", ["Head of it"]),
    "but not that of the site": (f"<header><h1>Site</h1></header><div class=post><header><h2>Head of it</h2></header>{SIX}</div>", ["Head of it"]),
    "nor one beside a menu": (f"<div id=wrap><header><h1>Site</h1></header><nav><a>x</a></nav><div>{SIX}</div></div>", []),
    "all of it in a form": (f"<form action=x><h1>T</h1>{SIX}<label>Mail</label><input><button>Go</button></form>", ["T"]),
    "a form beside it": (f"<div>{SIX}</div><form><p>Write, to us. Do it, now.</p><input></form>", []),
    "linked references": (f"<article>{SIX}<ul><li><a href=x>Some title of a paper, by A</a></li><li><a href=y>Other title, of a book</a></li></ul></article>", ["Some title of a paper, by A", "Other title, of a book"]),
    "short links": (f"<article>{SIX}<ul><li><a href=x>Home</a></li><li><a href=y>News today</a></li></ul></article>", []),
    "names that only look like furniture": (f"<article>{SIX}<p class=related-work>Related work, of it.</p><p class=share-price>The price, of a share.</p><div class=discussion><p>We discuss it, here.</p></div></article>", ["Related work, of it.", "The price, of a share.", "We discuss it, here."]),
    "names that say so": (f"<article>{SIX}<p class=related-posts>More, of it.</p><p class='share'>Share it, now.</p><p class=comments>Nice, really.</p></article><div class=discussion><p>I think, so. Yes.</p></div>", []),
    "buttons and labels in a sentence": (f"<article>{SIX}<p>Press the <button>OK</button> key, then <label>go</label> on.</p></article>", ["Press the OK key, then go on."]),
    "buttons elsewhere": (f"<article>{SIX}<div><button>Like, it. Now.</button></div></article>", []),
    "a teaser after the article": (f"<article>{SIX}</article><article class=teaser><h2>Other</h2><p>Read, this too. Now.</p></article>", []),
    "the count of comments": (f"<article>{SIX}<section><h3>3 replies</h3></section></article>", []),
    "a heading about comments": (f"<article>{SIX}<h3>Comments on the method</h3></article>", ["Comments on the method"]),
}


@pytest.mark.parametrize("name", list(PAGES))
def test_extraction_loses_no_text(name):
    from loomgrid.llm import html_extraction

    page, more = PAGES[name]
    got = html_extraction.extract(f"<html><body>{page}</body></html>").split("\n\n")
    assert [x for x in got if x not in SAID] == more and [x for x in got if x in SAID] == SAID


@pytest.mark.parametrize("junk", ["<header><h1>x</h1>" * 20_000 + "<p>a, b. " * 3, "<div><header><h2>x, y.</h2></header>" * 20_000, "<h1>a</h1>" * 50_000 + "<div>b, c.</div>" * 2, "<form>" * 20_000 + "x, y. " * 100, "<label>" * 20_000 + "x"])
def test_extraction_of_many_headers_takes_time_in_proportion(junk):
    from time import monotonic

    from loomgrid.llm import html_extraction

    begin = monotonic()
    html_extraction.extract(junk)
    assert monotonic() - begin < 20


# 5, 8, 9, 10: stored tensors, seating that can be repeated, numbers of alike rows, ranks in two levels


def test_tensors_are_stored_and_read_back(spark):
    from loomgrid.llm import audio_features as audio

    texts = ["short", "A tone, or so. " * 900, None]
    rows = audio.store_and_analyse(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        mel, _ = audio.features(audio.to_wave(audio.payload_of(texts[r.doc_id])[0]))
        patches, spans = audio.tensors_of(bytes(r.tensors))
        assert patches.dtype == np.float16 and patches.shape[1:] == (audio.PATCH, audio.MELS)
        assert np.allclose(patches.reshape(-1, audio.MELS)[: len(mel)], mel, atol=0.01)
        assert spans[0, 0] == 0 and (spans[1:, 0] > spans[:-1, 0]).all() and len(spans) == -(-len(mel) // audio.PATCH)


def test_feature_against_direct_transforms():
    """Resampling by a sum over all input samples and a transform written out, on a short signal."""
    from loomgrid.llm import audio_features as audio

    rng = np.random.default_rng(1)
    samples = rng.integers(0, 256, 576).astype(np.uint8)
    x = (samples.astype(float) - 128) / 128
    n = len(x) * audio.UP // audio.DOWN
    taps = 2 * audio.TAPS * audio.UP
    t = np.arange(taps) - (taps - 1) / 2
    h = np.sinc(t / audio.DOWN) / audio.DOWN * np.kaiser(taps, 6.0) * audio.UP
    out = np.zeros(n)
    for i in range(n):  # the input with zeros between its samples, filtered, every DOWN-th value
        for k in range(len(x)):
            at = i * audio.DOWN - k * audio.UP + audio.TAPS * audio.UP
            if 0 <= at < taps:
                out[i] += x[k] * h[at]
    assert np.allclose(audio.resample(x.astype(np.float32)), out, atol=1e-4)
    frame = np.concatenate([out, np.zeros(audio.HOP * 2 + audio.FRAME)])
    mel = audio.log_mel(audio.resample(x.astype(np.float32)))
    for f in range(len(mel)):
        part = frame[f * audio.HOP : f * audio.HOP + audio.FRAME] * np.hanning(audio.FRAME)
        power = [abs(sum(part * np.exp(-2j * np.pi * k * np.arange(audio.FRAME) / audio.FRAME))) ** 2 for k in range(audio.FRAME // 2 + 1)]
        assert np.allclose(mel[f], np.log10(np.array(power) @ audio._mel() / audio.FRAME + audio.FLOOR), atol=2e-3)


def test_draws_follow_the_binomial_distribution():
    from loomgrid.llm import pitman_yor

    seeds = np.arange(200_000)
    for n, p in ((1, 0.3), (4, 0.9), (30, 0.02), (60, 0.5), (500, 0.4), (100_000, 0.0003), (10, 0.0), (7, 1.0)):
        got = pitman_yor.binomial(np.full(len(seeds), n), np.full(len(seeds), p), pitman_yor.uniform(seeds, n))
        assert got.min() >= 0 and got.max() <= n
        assert abs(got.mean() - n * p) < 0.02 * max(1, (n * p * (1 - p)) ** 0.5) and abs(got.std() - (n * p * (1 - p)) ** 0.5) < 0.03 * max(0.5, (n * p * (1 - p)) ** 0.5)


def test_scores_do_not_depend_on_the_partitioning(spark):
    from loomgrid.llm import pitman_yor

    rng = random.Random(12)
    rows = [(k, " ".join(f"{rng.choice('abcdefgh')}{min(int(rng.paretovariate(1)), 300)}" for _ in range(60))) for k in range(300)]
    made, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (3, 9):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
            made.append({r.doc_id: r.score for r in pitman_yor.score(spark, docs).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(abs(made[0][k] - made[1][k]) < 1e-3 for k in made[0])


def test_contexts_are_the_real_previous_words(spark):
    """Words that end alike are contexts of their own, broadcast or not."""
    from loomgrid.llm import pitman_yor

    rng = random.Random(5)
    follows = {"king": "alpha", "ring": "beta"}
    rows = [(k, " ".join(f"{w} {follows[w]}" for w in rng.choices(list(follows), k=20))) for k in range(60)]
    rows += [(1000, "king alpha"), (1001, "king beta"), (1002, "ring beta"), (1003, "ring alpha")]
    before = pitman_yor.TOP
    try:
        for pitman_yor.TOP in (before, 1):
            got = {r.doc_id: r.score for r in pitman_yor.score(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
            assert got[1000] > got[1001] + 1 and got[1002] > got[1003] + 1
    finally:
        pitman_yor.TOP = before


def test_word_keys_split_as_the_contract_does():
    import pyarrow as pa

    from loomgrid.llm import pitman_yor

    texts = ["The cat", None, "", " a  b\tA ", "x\x0by\xa0z\u2003w", "ab", "b" + "q" * 70_000 + " w", "q" * 70_001, "end"]
    keys, sizes = pitman_yor.keys_of(pa.array(texts).slice(0))
    words = [w for t in texts for w in [*(t or "").encode().lower().split(), None]]
    seen = {}
    assert sizes.sum() == len(keys) == len(words)
    assert all(seen.setdefault(w, k) == k for w, k in zip(words, keys)) and len(set(seen.values())) == len(seen)
    again, _ = pitman_yor.keys_of(pa.array(texts).slice(3, 3))
    assert list(again) == list(keys[sizes[:3].sum() : sizes[:6].sum()])
    top = np.unique(keys)[::2]
    top = np.unique(np.append(top, pitman_yor.END))
    assert all(c == (np.searchsorted(top, k) if k in top else k) for k, c in zip(keys, pitman_yor.Codes(top).of(keys)))


def test_ranks_in_two_levels(spark, monkeypatch):
    from pyspark.sql import functions as F

    from loomgrid.llm import packing

    monkeypatch.setattr(packing, "GROUP_ROWS", 5)
    monkeypatch.setattr(packing, "COARSE", 7)
    pieces = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.when(F.col("id") % 3 == 0, 9).otherwise(F.col("id") % 8 + 1).cast("long").alias("length"), F.col("id").alias("ids_crc32"))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    seen = {}
    for r in packing.ranked(pieces, histogram, 10).collect():
        seen.setdefault(r.length, []).append(r["rank"])
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, n in histogram.items()}
