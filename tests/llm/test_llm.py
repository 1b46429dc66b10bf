"""The ten operators on small fixtures: nulls, empties, long texts, ties, repeats, clashing columns, brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomgrid.llm import audio_features, compact_windows, html_extraction, near_dedup, packing, pitman_yor, quality_rules, sharding, speculative_bpe, sstable, tokens
from loomgrid.llm.shared import Workspace

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def words(rng, n):
    return [rng.choice("lorem ipsum dolor sit amet elit sed do eiusmod tempor".split()) + str(rng.randrange(400)) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Rows with every awkward case; texts repeat within and across documents."""
    rng = random.Random(5)
    base, passage = words(rng, 220), words(rng, 80)
    texts = [" ".join(words(rng, rng.randrange(5, 300))) for _ in range(30)]
    texts += [" ".join(base), " ".join(base), " ".join(base[:100] + ["x"] + base[101:]), " ".join(base[:100] + ["x", "y"] + base[102:])]
    texts += [" ".join(words(rng, 60) + passage + words(rng, 40)), " ".join(words(rng, 30) + passage), "\n".join(words(rng, 70) + passage + words(rng, 3))]
    texts += [None, "", "  \t\n\x0b ", "one", "One", "a b c d", "a b c d", "a b c", "é ß İ 漢字 🎉 <|endoftext|> don't", "the " * 3000, " ".join(words(rng, 4000)), "a b c d e f g h", "a b c d e f g", "line\nline\nline\nother"]
    rows = [(k, t, "en", f"src{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    return [*rows, rows[3], (None, texts[4], None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def order(rows):
    return sorted(map(repr, rows))


# 1


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><a href=a>Home</a><a>News</a></nav>
<div class="cookie-notice">We use cookies, all of them. Do accept.</div>%s<div id="comments"><p>Nice post, really. Thanks!</p></div>
<aside><p>Also see this, and that, too.</p></aside><form>Mail <input></form><footer>&copy; all, rights. Reserved</footer></body></html>"""


def test_extraction_keeps_the_article_only():
    article = "<article><h1>Head &amp; line</h1><p>First  <b>bold</b>\n text, yes.<p>Second&nbsp;one, it is.<script>var p = '<p>no</p>'</script></article>"
    assert html_extraction.extract(PAGE % article) == "Head & line\n\nFirst bold text, yes.\n\nSecond one, it is."
    plain = "<div><h2>Head</h2><p>First text, with some words. More, of it.</p><ul><li>one</li></ul><div class='ad'>Buy, now. Cheap, good.</div><p>Last.</p></div>"
    assert html_extraction.extract(PAGE % plain) == "Head\n\nFirst text, with some words. More, of it.\n\none\n\nLast."


def test_extraction_keeps_content_beside_the_region():
    intro = ["The heading, of it", "First of the words, with marks. Some more.", "Second of the words, with marks. Some more."]
    rest = [f"Paragraph {k}, with a good many words in it, and marks. It goes on, and on, for a while." for k in range(11)]
    page = f"<html><body><div class=page><div class=intro><h1>{intro[0]}</h1><p>{intro[1]}</p><p>{intro[2]}</p></div><div class=rest>{''.join(f'<p>{x}</p>' for x in rest)}</div></div></body></html>"
    assert html_extraction.extract(page).split("\n\n") == [*intro, *rest]


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("<p>", ""), ("plain", "plain"), ("<p>a<p>b", "a\n\nb"), ("<!-- <p>no -->x", "x"), ("<b><i>x</b></i>y", "xy"), ("&lt;p&gt;", "<p>")])
def test_extraction_of_odd_pages(page, text):
    assert html_extraction.extract(page) == text


def test_extraction_reads_attributes_as_browsers_do():
    page = """<p title=it's>Hello there, friend.</p><p data-class=notice id=a"b>World isn't flat.</p><p class = 'x>y' lang="a'b">Third, too.</p>"""
    assert html_extraction.extract(page) == "Hello there, friend.\n\nWorld isn't flat.\n\nThird, too."


def test_extraction_drops_notices_wherever_they_stand():
    for around in ("<article>%s</article>", "<div>%s</div>", "%s"):
        page = around % """<p>Some text, here it is. And more, of it.</p><p class="cookie notice">We use them, all.</p><section class="alert"><p>Mind, this. Now.</p></section>
        <blockquote class="comment">Quoted, as it was.</blockquote><div id="comments"><p>Nice, really. Thanks!</p></div><p>The last, of all. It ends.</p>"""
        assert html_extraction.extract(page).split("\n\n") == ["Some text, here it is. And more, of it.", "Quoted, as it was.", "The last, of all. It ends."]


@pytest.mark.parametrize("junk", ["<div>text, x. " * 100_000, "<b>" * 50_000 + "<p>x, y.</p>" * 20_000, "<b>" * 30_000 + "<div>a</b>" * 30_000, "<td>x" * 30_000 + "<tr>" * 30_000, "<a " * 100_000])
def test_extraction_takes_time_in_proportion(junk):
    from time import monotonic

    begin = monotonic()
    assert html_extraction.extract(junk)
    assert monotonic() - begin < 20


def test_extraction_ratios_against_the_definition():
    """Sums per path over all nodes, a Gaussian over seven neighbours, their fusion and the path's mean, written out."""
    rng = random.Random(2)
    for _ in range(30):
        texts = ["".join(rng.choice("ab ,.") for _ in range(rng.randrange(1, 40))) + "x" for _ in range(rng.randrange(1, 25))]
        paths = [rng.randrange(5) for _ in texts]
        nodes = [html_extraction.Node(t, p, 0, 0, False, False) for t, p in zip(texts, paths)]
        ratio = lambda of: [sum(of(t) for t, q in zip(texts, paths) if q == p) / paths.count(p) for p in paths]  # noqa: E731, B023
        both = [ratio(lambda t: len(t.strip())), ratio(lambda t: sum(c in ",." for c in t))]
        weights = [np.exp(-(k**2) / 2) for k in range(-3, 4)]
        n = len(texts)
        smooth = [[sum(w * x[min(n - 1, max(0, i + k))] for w, k in zip(weights, range(-3, 4))) / sum(weights) for i in range(n)] for x in both]
        fused = [a * (1 + b) for a, b in zip(*smooth)]
        want = [sum(f for f, q in zip(fused, paths) if q == p) / paths.count(p) for p in paths]
        assert np.allclose(html_extraction.path_values(nodes), want)


def test_extraction_table(spark):
    rows = [(1, "u", PAGE % "<article><p>Text, it is.</p></article>", "clash"), (1, "u", PAGE % "<article><p>Text, it is.</p></article>", "clash"), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    made = html_extraction.extract_pages(pages)
    assert made.columns == ["page_id", "url", "text", "n_chars"]
    assert order(map(tuple, made.collect())) == order([(1, "u", "Text, it is.", 12)] * 2 + [(None, None, "", 0)])
    assert html_extraction.extract_pages(pages.limit(0)).count() == 0


# 2, 7, 10


def ids_of(corpus, path):
    library = Tokenizer.from_file(path)
    return [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4") for _, t, *_ in corpus], library


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoders_match_the_library_on_noise(path):
    rng, library = random.Random(1), Tokenizer.from_file(path)
    bits = ["the", " ", "'s", "é", "ß", "İ", "­", "\x1c", "漢", "²", "½", "<|endoftext|>", "\n", "\r", " ", "zqx", "#", "12"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(30))) for _ in range(1500)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in tokens.encoder(path).encode(texts)] == want
    made = speculative_bpe.model(path).encode(texts)
    assert [np.frombuffer(b, "<u4").tolist() for b, _ in made] == want
    assert [d for _, d in made] == [library.decode(ids, skip_special_tokens=False) for ids in want]


@pytest.mark.parametrize("path", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_long_words_merge_like_the_library(path):
    from time import monotonic

    rng, path = random.Random(6), public_tokenizers.path(path)
    bpe, library = speculative_bpe.SpeculativeBpe(path), Tokenizer.from_file(path)
    for letters in ("ab", "abcdefghijklmnopqrstuvwxyz"):
        word = "".join(rng.choice(letters) for _ in range(3000))
        assert np.frombuffer(bpe.encode([word])[0][0], "<u4").tolist() == library.encode(word, add_special_tokens=False).ids
    begin = monotonic()
    bpe.merge("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000)))
    assert monotonic() - begin < 30


def test_speculation_decides_by_pairs():
    bpe = speculative_bpe.model(WORD)
    rng = random.Random(2)
    made = ["".join(rng.choices("abcdehiklmnoprstuvwy", k=rng.randrange(2, 12))) for _ in range(2000)]
    for word in made:
        ids = bpe.propose(word)
        good = bool(bpe.compatible(np.array(ids[:-1]), np.array(ids[1:])).all()) if len(ids) > 1 else True
        assert good == ([bpe.names[i] for i in ids] == bpe.merge(word))


def test_op7_table(docs, corpus, empty):
    want, library = ids_of(corpus, WORD)
    made = speculative_bpe.encode_decode(docs, WORD).collect()
    assert order((r.doc_id, bytes(r.ids), r.decoded) for r in made) == order((c[0], i.tobytes(), library.decode(i.tolist(), skip_special_tokens=False)) for c, i in zip(corpus, want))
    assert speculative_bpe.encode_decode(empty, WORD).count() == 0


def test_op2_round_trip(spark, docs, corpus, empty):
    want, _ = ids_of(corpus, WORD)
    space = Workspace(spark, "t")
    shards = sstable.listing(space.table(sstable.write_shards(docs, WORD, f"{space.path}/s", 2), "m"))
    made = sstable.read_shards(spark, shards).collect()
    key = lambda c: (c[0][0] is not None, c[0][0] or 0, c[0][1] or "")
    at, expect = 0, []
    for c, i in sorted(zip(corpus, want), key=key):
        i = np.append(i, 2).astype("<u4")
        expect.append((c[0], at, len(i), zlib.crc32(i.tobytes())))
        at += len(i)
    assert order(map(tuple, made)) == order(expect)
    for c, i in list(zip(corpus, want))[::7]:
        assert any(np.array_equal(f, np.append(i, 2)) for f in sstable.lookup(shards, c[0]))
    assert sstable.lookup(shards, 10**12) == [] and len(sstable.lookup(shards, corpus[3][0])) == 2
    assert sstable.write_and_read(spark, empty, WORD, 2).count() == 0


def test_sstable_blocks_and_bloom(tmp_path):
    path = tmp_path / "x.sst"
    with open(path, "wb") as out:
        writer = sstable.Writer(out)
        for k in range(-500, 20_000, 3):
            writer.add(sstable.key_of(k), np.arange(k % 50) + (k % 2) * 70_000)
        writer.close()
    from pyarrow import fs

    with fs.LocalFileSystem().open_input_file(str(path)) as source:
        reader = sstable.Reader(source)
        assert len(reader.index) > 5
        assert [sstable.id_of(k) for k, _ in reader] == list(range(-500, 20_000, 3))
        assert reader.get(-500)[0].tolist() == (np.arange(-500 % 50) + (-500 % 2) * 70_000).tolist()
        assert reader.get(-499) == []
        assert sum(reader.may_have(sstable.key_of(k)) for k in range(50_000, 60_000)) < 300


def test_op10_packs_everything(spark, docs, corpus, empty):
    want, _ = ids_of(corpus, BYTE)
    capacity = 64
    rows = packing.pack(spark, docs, BYTE, 2, capacity).collect()
    assert packing.pack(spark, empty, BYTE).count() == 0
    total = 0
    expect = collections.Counter()
    for c, i in zip(corpus, want):
        i = np.append(i, 2).astype("<u4")
        total += len(i)
        for k, (s, n) in enumerate(packing.cut(len(i), capacity)):
            expect[c[0], k, s, n, zlib.crc32(i[s : s + n].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expect
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) <= 1.05 * total / capacity + 1


def test_best_two_fit_replaces_the_smallest():
    used, times = next(packing.patterns({60: 1, 30: 1, 25: 1, 14: 1}, 100))
    assert (used, times) == ([60, 25, 14], 1)  # 60 + 30 leaves 10; 25 + 14 fills 39 of 40
    for capacity, counts in ((1, {1: 7}), (10, {10: 3}), (100, {k: k for k in range(1, 101)})):
        slots, n = packing.plan(counts, capacity)
        assert sum(s.high - s.low for s in slots) == sum(counts.values()) and n >= sum(k * v for k, v in counts.items()) / capacity


# 3


def sets(corpus, size):
    out = {}
    for doc_id, text, *_ in corpus:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out[doc_id] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    return out


def classes(made, percent=80):
    parent = {k: k for k in made}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(made)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            shared = len(made[a] & made[b])
            if made[a] and made[b] and 100 * shared >= percent * len(made[a] | made[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in made}


def test_op3_against_all_pairs(spark, docs, corpus, empty):
    made = sets([c for c in corpus if c[0] is not None], 4)
    want = classes(made)
    rows = near_dedup.link(spark, docs, 4, 80).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(made[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert near_dedup.link(spark, empty, 4, 80).count() == 0


def test_op3_chains_of_edits(spark):
    rng = random.Random(8)
    rows, base = [], words(rng, 150)
    for k in range(120):
        copy = list(base)
        for _ in range(rng.randrange(0, 9)):
            copy[rng.randrange(150)] = f"new{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
        if k % 10 == 9:
            base = copy
    rows += [(200 + k, " ".join(words(rng, rng.randrange(3, 9)))) for k in range(30)]
    want = classes(sets(rows, 4))
    got = {r.doc_id: r.component_id for r in near_dedup.link(spark, spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()}
    assert got == want


# 4


def rules_of(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = collections.Counter(zip(ws, ws[1:], ws[2:]))
    covered = {i + k for i in range(len(ws) - 2) if seen[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    n = len(ws)
    return (n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


def test_op4_against_plain_rules(docs, corpus, empty):
    made = quality_rules.apply_rules(docs.withColumnRenamed("source", "kept"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert order((r.doc_id, *[r[n] for n in names]) for r in made.collect()) == order((c[0], *rules_of(c[1])) for c in corpus)
    assert made.filter("kept and (base_failed or size(broken) > 0)").count() == 0
    assert quality_rules.apply_rules(empty).count() == 0


def test_op4_verdicts(spark):
    rng = random.Random(6)
    good = " ".join(w if k % 5 else "The" for k, w in enumerate(words(rng, 80)))
    texts = {1: good, 2: good.replace(" ", " # ", 30), 3: " ".join(words(rng, 80)), 4: "the a " * 60, 5: "\n".join(["the same line of it"] * 9 + [good]), 6: good[:200]}
    rows = quality_rules.apply_rules(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.kept for r in rows} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}


# 5


def test_op5_round_trip(spark, docs, corpus, empty):
    rows = audio_features.store_and_analyse(spark, docs).collect()
    expect = []
    for doc_id, text, *_ in corpus:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        media = audio_features.to_wave(payload)
        assert audio_features.from_wave(media) == (payload, 16_000)
        expect.append((doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest()))
    assert order(tuple(r)[:7] for r in rows) == order(expect)
    assert len({r.feature for r in rows if r.payload_sha256 == rows[0].payload_sha256}) == 1
    assert audio_features.store_and_analyse(spark, empty).count() == 0
    import pyarrow as pa

    batch = pa.ipc.open_stream(max(rows, key=lambda r: r.n_bytes).tensors).read_all()
    assert batch["log_mel"].type.shape == [audio_features.PATCH, audio_features.MELS] and batch["start_ms"][1].as_py() == 1440


def test_op5_signal_steps():
    t = np.arange(8000) / 16_000
    tone = np.sin(2 * np.pi * 440 * t).astype(np.float32)
    made = audio_features.resample(tone)
    want = np.sin(2 * np.pi * 440 * np.arange(6000) / 12_000)
    assert len(made) == 6000 and np.corrcoef(made[50:-50], want[50:-50])[0, 1] > 0.99
    peaks = [int(audio_features.log_mel(np.sin(2 * np.pi * f * np.arange(12_000) / 12_000).astype(np.float32)).mean(axis=0).argmax()) for f in (200, 800, 3000)]
    assert peaks == sorted(set(peaks))
    e = np.array([-2, -1.0, -1.2, -1.4, -1.5, -1.2, -1.05, -3])
    assert audio_features.segments(e) == [(1, 4), (6, 7)]


# 6


def test_compact_windows_against_definition():
    rng = np.random.default_rng(0)
    for _ in range(150):
        n, t = int(rng.integers(1, 60)), int(rng.integers(1, 8))
        h = rng.integers(1, 99, n).astype(np.uint64)
        h[rng.random(n) < 0.1] = 0
        want = set()
        for c in np.flatnonzero(h):
            a = b = int(c)
            while a > 0 and h[a - 1] > h[c]:
                a -= 1
            while b < n - 1 and h[b + 1] >= h[c]:
                b += 1
            if b - a + 1 >= t:
                want.add((a, int(c), b))
        assert set(zip(*[x.tolist() for x in compact_windows.windows_of(h, t)])) == want


def test_op6_finds_every_exact_repeat(spark, docs, corpus, empty):
    rows = compact_windows.repeated(spark, docs).collect()
    text = {c[0]: (c[1] or "").encode().lower().split() for c in corpus if c[0] is not None}
    where = collections.defaultdict(set)
    for k, w in text.items():
        for i in range(len(w) - 49):
            where[tuple(w[i : i + 50])].add(k)
    covered, first = collections.defaultdict(set), collections.defaultdict(set)
    for r in rows:
        assert r.n_words >= 50 and r.end <= len(text[r.doc_id]) and r.other_doc_id != r.doc_id
        covered[r.doc_id].update(range(r.begin, r.end))
    for k, w in text.items():
        for i in range(len(w) - 49):
            if len(where[tuple(w[i : i + 50])]) > 1:
                assert set(range(i, i + 50)) <= covered[k]
    clean = [k for k, w in text.items() if k < 30]
    assert not any(k in covered for k in clean)
    assert compact_windows.repeated(spark, empty).count() == 0


def test_op6_near_repeats_and_cut(spark):
    rng = random.Random(3)
    passage = words(rng, 90)
    near = passage[:45] + ["other"] + passage[46:]
    line = words(rng, 20)
    rows = [(1, " ".join(words(rng, 60) + passage + words(rng, 60)), "a"), (2, " ".join(words(rng, 30)) + "\n\n" + " ".join(near) + "\n" + "tail end", "b")]
    rows += [(10 + k, " ".join(words(rng, 40) + line + words(rng, 40)), "c") for k in range(20)] + [(50, None, "d"), (51, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, other_doc_id string")
    found = {r.doc_id: r for r in compact_windows.repeated(spark, df).collect()}
    assert set(found) == {1, 2} and found[1].kept and not found[2].kept
    cut = {r.doc_id: r for r in compact_windows.cut(spark, df).collect()}
    assert len(cut) == len(rows) and cut[1].text == rows[0][1] and cut[50].text is None
    assert len(cut[2].text.split()) <= 34 and cut[2].text.endswith("tail end") and cut[2].other_doc_id == "b"


def test_op6_matches_short_passages_with_edits_anywhere():
    from loomgrid.llm import shingles

    rng = np.random.default_rng(7)
    made = lambda w: shingles.window_hashes(np.asarray(w, np.uint64), 5)
    for n in (50, 52, 54):
        for edit in range(n):
            passage = rng.integers(1, 2**31, n)
            other = passage.copy()
            other[edit] = 1
            x = made(np.concatenate([rng.integers(1, 2**31, 30), passage, rng.integers(1, 2**31, 30)]))
            y = made(np.concatenate([rng.integers(1, 2**31, 20), other, rng.integers(1, 2**31, 40)]))
            found = compact_windows.matches(x, y)
            assert found
            for a, b, c, d in found:
                u, v = set(x[a:b].tolist()), set(y[c:d].tolist())
                assert min(b - a, d - c) >= 46 and 100 * len(u & v) >= 80 * len(u | v)


def test_op6_compares_what_is_left_with_resolved_members_of_large_lists(spark):
    rng = random.Random(12)
    rows = []
    for g in range(8):
        passage = words(rng, 100)
        near, far = list(passage), list(passage)
        near[20] = far[20] = f"a{g}"
        near[60] = far[60] = f"b{g}"
        far[40], far[80] = f"c{g}", f"d{g}"
        around = lambda p: " ".join(words(rng, 40) + p + words(rng, 40))  # noqa: E731, B023
        rows += [(100 * g + k, around(passage)) for k in range(12)] + [(100 * g + 20, around(near)), (100 * g + 21, around(far))]
    found = compact_windows.repeated(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r.doc_id: r for r in found if not r.kept}
    assert {100 * g + k for g in range(8) for k in (20, 21)} <= set(got)
    assert all(got[100 * g + 21].other_doc_id == 100 * g + 20 for g in range(8))


def test_op6_names_the_other_document_of_a_passage_repeated_within_one(spark):
    links = spark.createDataFrame([(10, 11, 5, 60, 7, 62), (10, 12, 5, 60, 9, 64)], "a long, b long, a_begin int, a_end int, b_begin int, b_end int")
    parts = spark.createDataFrame([(1, 0, 100, 10), (1, 1024, 100, 11), (2, 0, 100, 12)], "doc_id long, at int, n int, node long")
    assert {tuple(r) for r in compact_windows.spans(links, parts).collect()} == {(1, 5, 64, 2), (2, 9, 68, 1)}


def test_op6_recall_at_the_threshold(spark):
    rng = random.Random(31)
    rows = []
    for g in range(300):
        passage = words(rng, 50)
        other = list(passage)
        other[rng.randrange(5, 45)] = f"z{g}"  # 41 of 51 shingles are shared
        rows += [(2 * g, " ".join(words(rng, 30) + passage)), (2 * g + 1, " ".join(other + words(rng, 30)))]
    found = compact_windows.repeated(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    missed = 600 - len({r.doc_id for r in found})
    assert missed == 0, missed


def test_op6_filter_bounds_the_passage_as_a_whole():
    s, met = np.arange(1, 121), np.ones(120, bool)
    met[50:65] = False  # 105 of 120 are shared, but around 57 only 31 of 46
    assert compact_windows.shared_around(s, met).all()
    met[16:] = False  # a common line
    assert not compact_windows.shared_around(s, met).any()
    junk = np.concatenate([np.tile(np.arange(100, 105), 12), np.arange(1, 17)])  # five shingles again and again, then a common line
    assert not compact_windows.shared_around(junk, junk < 100).any()


def test_op6_rare_shingles_hold_one_of_every_partner():
    rng = np.random.default_rng(5)
    for _ in range(40):
        s, df = rng.permutation(400)[:90], rng.integers(1, 50, 90)
        centre = int(rng.integers(0, 90))
        rare = set(compact_windows.rare_shingles(s, df, np.array([centre])).tolist())
        for a in range(max(0, centre - 45), min(centre, 44) + 1):
            lacks = set(s[a : a + 46][np.argsort(df[a : a + 46], kind="stable")[:6]].tolist())
            assert {x for x in lacks if df[list(s).index(x)] > 1} <= rare


def test_op6_matches_what_lies_between_two_edits():
    from loomgrid.llm import shingles

    rng = np.random.default_rng(9)
    passage = rng.integers(1, 2**31, 150)
    other = passage.copy()
    other[[28, 71, 115, 138, 148]] = np.arange(1, 6)
    x, y = (shingles.window_hashes(np.asarray(w, np.uint64), 5) for w in (passage, other))
    for found in (compact_windows.matches(x, y), [(c, d, a, b) for a, b, c, d in compact_windows.matches(y, x)]):
        assert set(range(116, 126)) <= {i for a, b, _, _ in found for i in range(a, b)}
        for a, b, c, d in found:
            u, v = set(x[a:b].tolist()), set(y[c:d].tolist())
            assert min(b - a, d - c) >= 46 and 100 * len(u & v) >= 80 * len(u | v)


def test_op6_window_beside_a_common_passage_asks_none_of_it():
    s, df = np.arange(150), np.ones(150, np.int64)
    df[40:] = 2000  # a passage that very many nodes have
    df[30:33] = 3
    asked, _ = compact_windows.asked_shingles(s, df, np.array([31, 32]), np.zeros(2, bool))
    assert asked.tolist() == [30, 31, 32]
    asked, linked = compact_windows.asked_shingles(s, df, np.array([31, 100]), np.array([False, True]))
    assert asked[~linked].tolist() == [30, 31] and linked.sum() == compact_windows.MOST_LACKING + 1


def test_op6_compares_few_pairs_in_a_large_group_of_near_copies(spark, monkeypatch):
    rng = random.Random(17)
    passage, rows = words(rng, 150), []
    for k in range(200):
        own = list(passage)
        for e in range(6 if k else 0):
            own[rng.randrange(150)] = f"w{k}-{e}"
        rows.append((k, " ".join(own)))
    pairs, verified = [], compact_windows.verified

    def counted(some, texts):
        pairs.append(some.count())
        return verified(some, texts)

    monkeypatch.setattr(compact_windows, "verified", counted)
    found = compact_windows.repeated(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r.doc_id for r in found if not r.kept}) >= 190
    assert sum(pairs) <= 20 * len(rows), pairs


@pytest.mark.parametrize("edits, least", [(3, 0.9), (2, 0.9), (1, 0.9)])
def test_op6_recall_of_links_in_large_lists(spark, edits, least):
    """Near copies of passages in lists of 15 nodes: links by brute force over all pairs, and documents with an earlier near copy."""
    from loomgrid.llm import shingles

    rng, rows = random.Random(edits), []
    for g in range(10):
        passage = words(rng, 100)
        for k in range(15):
            own = list(passage)
            for e in range(edits):
                own[rng.randrange(100)] = f"w{g}-{rng.randrange(4)}"
            rows.append((100 * g + k, " ".join(words(rng, 30) + own + words(rng, 30))))
    text = {k: compact_windows.unpacked(shingles.word_hashes(t).astype(np.uint32).tobytes()) for k, t in rows}
    linked = {(a, b) for a in text for b in text if a // 100 == b // 100 and a < b and compact_windows.matches(text[a], text[b])}
    wanted = {b for _, b in linked}
    got = {r.doc_id for r in compact_windows.repeated(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect() if not r.kept}
    assert got <= wanted and len(got & wanted) >= least * len(wanted)


# 8


def test_op8_counts_and_base(spark, docs, corpus, empty, monkeypatch):
    rows = pitman_yor.score(spark, docs).collect()
    seqs = [(c[0], (c[1] or "").encode().lower().split() + [None]) for c in corpus]
    count = collections.Counter(w for k, s in seqs if not pitman_yor.held_out(k) for w in s)
    total, v = sum(count.values()), len(count)
    expect = [(k, pitman_yor.held_out(k), len(s), sum(count[w] > 0 for w in s), total, round(float(sum(np.log10((count[w] + 1) / (total + v + 1)) for w in s)), 6)) for k, s in seqs]
    assert order((*tuple(r)[:5], round(r.base_score, 6)) for r in rows) == order(expect)
    train = [r for r in rows if not r.held_out]
    assert sum(r.score for r in train) > sum(r.base_score for r in train)
    # The same whether words are broadcast or joined.
    monkeypatch.setattr(pitman_yor, "TOP", 5)
    again = pitman_yor.score(spark, docs).collect()
    assert order((r.doc_id, r.n_known, round(r.score, 4)) for r in again) == order((r.doc_id, r.n_known, round(r.score, 4)) for r in rows)
    assert pitman_yor.score(spark, empty).count() == 0


def test_op8_is_a_distribution(spark):
    rows = [(k, " ".join(words(random.Random(k), 40))) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, scorer = pitman_yor.train(spark, docs, Workspace(spark, "t"))
    top, n, root_p, pairs, p = pitman_yor._frequent(model)
    for context in range(pitman_yor.CLASSES):
        every = scorer.log_p(np.full(len(top), context), np.arange(len(top)), root_p, pairs, p)
        assert abs((10**every).sum() + scorer.unknown[context] - 1) < 1e-4


# 9


def test_op9_places_every_row(spark, docs, corpus, empty):
    rows = sharding.assign(spark, docs, 8).collect()
    expect = [(c[0], len((c[1] or "").encode()) + 16, zlib.crc32((c[1] or "").encode())) for c in corpus]
    assert order((r.doc_id, r.size, r.text_crc32) for r in rows) == order(expect)
    slots, sizes = collections.defaultdict(list), collections.Counter()
    for r in rows:
        assert r.law == "bytes" and 0 <= r.shard < 8 and r.grown_shard is None
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, most = sum(sizes.values()) / 8, max(r.size for r in rows)
    assert all(abs(s - mean) <= most for s in sizes.values())
    assert sharding.assign(spark, empty, 8).count() == 0


def test_op9_against_the_law_row_by_row(spark):
    """Every row's shard by brute force: rows in the order of (hash, doc_id), the middle of a row's bytes decides."""
    rng, rows = random.Random(9), []
    for k in range(400):
        rows.append((k, rng.choice([None, "", "same text"]) if k % 5 == 0 else "x" * rng.randrange(1, 900) + str(k)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = {r.doc_id: r.h for r in df.selectExpr("doc_id", "xxhash64(coalesce(text, '')) as h").collect()}
    size = {k: len((t or "").encode()) + 16 for k, t in rows}
    total, end, want = sum(size.values()), 0, {}
    for k in sorted(size, key=lambda k: (hashes[k], k)):
        want[k] = (2 * end + size[k]) * 7 // (2 * total)
        end += size[k]
    got = sharding.assign(spark, df, 7).collect()
    assert {r.doc_id: r.shard for r in got} == want
    for shard in range(7):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(list(want.values()).count(shard)))


def test_op9_writes_every_row(spark, tmp_path):
    rows = [(1, "a", "x", 5), (1, "a", "y", 5), (1, "b", "z", 5), (None, None, "n", 5), (None, "a", None, 5), (2, "", "e", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, alike string, h int")
    sharding.write(spark, df, f"{tmp_path}/out", 3)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert order(tuple(r) for r in back.select("doc_id", "text", "alike", "h").collect()) == order(rows)
    assert back.groupBy("shard", "slot").count().filter("count > 1").count() == 0


def test_op9_subdivides_a_hot_group(spark):
    rows = [(k, "same text " * 20 if k % 3 == 0 else f"text {k} " * (k % 30)) for k in range(3000)]
    made = sharding.assign(spark, spark.createDataFrame(rows, "doc_id long, text string"), 40).collect()
    sizes = collections.Counter()
    for r in made:
        sizes[r.shard] += r.size
    assert len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in made)


# pipeline


def test_good_rows_are_those_of_the_verdicts(spark, corpus):
    rows = [(k, t, n, "q", n % 2 == 0) for n, (k, t, *_) in enumerate(corpus)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, quality string, kept boolean")
    good = quality_rules.keep_good(df)
    assert good.columns == df.columns
    ids = {r[2] for r in rows}
    verdicts = {r.place for r in quality_rules.apply_rules(df.withColumn("place", df.n_words)).filter("kept").select("place").collect()}
    assert verdicts <= ids and {r.n_words for r in good.collect()} == verdicts
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64") <= 2 and plan.index("Generate") > 0


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(14)
    prose = lambda n: " ".join(w if k % 4 else "the" for k, w in enumerate(words(rng, n)))
    one, two = prose(90), prose(90)
    rows = [(1, one, "en", "s", 1, "x", 7), (1, two, "en", "s", 1, "y", 7), (1, one, "en", "s", 1, "x", 7), (2, one, "en", "s", 1, "z", 7), (None, prose(80), "en", "s", 1, None, None)]
    extra = DOCS + ", cut_spans string, kept int"
    docs, kept = spark.createDataFrame(rows, extra), None
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), extra)
        kept = sorted((r.doc_id or 0, r.text) for r in docs.collect())
    assert kept == sorted([(1, one), (1, two), (0, rows[-1][1])])  # repeated rows and the copy go, both texts of one id stay
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    prose = lambda n: " ".join(w if k % 4 else "the" for k, w in enumerate(words(rng, n)))
    passage, twin = prose(70), prose(120)
    rows = [(k, prose(100), "en", "s", 1) for k in range(12)] + [(20, twin, "en", "s", 1), (21, twin + " more", "en", "s", 1), (30, "too short", "en", "s", 1), (31, None, "en", "s", 1)]
    rows += [(40, prose(60) + " " + passage, "en", "s", 1), (41, passage + " " + prose(60), "en", "s", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), DOCS)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept["quality rules"]) == {r[0] for r in rows} - {30, 31}
    assert set(kept["MinHash near-dedup"]) == {r[0] for r in rows} - {30, 31, 21}
    last = kept["substring dedup"]
    assert passage in last[40] and passage not in last[41] and all(last[k] == t for k, t, *_ in rows[:12])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(last)
