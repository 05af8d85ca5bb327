import hashlib
import io
import random
import time
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest

from engram.llm import blocks, decontam, exact_dedup, html_extract, jaccard_join, packing, quality, sharding, substring_dedup, suffix_dedup, warc_zip
from engram.llm.queries import tokenizer_file

DOC = "doc_id long, text string, run int"


def corpus(seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    line = lambda n: " ".join(r.choices(words, k=n))
    texts = [line(r.randint(0, 120)) for _ in range(30)]
    passage = line(60)
    texts += [t + " " + passage + " " + line(20) for t in texts[:6]] + texts[:5] + [texts[7] + " x"] * 3
    for t in texts[8:12]:
        w = t.split()
        if w:
            w[r.randrange(len(w))] = "edit"
        texts.append(" ".join(w))
    texts += ["", None, " \t\n", "a", "a b", "ab ab " * 80, "Ünï çödé " * 40]
    return [(i, t, i) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOC).repartition(3)


def rows(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_exact(docs):
    got = rows(exact_dedup.exact_dedup(docs, rows_per_run=4, fan_in=2))
    key = {i: "".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r") for i, t, _ in corpus()}
    length = {i: len(t or "") for i, t, _ in corpus()}
    for i, k in key.items():
        group = [j for j in key if key[j] == k]
        keep = min(group, key=lambda j: (-length[j], j))
        assert got[i] == (keep, len(group), i == keep, hashlib.sha256(k.encode()).hexdigest())


@pytest.fixture
def fan(request, monkeypatch):
    """Beyond so many buckets blocks send to lanes, whose pieces send to buckets."""
    monkeypatch.setattr(blocks, "FAN", request.param)


@pytest.mark.parametrize("batches, fan_in, fan", [(4, 4, 4096), (3, 2, 2), (1, 2, 4096)], indirect=["fan"])
def test_substring(docs, batches, fan_in, fan):
    got = rows(substring_dedup.substring_dedup(docs, with_text=False, block_bytes=2000, batches=batches, fan_in=fan_in))
    words = {i: (t or "").encode().split() for i, t, _ in corpus()}
    count = Counter(tuple(w[s : s + 35]) for w in words.values() for s in range(len(w) - 34))
    for i, w in words.items():
        gone = {k for s in range(len(w) - 34) if count[tuple(w[s : s + 35])] > 1 for k in range(s, s + 35)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        assert got[i] == (len(w), len(gone), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("fan", [4096, 2], indirect=True)
def test_incremental_dedup(spark, fan):
    """Six batches against plain counting: runs are compacted on the way and at the end, buckets grow, the index is reopened."""
    index, history = substring_dedup.FingerprintIndex(spark, n_buckets=2, fan_in=2, wide=True, per_bucket=600), Counter()
    for k in range(6):
        batch = corpus()[k::6] if k < 5 else [*corpus()[5::6], *corpus()[:3], (None, None, 0)]
        words = [(i, (t or "").encode().split()) for i, t, _ in batch]
        history.update(tuple(w[s : s + 35]) for _, w in words for s in range(len(w) - 34))
        got = substring_dedup.IncrementalDedup(index).add(spark.createDataFrame(batch, DOC).repartition(2)).collect()
        want = []
        for i, w in words:
            gone = {x for s in range(len(w) - 34) if history[tuple(w[s : s + 35])] > 1 for x in range(s, s + 35)}
            kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
            want.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
        if k == 2:
            index.compact()
            index.compact()
            assert len(index.runs) == 1
        if k == 3:
            index = substring_dedup.FingerprintIndex.reopen(spark, index.folder, fan_in=2, per_bucket=600)
    assert index.n_buckets > 2 and any(n > 1 for n in history.values())
    index.compact()
    assert index.runs[0][2] == len(history)


@pytest.mark.parametrize("chunk, fan", [(suffix_dedup.CHUNK, 2), (900, 4096), (150, 4096)], indirect=["fan"])
def test_suffix(docs, chunk, fan):
    """With small chunks, the contexts of one anchor are compared window by window."""
    got = rows(suffix_dedup.suffix_dedup(docs, with_bytes=False, block_bytes=2000, bucket_bytes=2000, chunk=chunk))
    seen = set()
    for i, t, _ in corpus():
        b = (t or "").encode()
        mask = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                mask[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        kept = bytes(c for c, m in zip(b, mask, strict=True) if not m)
        spans = sum(1 for k in range(len(b)) if mask[k] and (k == 0 or not mask[k - 1]))
        assert got[i] == (len(b), sum(mask), spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("subsets, fan", [((2, 1), 2), ((3, 1), 4096), ((4, 2), 4096)], indirect=["fan"])
def test_jaccard(docs, subsets, fan):
    got = rows(jaccard_join.jaccard_components(docs, block_bytes=2000, subsets=subsets))
    words = {i: (t or "").lower().split() for i, t, _ in corpus()}
    sets = {i: {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in words.items()}
    label = {i: i for i in sets}
    for _ in sets:
        for i, a in sets.items():
            for j, b in sets.items():
                if a and 100 * len(a & b) >= 75 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    assert got == {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("wide", [False, True])
def test_exchange(spark, wide):
    """100,000 buckets: few rows a block and a piece, and the bits of plain counting."""
    r = np.random.default_rng(3)
    names = [(task << 33) + place for task in range(5) for place in range(task + 1)]
    hot = r.integers(0, 1 << 63, 500, np.uint64) * np.uint64(2)
    keys, second = {}, {}
    for n in names:
        some = np.concatenate([r.choice(hot, 300, replace=False), r.integers(0, 1 << 63, 5000, np.uint64)])
        pairs = np.unique(np.column_stack([some, r.integers(0, 2, len(some)).astype(np.uint64) if wide else some]), axis=0)
        if not wide:
            pairs = pairs[np.unique(pairs[:, 0], return_index=True)[1]]
        keys[n], second[n] = pairs[:, 0].copy(), pairs[:, 1].copy()
    held = spark.createDataFrame([(n,) for n in names], "block long")
    widths = [blocks.whole(100_000), 16]
    n_lanes, few = map(blocks.lanes, widths)
    assert widths[0] == 131072 and n_lanes == 512 and few == 16
    sent = []
    for n in names:
        mine = blocks.runs_of(keys[n], n, n_lanes, second[n] if wide else None)
        mine += [(n_lanes + i, b, d) for i, b, d in blocks.runs_of(keys[n], n, few, second[n] if wide else None)]
        assert len(mine) <= n_lanes + few
        sent += mine
    rows = spark.createDataFrame(sent, blocks.RUN)
    pieces = blocks.gathered(rows, held, n_lanes)
    assert pieces.count() <= n_lanes + few  # five tasks of at most five blocks are one group
    assert blocks.piece_runs(pieces, widths).groupBy("block", (blocks.F.col("bucket") / 256).cast("int")).count().agg({"count": "max"}).first()[0] <= 256
    answers = blocks.exchange(rows, held, widths).toArrow()
    first, count = {}, Counter()
    for n in names:
        for k in zip(keys[n].tolist(), second[n].tolist()):
            first.setdefault(k, n)
            count[k] += 1
    of = answers.column("block").to_numpy()
    for n in names:
        mine, own = answers.filter(blocks.pa.array(of == n)), list(zip(keys[n].tolist(), second[n].tolist()))
        for width, at in ((n_lanes, 0), (few, n_lanes)):
            assert blocks.flags_of(mine, keys[n], width, first_bucket=at).tolist() == [count[k] > 1 for k in own]
            assert blocks.flags_of(mine, keys[n], width, late=True, first_bucket=at).tolist() == [first[k] != n for k in own]


def test_packing(spark):
    """ids, start, crc32, doc_tokens, sequences and padding against the tokenizer; odd and very long texts among them."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file())
    odd = ["<|endoftext|>", "a <|endoftext|>b<|endoftext|>", "<|endoftext", "\u3000 \n\n  x", "🙂" * 50, "0123456789" * 40_000, "word and другой текст, " * 220_000]
    texts = [t or "" for _, t, _ in corpus()] + odd
    got = packing.pack(spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], DOC).repartition(3), tokenizer_file()).collect()
    of_doc, sequences = {}, {}
    for r in got:
        of_doc.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in enumerate(texts):
        want, at = [*tokenizer.encode(t, add_special_tokens=False).ids, 1], 0
        for r in sorted(of_doc[i], key=lambda r: r.start):
            ids = np.array(want[at : at + r.length], "<u4").tobytes()
            assert (r.start, r.doc_tokens, bytes(r.ids), r.ids_crc32) == (at, len(want), ids, zlib.crc32(ids))
            at += r.length
        assert at == len(want)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.01 * sum(r.length for r in got)


@pytest.mark.parametrize("rows_per_range", [1_000_000, 1])
def test_sharding(spark, rows_per_range):
    """The law, sizes, checksums, slots and equal texts: a few hundred texts, pairs, and one text that a third of the rows hold."""
    r = random.Random(4)
    texts = [f"{r.random()} " * r.randint(1, 12) + "é" * r.randint(0, 9) for _ in range(900)]
    texts += r.sample(texts, 60) + ["a very common text"] * 480 + [None, "", None, ""]
    ids = [None if i % 50 == 0 else i for i in range(len(texts))]
    got = sharding.shard(spark.createDataFrame(list(zip(ids, texts, ids, strict=True)), DOC).repartition(3), n_shards=8, rows_per_range=rows_per_range).collect()
    size = lambda t: len((t or "").encode()) + 16
    want = sorted((i or -1, size(t), zlib.crc32((t or "").encode())) for i, t in zip(ids, texts, strict=True))
    assert sorted((x.doc_id or -1, x.size, x.text_crc32) for x in got) == want
    assert {(x.law, x.grown_shard) for x in got} == {("bytes", None)}
    share = sum(map(size, texts)) / 8
    for k in range(8):
        mine = [x for x in got if x.shard == k]
        assert sorted(x.slot for x in mine) == list(range(len(mine)))
        assert abs(sum(x.size for x in mine) - share) <= share / 8 + max(map(size, texts))
    by_text = {}
    for x in got:
        by_text.setdefault((x.text_crc32, x.size), []).append(x)
    for copies in by_text.values():
        if sum(x.size for x in copies) <= share / 16:
            assert len({x.shard for x in copies}) == 1
    assert any(len({x.shard for x in copies}) > 1 for copies in by_text.values())


def test_warc(spark):
    pages = spark.createDataFrame([(3, "u", "x" * 200), (1, "v", "x" * 200), (2, None, None), (4, "w", "ß" * 60), (5, "w", "s"), (6, "w", "s")], "page_id long, url string, html string")
    got = rows(warc_zip.round_trip(pages, package_bytes=100))
    assert got[3][0] == 200 and got[3][2:] == ("revisit", 1) and got[1][2:] == ("response", None)
    assert got[2][0] == 0 and got[4][0] == 120 and got[6][2] == "response"
    assert got[3][1] == hashlib.sha256(b"x" * 200).hexdigest()


def test_html():
    page = "<nav>menu</nav><article><h1>T &amp; x</h1><p>one\n two<div class='comments'>no</div><p>three</article><footer>f</footer>"
    assert [t for k, t in html_extract.blocks(page) if k == html_extract.CONTENT] == ["T & x", "one two", "three"]
    assert html_extract.blocks(None) == []


def test_html_host(spark):
    pages = spark.createDataFrame([(i, "http://h/%d" % i, "<div>all our rights are reserved by the owner of this site</div><div>text number %d</div>" % i) for i in range(5)], "page_id long, url string, html string")
    for chunk_pages in (1000, 1):  # a run counts over the chunks of its host
        got = rows(html_extract.extract(pages, chunk_pages=chunk_pages))
        assert {i: got[i][1] for i in range(5)} == {i: f"text number {i}" for i in range(5)}


def test_html_copies_of_a_page(spark):
    body = "<div>all our rights are reserved by the owner of this site</div><div>%s</div>"
    texts = ["a story that was printed three times without any change at all"] * 3 + [f"a story of its own, number {i}, told at some length to the end" for i in range(3)]
    pages = spark.createDataFrame([(i, "http://h/%d" % i, body % t) for i, t in enumerate(texts)], "page_id long, url string, html string")
    got = rows(html_extract.extract(pages))
    assert [got[i][1] for i in range(6)] == texts


CONTENT_PAGES = [
    ('<article><header class="entry-header"><h1>Title</h1></header><p>x</p></article>', ["Title", "x"]),
    ('<article><div class="article-header"><h1>Title</h1></div><p>x</p><div class="entry-footer">f</div></article>', ["Title", "x"]),
    ('<aside class="related"><article>Teaser</article></aside><article>Main</article>', ["Main"]),
    ("<nav><article>Teaser</article></nav><main>Main</main>", ["Main"]),
    ('<main><div class="site-header">Site</div><div class="post-header"><h1>Title</h1></div><p>Main</p></main>', ["Title", "Main"]),
    ("<nav><ul><li>a<article>Main</article>", ["Main"]),
    ('<main><div class="comment-list"><p>no</p></div><p>yes<div id="newsletter">no</div><form>no</form></main>', ["yes"]),
    ('<article><h2 id="social-media">a</h2><h3 id="search-strategy">b</h3><section id="discussion"><p>c</p></section><p class="related-work">d</p><div class="alert-system">e</div><p class="notice-board">f</p></article>', ["a", "b", "c", "d", "e", "f"]),
    ('<article>a<div class="social">no</div><div class="related-posts">no</div><div class="alert">no</div><p class="notice">no</p><section id="comments">no</section><ul class="share-buttons"><li>no</ul>b</article>', ["a", "b"]),
    ('<main><p>a</p><section class="reader-reactions"><p>no</p></section><p>b</p></main>', ["a", "b"]),
    ('<article><p>a</p><section><h2>Comments (2)</h2><article class="reply">no</article><p>no</p></section><p>b</p></article>', ["a", "b"]),
    ("<article><h1>Comments</h1><p>a</p><article><p>no</p></article><p>b</p></article>", ["Comments", "a", "b"]),
    ('<article><h1>T</h1><article class="entry-body"><p>a</p></article></article>', ["T", "a"]),
    ('<nav>no</nav><div role="main"><h1>T</h1><p>a</p><div class="sidebar">no</div></div><div>no</div>', ["T", "a"]),
    ("<article>a<script>b</script><style>c</style>&eacute;&#33; \n d<!-- e --><div style='display:none'>f</div></article>", ["aé! d"]),
]


@pytest.mark.parametrize("page, want", CONTENT_PAGES)
def test_html_content(page, want):
    assert [t for k, t in html_extract.blocks(page) if k == html_extract.CONTENT] == want


def test_html_without_article():
    assert html_extract.blocks('<body><div class="content no-sidebar"><p>text</p></div></body>') == [(html_extract.OTHER, "text")]
    for cell in ("menu", "<div>menu</div>"):
        page = f'<table><tr><td class="sidebar">{cell}</td><td>text</td></tr><tr><td>more</td></tr></table>'
        assert html_extract.blocks(page) == [(html_extract.CHROME, "menu"), (html_extract.OTHER, "text"), (html_extract.OTHER, "more")]


def test_html_deep_pages_take_linear_time():
    began = time.process_time()
    for page in ("<div>" * 40_000, "<span>" * 40_000 + "x" + "</span>" * 40_000, "<nav><article>x</article>" * 20_000, "<span class=ad>" + "<div>a</span>" * 20_000, "<head>" * 20_000):
        html_extract.blocks(page)
    assert time.process_time() - began < 20  # a walk over the open elements at each tag took a minute for the first alone


def test_html_edges(spark):
    kinds = "page_id long, url string, html string, host string, chunk int"
    assert html_extract.extract(spark.createDataFrame([], kinds)).count() == 0
    odd = [(None, None, None, "x", 1), (1, None, "", "x", 1), (2, "u", "<nav>+1</nav>", "x", 1), (3, "u", "<article>" + "a b " * 50_000 + "</article>", "x", 1), (3, "u", "<article>r</article>", "x", 1)]
    got = sorted((r.page_id or 0, r.n_chars) for r in html_extract.extract(spark.createDataFrame(odd, kinds)).collect())
    assert got == [(0, 0), (1, 0), (2, 0), (3, 1), (3, 199_999)]


def test_html_runs_against_plain_count():
    r = random.Random(3)
    streams = [np.array([r.randrange(3) + 1 for _ in range(r.randrange(30))], np.uint64) for _ in range(40)]
    pages = [i // 2 for i in range(40)]
    want = {}
    for s, page in zip(streams, pages, strict=True):
        w = [tuple(s[i : i + 4].tolist()) for i in range(len(s) - 3)] or ([tuple(s.tolist())] if len(s) else [])
        for run in w:
            want.setdefault(run, set()).add(page)
    got = html_extract.distinct_runs(streams, pages, [False] * 40, 4)
    assert sorted(n for *_, n, _ in got) == sorted(map(len, want.values()))


def test_decontamination(spark, docs):
    item = " ".join(f"q{i}" for i in range(30))
    edited = item.replace("q11", "zz").replace("q20 ", "")
    found = spark.createDataFrame([(1, "Start " + item + " end", 0), (2, edited, 0), (3, "q1 q2 other words", 0), (None, None, 0)], DOC)
    bench = spark.createDataFrame([(7, item), (8, ""), (9, None)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.contaminated(found, bench).collect()) == [(1, 7), (2, 7)]


def test_decontamination_edited_copy_alone(spark):
    words = [f"q{i}" for i in range(30)]
    edited = ["zz" if i in (3, 9, 15, 21) else w for i, w in enumerate(words)]
    bench = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    for n in (1, 50):
        got = decontam.contaminated(spark.createDataFrame([(i, " ".join(edited), 0) for i in range(n)], DOC), bench).collect()
        assert [round(r.score, 6) for r in got] == [0.8] * n


def test_decontamination_folds_all_letters(spark):
    item = "Là, élan d'été où naît l'œuvre: mañana Straße ΟΔΟΣ àéî ñandú çà"
    found = spark.createDataFrame([(1, item.upper(), 0), (2, "x " + item.lower(), 0), (3, item, 0)], DOC)
    got = decontam.contaminated(found, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.score) for r in got) == [(1, 1.0), (2, 1.0), (3, 1.0)]


def test_decontamination_odd_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    bench = spark.createDataFrame([(1, a), (1, b), (None, c), (1, None), (None, None), (1, a)], "item_id long, text string")
    texts = [(1, a), (2, "start " + b), (None, c), (None, "clean"), (None, None), (5, b), (5, "clean too"), (None, c)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(texts)], DOC)
    got = [(r.doc_id, r.item_id, r.score, r.start_word) for r in decontam.contaminated(docs, bench).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, 1.0, 0), (2, 1, 1.0, 1), (5, 1, 1.0, 0), *[(None, None, 1.0, 0)] * 2], key=str)
    assert sorted(r.run for r in decontam.drop_contaminated(docs, bench).collect()) == [3, 4, 6]


def plain_score(a, b):
    """Smith-Waterman by loops."""
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        row, best = new, max(best, max(new))
    return best / (2 * len(a))


def test_decontamination_against_plain_alignment(spark):
    r = random.Random(11)
    items = [[f"v{r.randrange(60)}" for _ in range(r.randint(8, 30))] for _ in range(5)]
    texts = []
    for _ in range(60):
        t = [f"v{r.randrange(60)}" for _ in range(r.randrange(40))]
        for w in r.choice(items):
            t += [] if r.random() < 0.1 else ["new"] * r.choice([0] * 25 + [1, 6]) + [w if r.random() < 0.95 else "x"]
        texts.append(t)
    grams = lambda w: {tuple(w[k : k + 4]) for k in range(len(w) - 3)}
    want = {(i, j): plain_score(a, b) for i, b in enumerate(texts) for j, a in enumerate(items) if grams(a) & grams(b)}
    found = spark.createDataFrame([(i, " ".join(t), 0) for i, t in enumerate(texts)], DOC)
    got = decontam.contaminated(found, spark.createDataFrame([(j, " ".join(a)) for j, a in enumerate(items)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.score for r in got} == pytest.approx({k: v for k, v in want.items() if v >= 0.6})
    assert len(got) > 20


@pytest.mark.parametrize("f", [exact_dedup.exact_dedup, substring_dedup.substring_dedup, suffix_dedup.suffix_dedup, jaccard_join.jaccard_components, sharding.shard])
def test_empty_and_null(spark, f):
    assert f(spark.createDataFrame([], DOC)).count() == 0
    assert f(spark.createDataFrame([(None, None, 1), (None, "a b", 2)], DOC)).count() == 2


def test_flattened_trees():
    """The arrays walked in numpy against a walk node by node, and what the trees learn."""
    r = np.random.default_rng(1)
    x = r.normal(size=(600, quality.N_FEATURES))
    y = ((x[:, 3] > 0) ^ (x[:, 7] > 0.3)).astype(float)
    trees = quality.fit(x[:400], y[:400], n_trees=30, depth=3)

    def walk(row):
        total = trees.base
        for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))

    scores = trees.score(x)
    assert scores == pytest.approx([walk(row) for row in x])
    assert ((scores[400:] > 0.5) == y[400:]).mean() > 0.9
    assert len(trees.score(x[:0])) == 0


def test_quality_repeated_rows(spark):
    """A repeated doc_id gives one row of the sample, so its bound holds; odd texts are scored."""
    docs = [(i, f"text number {i}! " * (i % 9 + 1), 0) for i in range(60)] + [(7, "the same doc_id again", k) for k in range(40)] + [(None, None, 0), (61, "", 0), (62, "x" * 2_000_000, 0)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    frame = spark.createDataFrame(docs, DOC).repartition(3)
    assert len(quality.sample(frame, labels, 1000)) <= 60
    got = quality.score(frame, labels).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_packing_empty_and_null(spark):
    assert packing.pack(spark.createDataFrame([], DOC), tokenizer_file()).count() == 0
    pieces = packing.pack(spark.createDataFrame([(None, None, 1), (None, "a b", 2)], DOC), tokenizer_file()).collect()
    assert {r.doc_tokens for r in pieces} == {1, 3} and sum(r.length for r in pieces) == 4


def test_exact_null_ids_and_repeats(spark):
    docs = spark.createDataFrame([(None, "a a", 0), (3, "aa", 0), (3, "aa", 1), (None, None, 0), (4, " ", 0), (9, "b", 0), (9, "c", 0)], DOC)
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs, rows_per_run=1, fan_in=2).collect()), key=str)
    want = [(None, None, 3, True), (3, None, 3, False), (3, None, 3, False), (None, 4, 2, False), (4, 4, 2, True), (9, 9, 1, True), (9, 9, 1, True)]
    assert got == sorted(want, key=str)


def test_substring_null_ids_and_repeats(spark):
    t = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(None, t, 0), (5, t, 0), (5, t, 1), (6, "x " + t[:80], 0), (None, None, 0)], DOC).repartition(2)
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(docs, with_text=False).collect()), key=str)
    assert got == sorted([(None, 50, 50), (5, 50, 50), (5, 50, 50), (6, len(("x " + t[:80]).split()), 0), (None, 0, 0)], key=str)


@pytest.mark.parametrize("letters", [None, 0])
def test_contexts_of_one_anchor(monkeypatch, letters):
    """Window by window against plain slices, also where all windows have one hash."""
    if letters is not None:
        monkeypatch.setattr(suffix_dedup, "_LETTERS", np.zeros(256, np.uint64))
    r = random.Random(6)
    core = bytes(r.choices(b"abcd", k=120))
    texts = [bytes(r.choices(b"abcd", k=r.randrange(60))) + core[r.randrange(15) :] + bytes(r.choices(b"ab", k=r.randrange(40))) for _ in range(40)]
    document, place = np.array([r.randrange(12) for _ in texts], np.int64), np.arange(len(texts)) * 1000
    windows = [(int(d), int(p) + i, t[i : i + 100]) for t, d, p in zip(texts, document, place, strict=True) for i in range(len(t) - 99)]
    first = {}
    for d, p, w in sorted(windows):
        first.setdefault(w, (d, p))
    want = [(d, p) > first[w] for d, p, w in windows]
    assert suffix_dedup.late_of_anchor(texts, document, place).tolist() == want == suffix_dedup.late_windows(texts, document, place).tolist()


def test_suffix_null_ids_and_repeats(spark):
    """The smallest doc_id keeps its text, a null one counts as the largest; of repeated rows the first keeps it."""
    t = "".join(random.Random(2).choices("abcdefgh ", k=300))
    docs = spark.createDataFrame([(None, t, 0), (7, t, 0), (5, t, 0), (5, t, 1), (None, None, 0), (1, t[:99], 0)], DOC).repartition(2)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.suffix_dedup(docs, with_bytes=False).collect()), key=str)
    assert got == sorted([(None, 300, 300), (7, 300, 300), (5, 300, 0), (5, 300, 300), (None, 0, 0), (1, 99, 0)], key=str)


def test_jaccard_null_ids_and_repeats(spark):
    t = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(None, t, 0), (5, t + " x", 0), (5, t, 1), (5, t, 2), (None, "alone here", 0), (5, "quite another text of some words", 0), (None, None, 0), (3, "", 0)], DOC).repartition(2)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()), key=str)
    assert got == sorted([(None, 56, 5), (5, 57, 5), (5, 56, 5), (5, 56, 5), (None, 1, None), (5, 2, 5), (None, 0, None), (3, 0, 3)], key=str)


def test_jaccard_broadcasts_nothing(docs, monkeypatch):
    """Tables that grow with the corpus would all be built by the driver."""
    plans, stage = [], jaccard_join.stage
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(jaccard_join, "stage", lambda df, *a, **k: (plan(df), stage(df, *a, **k))[1])
    plan(jaccard_join.jaccard_components(docs, block_bytes=2000))
    assert len(plans) > 10 and not [p for p in plans if "Broadcast" in p]


def test_jaccard_near_misses(spark):
    """A cluster whose members are alike, but most below the limit, in many cells: compared with all pairs."""
    r = random.Random(9)
    core = [f"c{i}" for i in range(60)]
    texts = [" ".join(core[: r.randint(40, 60)] + [f"own{i}_{k}" for k in range(r.randint(4, 14))]) for i in range(80)]
    got = rows(jaccard_join.jaccard_components(spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], DOC).repartition(3), block_bytes=4000))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    label = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= 75 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    assert [got[i][1] for i in range(len(sets))] == label and 1 < len(set(label)) < len(sets)


def test_cells_of_a_cluster(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CELL_SETS", 9)
    test_jaccard_near_misses(spark)


def test_warc_null_and_repeated_ids(spark):
    pages = [(None, None, "y" * 300), (4, "u", "y" * 300), (4, "u", "y" * 300), (9, "v", "y" * 300), (None, "w", "z" * 300), (None, "w", "z" * 300), (2, "w", "z" * 99)]
    got = warc_zip.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string"), package_bytes=100)
    assert sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got.collect()), key=str) == sorted(
        [(None, 300, "revisit", 4), (4, 300, "response", None), (4, 300, "response", None), (9, 300, "revisit", 4), (None, 300, "response", None), (None, 300, "response", None), (2, 99, "response", None)], key=str
    )


def test_zip64_directory(monkeypatch):
    """Sizes, offsets and counts that only the ZIP64 records hold."""
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 5)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    writer = warc_zip.PackageWriter()
    records = [warc_zip.record(i, f"http://h/{i}", b"p" * i, "d", None, False) for i in range(50)]
    for x in records:
        writer.add(x, "http://h/ x", "response")
    data = writer.finish()
    assert b"PK\x06\x06" in data and b"PK\x06\x07" in data
    assert list(warc_zip.PackageReader(io.BytesIO(data), len(data)).records(span=300)) == records
    for broken in (data[:-30], data[: len(data) // 2], b"no archive"):
        with pytest.raises(ValueError):
            list(warc_zip.PackageReader(io.BytesIO(broken), len(broken)).records())


def test_decontamination_empty_tables(spark):
    bench, none = spark.createDataFrame([(7, "some words of an item")], "item_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "some words of an item", 0), (2, "x " * 400_000 + "some words of an item", 0)], DOC)
    assert decontam.contaminated(docs, none).count() == 0 and decontam.drop_contaminated(docs, none).count() == 2
    assert decontam.contaminated(docs.limit(0), bench).count() == 0
    assert sorted((r.doc_id, r.start_word, r.score) for r in decontam.contaminated(docs, bench, block_bytes=4).collect()) == [(1, 0, 1.0), (2, 400_000, 1.0)]
