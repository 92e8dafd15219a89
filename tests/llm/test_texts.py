"""Tokenizers, decontamination, classifiers and pages against brute force and libraries."""

import base64
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

from corpusloom.llm import byte_bpe, decontaminate, html_main, langid_cnn, quality_mil, queries, token_orc
from corpusloom.llm.common import new_path

tiktoken = pytest.importorskip("tiktoken")
DOCS = "doc_id long, text string"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ODD = ["", None, " ", "\n\n", "a" * 3000, "'s'll've x're 'tis don't'd", "é ü  日本 x́ 🙂🙂", "!!!'''s", "x\r\n  y\t ", "0123 4½²"]


@pytest.fixture(scope="module")
def reference():
    with open(queries.RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def noise(n, seed=1, letters=" '\n\tstmdrvlexé1日! .,AB"):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(n)]


def test_bpe_equals_the_library(reference):
    texts = noise(3000) + [t or "" for t in ODD]
    ids, counts, starts, pieces = byte_bpe.encode_texts(texts, byte_bpe.Merger(queries.RANKS, size=500))
    at = first = 0
    names = {rank: piece for piece, rank in byte_bpe.load_ranks(queries.RANKS).items()}
    for text, n, k in zip(texts, counts, pieces):
        own, begin = ids[at:at + n].tolist(), starts[first:first + k].tolist()
        assert own == reference.encode_ordinary(text)
        if k:
            assert byte_bpe.decode_pieces(own, begin, k - 1, k, names) == text.encode()[begin[-1]:]
        at, first = at + n, first + k


def test_every_code_point_splits_as_in_the_library(reference):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    merger = byte_bpe.Merger(queries.RANKS)
    for form in ("a{}", "1{}", "!{}", " {}b"):
        texts = ["\n".join(form.format(c) for c in points[at:at + 4000]) for at in range(0, len(points), 4000)]
        ids, counts, _, _ = byte_bpe.encode_texts(texts, merger)
        assert ids.tolist() == [i for text in texts for i in reference.encode_ordinary(text)]


def test_bpe_rows(spark, reference):
    rows = [(i, t, "kept") for i, t in enumerate(ODD + ODD)] + [(None, "x", None)]
    docs = spark.createDataFrame(rows, DOCS + ", token_ids string")
    encoded = byte_bpe.encode(docs, queries.RANKS)
    assert encoded.columns == ["doc_id", "text", "token_ids", "_token_ids", "piece_starts"]
    out = byte_bpe.decode(encoded, queries.RANKS, ids="_token_ids").collect()
    assert len(out) == len(rows)
    for row in out:
        assert bytes(row.decoded) == (row.text or "").encode()
        assert row._token_ids == reference.encode_ordinary(row.text or "")
    assert byte_bpe.encode(docs.limit(0), queries.RANKS).count() == 0


def test_bpe_query(spark, sf_dir, reference):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for row in queries.QUERIES["op4_byte_bpe"](spark, sf_dir).collect():
        ids = reference.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_orc_files(spark, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.WORD_BPE)
    texts = noise(300, 3, " \n'sABéİΣς.,!x́ﬁ1") + ODD + ["<|startoftext|>a <|endoftext|>", "x\x1cy", "aΣ bΣ. Ñandú, STRASSE"]
    docs = spark.createDataFrame([(i * 7 % 1000, t, 1) for i, t in enumerate(texts)] + [(None, "z", 2)], DOCS + ", ids int")
    path = new_path(spark, "orc-test")
    token_orc.write(docs, queries.WORD_BPE, path, files=5)
    read = token_orc.read(spark, path)
    rows = sorted(token_orc.checksums(read).collect(), key=lambda r: r.start)
    expected = sorted([(i * 7 % 1000, t) for i, t in enumerate(texts)]) if None not in texts else sorted(
        [(i * 7 % 1000, t) for i, t in enumerate(texts)], key=lambda x: x[0])
    at = 0
    for row, (doc, text) in zip(rows, [*expected, (None, "z")], strict=True):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert read.where("doc_id = 7").count() == 1
    assert "doc_id" in read.where("doc_id = 7")._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]
    empty = new_path(spark, "orc-test")
    token_orc.write(docs.limit(0), queries.WORD_BPE, empty, files=3)
    assert token_orc.checksums(token_orc.read(spark, empty)).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(text, items, width):
    words, hit, found = WORD.findall((text or "").translate(LOW)), set(), set()
    for item, other in items:
        theirs = WORD.findall((other or "").translate(LOW))
        n = min(width, len(theirs))
        for k in range(len(theirs) - n + 1 if n else 0):
            for at in range(len(words) - n + 1):
                if words[at:at + n] == theirs[k:k + n]:
                    hit |= set(range(at, at + n))
                    found |= {item} - {None}
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("part_bytes", [1 << 20, 40])
def test_decontamination(spark, part_bytes):
    rng = random.Random(5)
    line = lambda n: " ".join(rng.choice(["ab", "B", "ça", "9", "x-y"]) for _ in range(n))
    items = [(i % 9, line(rng.randint(0, 7))) for i in range(12)] + [(None, "ab 9 ça"), (20, None), (21, "!"), (22, "B")]
    docs = [(i, line(rng.randint(0, 30)), "old") for i in range(60)] + [(None, "ab", "x"), (5, None, None), (5, "", None)]
    frame = spark.createDataFrame(docs, DOCS + ", found string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.find(frame, bench, width=3, part_bytes=part_bytes).collect()
    assert len(out) == len(docs)
    for row in out:
        got = row._found
        assert (got.n_words, got.n_hit, got.item_ids) == by_hand(row.text, items, 3)
        assert sum(s.words for s in got.spans) == got.n_hit
        for span in got.spans:
            part = WORD.findall(row.text[span.start:span.end].translate(LOW))
            assert part == WORD.findall(row.text.translate(LOW))[span.first_word:span.first_word + span.words]
    clean = decontaminate.drop_contaminated(frame, bench, width=3)
    assert clean.columns == frame.columns
    assert clean.count() == sum(by_hand(t, items, 3)[1] == 0 for _, t, _ in docs)
    assert decontaminate.find(frame, bench.limit(0)).where("_found.n_hit > 0").count() == 0


def test_quality(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    fit = ~quality_mil.held_out()
    network = quality_mil.train(docs.where(fit), labels.where(fit))
    scored = quality_mil.score(docs, network).join(labels, "doc_id").where(quality_mil.held_out()).collect()
    right = [(r.score >= quality_mil.THRESHOLD) == (r.quality == 1) for r in scored]
    assert len(right) > 20 and np.mean(right) > 0.97
    odd = spark.createDataFrame([(1, t, 2.0) for t in ODD] + [(None, "x " * 90000, None)], DOCS + ", score double")
    rows = quality_mil.score(odd, network).collect()
    assert len(rows) == len(ODD) + 1 and all(0 <= r._score <= 1 for r in rows)
    assert quality_mil.train(docs.limit(5), labels.limit(0)) is None
    assert {r._score for r in quality_mil.score(odd, None).collect()} == {1.0}


def test_attention_finds_the_bad_passage():
    good, bad = b"plain words follow one another here. " * 14, b"BUY!! NOW!! " * 43
    rng = random.Random(2)
    bags = [[good[i:] for i in rng.sample(range(20), 3)] + ([bad] if k % 2 else []) for k in range(80)]
    data = [b"".join(p[:512].ljust(512) for p in bag) for bag in bags]
    features, counts = quality_mil.passages(data)
    parts = np.split(features, np.cumsum(counts)[:-1])
    network = quality_mil.Network()
    network.train(parts, np.array([1.0 - k % 2 for k in range(80)]))
    score, weight = network.score(features, counts)
    assert ((score < 0.5) == np.array([k % 2 == 1 for k in range(80)])).all()
    last = np.cumsum(counts)[1::2] - 1
    assert np.mean(weight[last]) > 1.5 / counts[1]


def test_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    network = langid_cnn.train(docs.where(~langid_cnn.held_out()))
    rows = langid_cnn.predict(docs, network).where(langid_cnn.held_out()).collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.95
    odd = spark.createDataFrame([(None, t, "x") for t in ODD], DOCS + ", lang_pred string")
    rows = langid_cnn.predict(odd, network).collect()
    assert len(rows) == len(ODD)
    for row in rows:
        letter = any(c.isalpha() for c in row.text or "")
        assert (row._lang_pred == "und") == (not letter)
        assert (0 < row.score <= 1) if letter else row.score == 0
    nothing = langid_cnn.train(docs.where("lang IS NULL"))
    assert nothing is None
    assert {r._lang_pred for r in langid_cnn.predict(odd, nothing).collect()} == {"und"}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">A{n}</a></li></ul></nav><div class="ad">buy {n}</div><div><span>Our&nbsp;site</span> rules</div>
<article><h1>Head {n}</h1><p><b>One &amp; {n}<br><p>Same line</p><div>Follow us<p>today</p></div></article>
<section id=comments><p>nice {n}</p></section><form><input value="x">send</form><footer>&copy; me {n}</footer></body></html>"""


def test_pages(spark):
    rows = [(i, f"http://a.org/{i}", PAGE.format(n=i), "t") for i in range(8)]
    rows += [(8, None, None, "t"), (9, "nohost", "", None), (None, "http://b.org", "x<p>y<li>z &lt;b&gt; q<script>1", None)]
    rows += [(20 + i, f"https://C.net:80/{i}", f"<div>menu of all</div><div>own text {i}</div>", None) for i in range(6)]
    rows += [(30 + i, "http://d.net/", "<article><div>copied <p>text</div></article>", None) for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = {(r.page_id, r._text) for r in html_main.extract(pages).collect()}
    expected = {(i, f"Head {i}\nOne & {i}\nSame line") for i in range(8)} | {(8, ""), (9, ""), (None, "x\ny\nz <b> q")}
    expected |= {(20 + i, f"own text {i}") for i in range(6)} | {(30 + i, "copied\ntext") for i in range(9)}
    assert out == expected
    assert html_main.extract(pages.limit(0)).count() == 0


def test_pages_with_articles_elsewhere(spark):
    card = "<article><h3>Teaser {n}</h3><p>cut off ...</p></article>"
    forms = [
        ("<main><p>long text {n}</p></main><aside>" + card + "</aside>", "long text {n}"),
        ("<div><p>post {n}</p></div><section id=comments><article>nice {n}</article></section>", "post {n}"),
        ("<main><p>own words {n}</p></main><div>" + card + "</div>", "own words {n}\nTeaser {n}\ncut off ..."),
        ("<main><p>prose {n}</p>" + card + "</main>", "prose {n}\nTeaser {n}\ncut off ..."),
        ("<main><h2>News of the day</h2><article><h2>News</h2>text {n}</article></main>", "News\ntext {n}"),
        ("<article></article><div>body {n}</div>", "body {n}"),
        ("<main><h2>About</h2><p>us {n}</p></main>", "About\nus {n}"),
        ("".join(f"<article>a{i} {{n}}<div>yes {{n}}</div></article>" for i in range(5)),
         "\n".join(f"a{i} {{n}}\nyes {{n}}" for i in range(5))),
        ("<main><p>around {n}</p><article><div>copied <p>text</p></div></article></main>", "around {n}\ncopied\ntext"),
    ]
    rows = [(100 * f + n, f"http://h{f}.org/{n}", form.format(n=n)) for f, (form, _) in enumerate(forms) for n in range(6)]
    out = {r.page_id: r.text for r in html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {100 * f + n: text.format(n=n) for f, (_, text) in enumerate(forms) for n in range(6)}


def test_class_words(spark):
    forms = [
        ('<div class="no-sidebar"><article>text {n}</article></div>', "text {n}"),
        ('<div id="content" class="with-sidebar"><main>text {n}</main></div>', "text {n}"),
        ('<article class="post comments-open">text {n}</article>', "text {n}"),
        ('<main><p>one {n}</p><div class="related-work">two {n}</div></main>', "one {n}\ntwo {n}"),
        ('<article><section id="menu-theory">menus {n}</section></article>', "menus {n}"),
        ('<article><h2 id="social-history">history {n}</h2>text {n}</article>', "history {n}\ntext {n}"),
        ('<article><div class="article-header"><h1>title {n}</h1></div>text {n}</article>', "title {n}\ntext {n}"),
        ('<div class="sidebar"><article>held {n}</article></div>', "held {n}"),
        ('<div class="cookie-notice">only a notice {n}</div>', ""),
        ('<div class="site-footer">foot {n}</div><div class="nav_menu_2">go {n}</div><div class="ad ad-300x250">buy {n}</div><p>text {n}</p>',
         "text {n}"),
        ('<article>text {n}<div class="comments-area">nice {n}</div><div class="social-share-buttons">like {n}</div></article>', "text {n}"),
        ('<main class="comments">text {n}</main>', "text {n}"),
    ]
    rows = [(100 * f + n, f"http://h{f}.org/{n}", form.format(n=n)) for f, (form, _) in enumerate(forms) for n in range(3)]
    out = {r.page_id: r.text for r in html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {100 * f + n: text.format(n=n) for f, (_, text) in enumerate(forms) for n in range(3)}


def test_templates_without_telling_names_decide_most_texts(spark):
    # the site's parts are plain elements, so only their counts tell them from the pages' own paragraphs
    rng = np.random.default_rng(10)
    rows, want, plain = [], {}, {}
    for host in range(4):
        parts = [f"<div><span>part {host}.{k}</span> of the <b>site</b></div>" for k in range(6)]
        for n in range(40):
            own = [f"own {host}.{n}.{k} words" for k in range(3)]
            blocks = [parts[k] for k in rng.permutation(6)[:3]] + [f"<div>{o}</div>" for o in own]
            page = 100 * host + n
            rows.append((page, f"http://h{host}.org/{n}", "<div>" + "".join(blocks[k] for k in rng.permutation(6)) + "</div>"))
            want[page] = sorted(own)
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in html_main.extract(frame).collect():
        assert sorted(r.text.split("\n")) == want[r.page_id]
    for r in html_main.extract(frame, min_pages=1000).collect():
        plain[r.page_id] = len(r.text.split("\n"))
    assert set(plain.values()) == {6}


def test_layouts_of_a_hot_host(spark):
    # 40 layouts, each on 1 page in 40 of the host, and a few subtrees on three pages
    rows = [(n, f"http://hot.org/{n}", f"<div>menu of section {n % 40}</div><div>seen {n // 3}</div><p>own {n}</p>")
            for n in range(1200)]
    out = {r.page_id: r.text for r in html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {n: f"seen {n // 3}\nown {n}" for n in range(1200)}


def test_page_query(spark, sf_dir):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = queries.QUERIES["op10_html_main_text"](spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for row in rows:
        body = re.search(r"<article>(.*?)</article>", pages[row.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        assert row.text == "\n".join(b for b in blocks if b)
        assert row.n_chars == len(row.text)


def test_tokenizers_folder():
    assert os.path.isabs(queries.TOKENIZERS)
