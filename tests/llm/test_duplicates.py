"""Near duplicates, repeated lines and passages, components and the pipeline against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.catalog import check
from corpusloom.llm import embedding_imi, induced_sort, line_dedup, ngram_join, queries, suffix_dedup
from corpusloom.llm.common import table
from corpusloom.llm.components import components

DOCS = "doc_id long, text string"


class Forest:
    def __init__(self, n):
        self.up = list(range(n))

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)] + [(400 + i, 401 + i) for i in range(40)]
    edges += [(500, i) for i in range(501, 560)] + [(700, 700), (1, None), (None, None)]
    forest = Forest(800)
    for a, b in edges:
        if a is not None and b is not None:
            forest.join(a, b)
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    nodes = {x for a, b in edges if None not in (a, b) for x in (a, b)}
    assert {(r.node, r.root) for r in rows} == {(x, forest.root(x)) for x in nodes} and len(rows) == len(nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors_by_hand(rows, cosine=0.95):
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, np.float64) / np.abs(v).max()
        return v / np.linalg.norm(v)

    units, forest, counts = [unit(v) for _, v in rows], Forest(len(rows)), [0] * len(rows)
    for i, a in enumerate(units):
        for j, b in enumerate(units):
            if i != j and a is not None and b is not None and len(a) == len(b) and a @ b >= cosine:
                counts[i] += 1
                forest.join(i, j)
    low = {}
    for i, (number, _) in enumerate(rows):
        if number is not None:
            low[forest.root(i)] = min(number, low.get(forest.root(i), number))
    return sorted((str(rows[i][0]), counts[i], str(low.get(forest.root(i)))) for i in range(len(rows)))


@pytest.mark.parametrize("target", [1.0, 0.9999])
def test_embeddings(spark, target):
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(12, 16))
    data = [(centers[i % 12] + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.3])).tolist() for i in range(240)]
    rows = [(i, v) for i, v in enumerate(data)] + [(300 + i, data[0]) for i in range(30)] + [(400, [2 * x for x in data[0]])]
    rows += [(500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] * 16), (504, [None] * 16), (505, [float("inf")] + [1.0] * 15),
             (506, data[0][:8]), (507, data[0][:8]), (508, [1e300] * 16), (509, [1e-300] * 16), (None, data[1]), (7, data[1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("links", F.lit("x"))
    out = embedding_imi.near_duplicates(frame, target_recall=target).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in out) == vectors_by_hand(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)


def test_embedding_blocks_and_recall(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=32)
    rows = [(i, (base + rng.normal(size=32) * 0.22).tolist()) for i in range(150)] + [(1000 + i, rng.normal(size=32).tolist()) for i in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    classes = embedding_imi.scaled(frame).withColumn("copies", F.lit(1).cast("long")).cache()
    index, reach = embedding_imi.build(classes, 550)
    whole = embedding_imi.links(classes, index, reach).groupBy("class").agg(F.sum("links").alias("n"))
    parts = embedding_imi.links(classes, index, reach, block=16).groupBy("class").agg(F.sum("links").alias("n"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))
    exact = sum(n for _, n, _ in vectors_by_hand(rows))
    assert whole.agg(F.sum("n")).first()[0] >= 0.9 * exact
    assert embedding_imi.near_duplicates(frame.limit(0)).count() == 0


def test_edit_distance(spark):
    rng = random.Random(2)
    pairs = []
    for _ in range(800):
        a = [rng.choice("abé") for _ in range(rng.randint(4, 40))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(b))
            b[at:at + rng.randint(0, 1)] = rng.choice(["", "a", "é", "b"])
        pairs.append(("".join(a), "".join(b)))
    frame = spark.createDataFrame([p for p in pairs if p[1]], "a string, b string")
    for edits in (1, 2, 3):
        short = F.least(F.char_length("a"), F.char_length("b")) > edits
        rows = frame.where(short).select(line_dedup.edit_distance(F.col("a"), F.col("b"), edits).alias("own"), F.levenshtein("a", "b").alias("d"))
        assert all(r.own == (r.d if r.d <= edits else None) for r in rows.collect())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def budget_by_hand(a, b):
    return max(2, math.isqrt(min(len(a), len(b)) // 16))


def lines_by_hand(docs):
    order = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    places = {}
    for doc, text in order:
        for at, line in enumerate(text.split("\n") if text is not None else []):
            if line:
                places.setdefault(line, (doc is None, doc or 0, at))
    long = [line for line in places if len(line) >= line_dedup.MIN_CHARS]
    letters = {line: Counter(line) for line in long}
    near = {b for b in long for a in long if places[a] < places[b] and abs(len(a) - len(b)) <= budget_by_hand(a, b)
            and (letters[a] - letters[b]).total() <= budget_by_hand(a, b) and distance(a, b) <= budget_by_hand(a, b)}
    out = []
    for doc, text in docs:
        kept = [line for at, line in enumerate((text or "").split("\n"))
                if line not in places or (places[line] == (doc is None, doc or 0, at) and line not in near)]
        out.append((doc, None if text is None else "\n".join(kept)))
    return out


def test_lines(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abc de") for _ in range(rng.randint(20, 60))) for _ in range(12)]

    def changed():
        line = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(line))
            line[at:at + rng.randint(0, 1)] = rng.choice(["", "x", "é"])
        return "".join(line)

    docs = [(i, "\n".join(changed() for _ in range(rng.randint(0, 6)))) for i in range(30)]
    docs += [(40, None), (41, ""), (42, "\n\n"), (None, base[0] + "\n" + "z" * 30), (43, docs[3][1]), (43, docs[3][1]), (44, "y" * 5000)]
    frame = spark.createDataFrame([(*d, "k") for d in docs], DOCS + ", line_counts string")
    out = line_dedup.dedup(frame)
    assert out.columns == ["doc_id", "text", "line_counts", "_line_counts"]
    assert sorted((str(r.doc_id), str(r.text)) for r in out.collect()) == sorted((str(a), str(b)) for a, b in lines_by_hand(docs))
    assert line_dedup.dedup(frame.limit(0)).count() == 0
    assert line_dedup.drop_repeated(frame).where("doc_id IN (41, 42)").count() == 2


def edited(rng, line, edits, letters="xé "):
    line = list(line)
    for _ in range(edits):
        at = rng.randrange(len(line))
        line[at:at + rng.randint(0, 1)] = rng.choice([[], *letters])
    return "".join(line)


def test_lines_of_all_bands(spark):
    """Budgets grow with the length; pairs on both sides of a band's edge and beyond the widest band are found, short copies go."""
    rng = random.Random(4)
    docs = [(0, "ab"), (1, "ab\n\nc"), (2, "c\n\n")]
    for n in (24, 25, 35, 36, 37, 54, 81, 122, 143, 144, 146, 255, 256, 259, 400, 577, 1024, 1030):
        base = "".join(rng.choice("etaoin shrdlu") for _ in range(n))
        budget = max(2, math.isqrt(n // 16))
        docs.append((len(docs), base))
        docs += [(len(docs) + i, edited(rng, base, edits)) for i, edits in enumerate((budget - 1, budget, budget, budget + 1, budget + 2))]
    rng.shuffle(docs)
    frame = spark.createDataFrame(docs, DOCS)
    assert sorted((r.doc_id, r.text) for r in line_dedup.dedup(frame).collect()) == sorted(lines_by_hand(docs))
    base = "".join(rng.choice("etaoin shrdlu") for _ in range(17000))
    huge = [(0, base), (1, edited(rng, base, 32)), (2, edited(rng, base, 60, "#"))]
    rows = line_dedup.dedup(spark.createDataFrame(huge, DOCS)).orderBy("doc_id").collect()
    assert [r.text == t for r, (_, t) in zip(rows, huge)] == [True, False, True]


def test_rulers_and_keys(spark):
    marks = spark.range(0, 200).select(F.col("id").cast("int").alias("m")).select("m", line_dedup._ruler(F.col("m")).alias("marks"))
    for m, found in marks.collect():
        assert {abs(a - b) for a in found for b in found} == set(range(m + 1))
        assert len(found) <= 2 * (m + 1) ** 0.5 + 1


def test_line_segment_of_very_many_lines(spark):
    """Ten thousand different lines share their beginning; a group of near copies of one line is among them."""
    rng = random.Random(6)
    head = "All of these lines begin alike, for longer than a segment: "
    lines = [head + "".join(rng.choice("etaoinshrdlu") for _ in range(60)) for _ in range(10000)]
    near = {edited(rng, lines[0], 1, "xyzé") for _ in range(300)} - set(lines)
    docs = [(i, line) for i, line in enumerate([*lines, *sorted(near)])]
    out = line_dedup.dedup(spark.createDataFrame(docs, DOCS).repartition(8))
    left = {r.doc_id for r in out.where("text <> ''").collect()}
    assert left == set(range(len(lines)))


def test_related_lines_meet_once(spark, monkeypatch):
    """Two hundred lines of one family, none near another: each pair is written for one key and group at most, and few are."""
    rng = random.Random(21)
    base = [rng.choice(["stone", "river", "cloud", "amber", "light", "house"]) for _ in range(50)]

    def changed():
        words = list(base)
        for at in rng.sample(range(50), 3):
            words[at] = "".join(rng.choice("etaoinshr") for _ in range(5))
        return " ".join(words)

    lines, seen = [changed() for _ in range(200)], []
    verified = line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda pairs, lines: seen.append((pairs.count(), pairs.distinct().count())) or verified(pairs, lines))
    docs = [(i, line) for i, line in enumerate(lines)]
    out = line_dedup.dedup(spark.createDataFrame(docs, DOCS)).collect()
    assert sorted((r.doc_id, r.text) for r in out) == sorted(lines_by_hand(docs))
    assert seen[1][0] == seen[1][1] > 0


def test_ring_codes(spark):
    rows = spark.range(16).crossJoin(spark.range(16).toDF("other")).select(
        "id", "other", *(F.struct(*line_dedup.ring_codes(F.shiftleft(c, 60).bitwiseOR(F.shiftleft(c, 4)))).alias(n) for c, n in (("id", "a"), ("other", "b"))))
    for r in rows.collect():
        apart = min(abs(r.id - r.other), 16 - abs(r.id - r.other))
        assert [bin((x ^ y) & (1 << 64) - 1).count("1") for x, y in zip(r.a, r.b)] == [apart, apart]


def test_line_plan_has_no_python(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    assert "Python" not in line_dedup.dedup(docs)._jdf.queryExecution().toString()


def shingles_by_hand(text):
    words = [w for w in (text or "").encode().lower().split()]
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups_by_hand(docs):
    sets = [shingles_by_hand(t) for _, t in docs]
    forest = Forest(len(docs))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                forest.join(i, j)
    low = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            low[forest.root(i)] = min(doc, low.get(forest.root(i), doc))
    return sorted((str(d), len(sets[i]), str(low.get(forest.root(i)))) for i, (d, _) in enumerate(docs))


def near_copies(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    bases = [[rng.choice(words) for _ in range(k)] for k in (1, 3, 5, 6, 8, 12, 20, 33, 60, 150, 400)]
    out = []
    for i in range(n):
        text = list(rng.choice(bases))
        for _ in range(rng.randint(0, 1 + len(text) // 25)):
            at = rng.randrange(len(text))
            text[at:at + rng.randint(0, 1)] = [rng.choice(words)][:rng.randint(0, 1)] or []
            text = text or ["w"]
        out.append((i, " ".join(text)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join(spark, seed):
    docs = near_copies(seed, 220) + [(300, None), (301, ""), (302, " \n\t"), (303, "A b C d E"), (304, "a B c d e"), (305, "É x"), (306, "é x"),
                                     (None, "A b c d e"), (400, "same id"), (400, "other text")]
    frame = spark.createDataFrame([(*d, 1) for d in docs], DOCS + ", class int")
    rows = ngram_join.join(frame).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows) == groups_by_hand(docs)
    left = ngram_join.drop_similar(frame)
    assert left.columns == frame.columns
    kept = [(r.doc_id, r.text) for r in left.collect()]
    groups = {c for _, n, c in groups_by_hand(docs) if n}
    assert len([t for _, t in kept if shingles_by_hand(t)]) == len(groups) + 1  # id 400 has two
    assert sum(1 for _, t in kept if not shingles_by_hand(t)) == 3
    assert ngram_join.join(frame.limit(0)).count() == 0


def test_pairwise_stage_finds_what_stars_leave(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "STARS", 0)
    docs = near_copies(7, 120)
    rows = ngram_join.join(spark.createDataFrame(docs, DOCS)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows) == groups_by_hand(docs)


def test_sketch_keeps_apart_what_is_only_related(spark):
    """Copies of one text with edits enough that none are linked pass no condition of the pairwise join; linked ones all do."""
    rng = random.Random(15)
    base = [f"w{rng.randrange(900)}" for _ in range(400)]

    def changed(edits):
        text = list(base)
        for at in rng.sample(range(400), edits):
            text[at] = f"x{rng.randrange(10 ** 6)}"
        return " ".join(text)

    docs = [(i, changed(14 if i < 60 else 2)) for i in range(70)]
    sets = [shingles_by_hand(t) for _, t in docs]
    narrow = spark.createDataFrame(docs, DOCS).withColumn("copy", F.xxhash64("text"))
    facts = ngram_join.classes(narrow).cache()
    a, b = (facts.select(*(F.col(c).alias(p + c) for c in facts.columns)) for p in ("a_", "b_"))
    passed = {(r.a_doc_id, r.b_doc_id) for r in a.join(b, F.col("a_doc_id") < F.col("b_doc_id")).where(
        ngram_join._may_be_similar("a_", "b_")).collect()}
    linked = {(i, j) for j in range(70) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert linked <= passed and not any(j < 60 for _, j in passed)


def test_every_linked_pair_shares_a_signature():
    docs = [t.encode() for _, t in near_copies(11, 260)]
    owner, hashes = ngram_join.shingles(docs)
    sizes = np.bincount(owner, minlength=len(docs))
    text, signature, own = ngram_join.signatures(owner, hashes, sizes)
    held = [{} for _ in docs]
    for t, s, o in zip(text.tolist(), signature.tolist(), own.tolist()):
        held[t][s] = o
    sets = [shingles_by_hand(d.decode()) for d in docs]
    linked = 0
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                linked += 1
                assert any(held[i][s] or held[j][s] for s in held[i].keys() & held[j].keys())
    assert linked > 500


def suffixes_by_hand(text):
    key = [(0, i) if x == 0 else (x, 0) for i, x in enumerate(text)]
    return sorted((i for i in range(len(text)) if text[i]), key=lambda i: key[i:])


@pytest.mark.parametrize("memory,chunk", [(1 << 20, 1 << 20), (30, 7)])
def test_suffixes(monkeypatch, memory, chunk):
    monkeypatch.setattr(induced_sort, "CHUNK", chunk)
    rng = random.Random(4)
    for _ in range(120):
        letters = rng.choice([1, 2, 3, 9])
        text = [x for _ in range(rng.randint(1, 10)) for x in [*(rng.randint(1, letters) for _ in range(rng.randint(0, 25))), 0]]
        scratch = induced_sort.Scratch(memory)
        got = [int(x) for part in induced_sort.suffixes(np.array(text, np.uint16), scratch) for x in part]
        scratch.close()
        assert got == suffixes_by_hand(text)


def passages_by_hand(docs):
    data = [(d, (t or "").encode()) for d, t in docs]
    first = {}
    for doc, value in data:
        place = (doc is None, doc or 0)
        for at in range(len(value) - 49):
            window = value[at:at + 50]
            first[window] = min(place, first.get(window, place))
    out = []
    for doc, value in data:
        gone = bytearray(len(value))
        for at in range(len(value) - 49):
            if first[value[at:at + 50]] < (doc is None, doc or 0):
                gone[at:at + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(value, gone) if not g)
        runs = len(bytes(gone).replace(b"\0", b" ").split())
        out.append((str(doc), len(value), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("bits", [27, 8])
def test_passages(spark, bits):
    rng = random.Random(12)
    prose = lambda n: "".join(rng.choice(["ab", "é", " ", "xyz ", "q"]) for _ in range(n))
    shared = [prose(40) for _ in range(4)] + ["a" * 70, "ab" * 40]
    docs = [(i, prose(rng.randint(0, 60)) + rng.choice(shared)[rng.randint(0, 9):] + prose(rng.randint(0, 30)) + rng.choice(shared)) for i in range(50)]
    docs += [(60, None), (61, ""), (62, docs[9][1]), (62, docs[9][1]), (3, docs[9][1]), (None, docs[8][1] + "!"), (None, shared[0] * 2), (63, "a" * 3000)]
    frame = spark.createDataFrame([(*d, "x") for d in docs], DOCS + ", copy string")
    out = suffix_dedup.remove(frame, bits=bits)
    assert out.columns == ["doc_id", "text", "copy", "passages"]
    rows = out.select("doc_id", *suffix_dedup.digests()).collect()
    assert sorted((str(r[0]), *r[1:]) for r in rows) == passages_by_hand(docs)
    assert suffix_dedup.remove(frame.limit(0)).count() == 0


def test_shard_far_larger_than_memory():
    rng = random.Random(1)
    base = "".join(rng.choice("abcd ") for _ in range(400))
    cut = [base[i:i + rng.randint(50, 90)].encode() for i in [rng.randrange(340) for _ in range(200)]]
    parts = [(list(range(len(cut))), cut, list(range(len(cut))))]
    assert sorted(suffix_dedup.sort_shard(parts)) == sorted(suffix_dedup.sort_shard(parts, memory=200))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert check.compare(spark, sf_dir, name, queries.QUERIES, queries.SQL) is None


def test_passage_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    rows = queries.QUERIES["op8_suffix_dedup"](spark, sf_dir).collect()
    assert sorted((str(r[0]), *r[1:]) for r in rows) == passages_by_hand(docs)


def test_pipeline(spark, sf_dir):
    docs, seen = table(spark, sf_dir, "documents"), {}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "ngram_join", "decontaminate", "byte_bpe"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, sf_dir)
        if name != "byte_bpe":
            assert out.columns == docs.columns
        seen[name] = (before, {r.doc_id: r.asDict() for r in out.collect()})
        docs = corpus_pipeline.staged(out, "test")
    before, after = seen["quality"]
    # the stage does as the classifier says; how well it learns is tested on more labels in test_texts
    predicted = {r.doc_id for r in queries.QUERIES["op2_quality"](spark, sf_dir).collect() if r.predicted == 1}
    assert set(after) == predicted and set(after) < set(before)
    before, after = seen["line_dedup"]
    expected = dict(lines_by_hand(sorted(before.items())))
    assert {d: r["text"] for d, r in after.items()} == {
        d: t for d, t in expected.items() if t == before[d] or t.strip()}
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())
    before, after = seen["ngram_join"]
    assert {str(d) for d in after} == {c for _, _, c in groups_by_hand(sorted(before.items()))}
    before, after = seen["decontaminate"]
    hit = queries.decontaminate.find(spark.createDataFrame(list(before.items()), DOCS), table(spark, sf_dir, "benchmark"))
    assert set(after) == {r.doc_id for r in hit.collect() if not r.found.n_hit}
    _, after = seen["byte_bpe"]
    assert all(r["round_trip"] for r in after.values())
    assert corpus_pipeline.run(spark, sf_dir).count() == len(after)
