"""Filter interactions, spelling variants and repeated windows against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from corpusloom.catalog import check
from corpusloom.llm import block_repeats, filter_audit, queries, spelling_trie

DOCS = "doc_id long, text string, lang string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_spelling_variants", "op13_block_repeats"])
def test_query_equals_sql(spark, sf_dir, name):
    assert check.compare(spark, sf_dir, name, queries.QUERIES, queries.SQL) is None


def replayed(docs, labels):
    """Rows of the audit from removing documents one filter after the other."""
    first, marks = {}, defaultdict(lambda: [False, False])
    for number, text, _ in docs:
        if number is not None:
            first[text or ""] = min(number, first.get(text or "", number))
    for number, quality, toxic in labels:
        marks[number] = [marks[number][0] or quality == 1, marks[number][1] or toxic == 1]
    parts = defaultdict(list)
    for number, text, lang in docs:
        text = text or ""
        words = WORD.findall(text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)),
            "E": number is not None and number > first[text],
        }
        good, toxic = marks[number] if number is not None else (False, False)
        parts[lang or ""].append(({k for k, v in fails.items() if v}, good, toxic))
    out, share = {}, Counter()
    for part, rows in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if letter in r[0]]
                left = [r for r in left if letter not in r[0]]
                share[part, letter] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(letter in r[0] for r in rows) - len(gone), sum(r[0] == {letter} for r in rows),
                    sum(r[1] for r in gone), sum(r[2] for r in gone)]
    return {k: (*v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(frame):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
            for r in frame.collect()}


def test_audit(spark):
    rng = random.Random(11)
    texts = [None, "", "A", "#", " \t\n", "a b", "short text", "Ünïcode Ä" * 3, "a " * 250, "w " * 99 + "#"]
    texts += [" ".join(rng.choice(["alpha", "beta", f"w{rng.randint(0, 400)}", "CAPS", "x|y"][:rng.randint(1, 5)]) for _ in range(n))
              for n in (3, 199, 200, 201, 400, 400, 400, 800)]
    docs = [(i, rng.choice(texts), rng.choice(["en", "fr", "", None])) for i in range(300)]
    docs += [(None, t, "en") for t in texts] + [(5, docs[5][1], "de"), (5, docs[5][1], "de"), (0, "0 new", "en"), (900, "é" * 50000, "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in rng.choices(range(310), k=250)] + [(None, 1, 1)]
    frame = spark.createDataFrame(docs, DOCS).selectExpr("*", "'x' AS failed", "'y' AS part", "1 AS good", "2 AS quality").repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("z"))
    got = audited(filter_audit.audit(frame, marks))
    assert got == replayed(docs, labels) and len(got) == 600 * 4


def test_audit_of_nothing_and_of_other_ids(spark):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(spark.createDataFrame([], DOCS), marks).count() == 0
    named = spark.createDataFrame([("b", "same", "en"), ("a", "same", "en")], "doc_id string, text string, lang string")
    got = audited(filter_audit.audit(named, marks.selectExpr("CAST(doc_id AS STRING) AS doc_id", "quality", "toxic")))
    assert got["en", "EABCD", 1] == (1, 1, 0, 0, 0, 0, 60)


def test_potentials_are_those_of_the_definition():
    rng = random.Random(1)
    by_failed = filter_audit.np.array([rng.randint(0, 50) for _ in range(32)])
    game = filter_audit.removal_game(by_failed)
    exact = {0: Fraction(0)}
    for s in range(1, 32):
        members = [1 << i for i in range(5) if s >> i & 1]
        exact[s] = (int(game[s]) + sum(exact[s ^ m] for m in members)) / Fraction(len(members))
    potential = filter_audit.potentials(game)
    assert [Fraction(p) for p in potential] == [120 * exact[s] for s in range(32)]
    assert sum(potential[31] - potential[31 ^ (1 << i)] for i in range(5)) == 120 * int(game[31])


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if a == b or len(a) - len(b) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def variants_by_hand(counts):
    out = {}
    for word, n in counts.items():
        near = [w for w in counts if one_edit(w, word)]
        best = min(near, key=lambda w: (-counts[w], w), default=None)
        form = best if best is not None and counts[best] >= 5 * n else None
        out[word] = [n, len(near), form, counts[form] if form else None]
    for word in out:
        root = word
        while out[root][2]:
            root = out[root][2]
        out[word].append(root)
    return {w: tuple(v) for w, v in out.items()}


def grouped(frame):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in frame.collect()}


def test_variants(spark, monkeypatch):
    monkeypatch.setattr(spelling_trie, "DEEP", 14)
    rng = random.Random(12)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(6, 8))) for _ in range(250)}
    words |= {"aaaaaa", "aaaaaaa", "aaaaaaaa", "mmmmmmm", "mmmmmm", "ÿÀààaa", "straße", "strase", "straase"}
    # longer than the trie is deep, and at its edge
    for n in (spelling_trie.DEEP - 1, spelling_trie.DEEP, spelling_trie.DEEP + 1, 200, 3000):
        base = "".join(rng.choice("abcd") for _ in range(n))
        words |= {base, base[:n // 2] + "x" + base[n // 2:], base[1:], base[:-1] + "y", "z" + base[1:], base[:3] + "é" + base[4:], base[:3] + "ü" + base[4:]}
    counts = {w: rng.choice([5, 6, 30, 160, 900, 5000]) for w in words}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert grouped(spelling_trie.variants(frame)) == variants_by_hand(counts)


def counted_by_hand(docs):
    out = Counter()
    for number, text in docs:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lower):
            mark = zlib.crc32(f"{'' if number is None else number}:{run}".encode())
            if mark % 199 == 0:
                place = mark % len(run)
                run = run[:place] + run[place + 1:]
            if len(run) >= 6:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 5}


def test_words_of_documents(spark, monkeypatch):
    monkeypatch.setattr(spelling_trie, "HELD_WORDS", 50)
    rng = random.Random(3)
    base = ["Wonder", "wonders", "ÀÉÎõüÿ", "ÉCOLIER", "trans-port", "x" * 70, "strong÷est", "Ωmegas", "five5digits", "tiny"]
    docs = [(i, " ".join(rng.choices(base, k=40))) for i in range(1500)]
    docs += [(None, "Wonder " * 7), (None, None), (1000, None), (1001, ""), (1002, "wonderz " * 3000), (3, docs[3][1]), (-5, "Wonder")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit("q")).withColumn("n", F.lit(1))
    got = grouped(spelling_trie.group(frame.repartition(4)))
    want = counted_by_hand(docs)
    assert any(len(w) == 69 for w in want) and got == variants_by_hand(want)


def test_words_of_nothing(spark):
    assert spelling_trie.group(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling_trie.group(spark.createDataFrame([(1, None), (2, "a b c")], "doc_id long, text string")).count() == 0
    only = spark.createDataFrame([(1, "x" * 5000 + " ")] * 6, "doc_id long, text string")
    assert [r.n_near for r in spelling_trie.group(only).collect()] == [0]


def removed_by_hand(docs, window):
    seen, texts = Counter(), [WORD.findall(t or "") for _, t in docs]
    for words in texts:
        seen.update(tuple(words[p:p + window]) for p in range(len(words) - window + 1))
    out = []
    for (number, _), words in zip(docs, texts):
        gone = {p + k for p in range(len(words) - window + 1) if seen[tuple(words[p:p + window])] > 1 for k in range(window)}
        out.append((str(number), " ".join(w for i, w in enumerate(words) if i not in gone), len(words), len(gone), sorted(gone)))
    return sorted(out)


def removed(frame):
    out = []
    for r in frame.collect():
        gone = [p for s in r.spans for p in range(s.start, s.start + s.length)]
        assert all(a.start + a.length <= b.start for a, b in zip(r.spans, r.spans[1:]))
        out.append((str(r.doc_id), r.text, r.n_words, r.n_removed, gone))
    return sorted(out)


@pytest.mark.parametrize("pack_bytes, bucket_keys", [(4 << 20, 1 << 21), (300, 40)])
@pytest.mark.parametrize("window", [35, 8, 5, 1])
def test_repeats(spark, window, pack_bytes, bucket_keys):
    rng = random.Random(window)
    sep = [" ", "\n", "\t\t", "\x0b", "\r\n"]

    def text(words):
        return "".join(w + rng.choice(sep) for w in words)

    passages = [[f"p{k}w{i}" for i in range(n)] for k, n in enumerate((34, 35, 36, 70, 120))]
    own = iter(range(10**6))
    docs = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += [f"u{next(own)}" for _ in range(rng.randint(0, 30))] + rng.choice(passages)
        docs.append((i, text(words)))
    docs += [(200, None), (201, ""), (202, " \n"), (203, "a " * 34), (204, "a " * 36), (205, "x y " * 60), (206, "A b c " * 30),
             (207, "a b c " * 30), (None, text(passages[4])), (None, docs[1][1]), (7, docs[7][1]), (208, text(passages[3][:40]) + "end"),
             (209, text([f"long{i % 3000}" for i in range(9000)]))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS id", "'x' AS pack", "2 AS spans").repartition(3)
    got = removed(block_repeats.remove(frame, window=window, pack_bytes=pack_bytes, bucket_keys=bucket_keys))
    assert got == removed_by_hand(docs, window)


def test_repeats_of_nothing_and_of_one_passage_everywhere(spark):
    assert block_repeats.remove(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    passage = " ".join(f"s{i}" for i in range(50))
    docs = [(f"d{i}", f"own{i} {passage} tail{i}") for i in range(2000)]
    out = block_repeats.remove(spark.createDataFrame(docs, "doc_id string, text string").repartition(8), pack_bytes=20000, bucket_keys=3000)
    assert out.where("n_removed <> 50 OR text <> concat('own', substring(doc_id, 2), ' tail', substring(doc_id, 2))").count() == 0
    assert out.count() == 2000


def test_query_of_repeats_digests_the_kept_text(spark, sf_dir):
    row = queries.op13_block_repeats(spark, sf_dir).where("n_removed = 0 AND n_words > 0").first()
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("doc_id") == row.doc_id).first().text
    assert row.kept_sha256 == hashlib.sha256(" ".join(WORD.findall(text)).encode()).hexdigest()
