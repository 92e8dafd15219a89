"""Near-duplicate lines, by columns and SQL functions alone.

A line is removed if the same line stands earlier (in order of doc_id, then of place), or if both lines have `MIN_CHARS` characters
or more and an earlier line differs from it by few edits of characters: at most `budget` of the shorter line's length, two for short lines and a
quarter of the root of the length for longer ones (3 for 144 characters, 8 for 1,024). Equal lines are removed at any
length but zero.

Segment-partition join. Lengths fall into bands of one budget k and one segment size t; a line is cut into k + 1 segments of t characters, the
first half counted from its start and the others from its end. If two lines are at most k edits apart, some segment i of the shorter one is unchanged
with i edits before it and at most k - i after it, so it stands in the longer one at most m = min(i, k - i) places off. Both lines therefore index, for
each segment, the windows of t - m characters that start at the marks of a sparse ruler of length m: any shift up to m is the difference of two
marks, so an unchanged segment gives both lines a common key. A line also takes the keys of the band below where a
shorter partner may be there. Keys are dealt once and join with themselves.

A key's lines meet its earliest line first, in order of place. Only lines for which no such partner is found meet the rest of their key,
and where that has more than `HOT` lines, only those with the same counts in one of 2 * k + 1 groups of letters, which k edits leave. They meet in the
first such group of the first key of one budget that they share, so a pair is written once for a budget. A pair has to
agree, up to the budget, in length and in counts of frequent letters, which is tested inside the join, then in small pieces (k edits spoil k pieces at most),
and is verified by the edit distance of what is left after the common beginning and end: Spark's own, and for more than `LONG` characters a
banded bit-parallel one, whose band of 2 * k + 1 diagonals is one integer, up to 31 edits.

The counts are compared as ring codes of 8 bits, of which neighbours differ in one bit: so the condition is two counts of bits, and stays
below the 8,000 bytes of code above which the JVM does not compile a method.

Only hashes, places and counts of lines are shuffled; texts come in for candidates. A line held by more than one in `HEAVY` of all lines
is indexed at its first place alone: there are at most `HEAVY` such lines, which is what is broadcast. Lines are told apart by 64 bits of hash,
32 more of a checksum, and the length.

Edge cases: a null text has no lines and stays null. Documents with a null doc_id come last. Rows of equal doc_id are one
place: equal rows keep the same lines. Empty lines stay. Extra columns pass through; helper columns never clash with them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import fresh, staged

MIN_CHARS = 24
LEAST_EDITS = 2
#: Lines of 16 k * k characters have a budget of k edits.
ROOT = 4
#: First lengths of the bands whose budget is the least one.
SHORT_BANDS = (24, 36, 54, 81, 121)
#: A line is heavy if it is more than one of so many lines.
HEAVY = 1000
#: A key of more lines is split by counts of letters.
HOT = 64
#: Letters whose counts are compared, each modulo 16.
COUNTED = "etnaorisdlhugcm "
_BITS = 4
#: Texts of more characters are not given to Spark's distance, whose work grows with the square of the length.
LONG = 4000
#: Bits of a hash that name a word of a bitmap: 2 ** 18 words of 64 bits at most, whatever the corpus.
WORD_BITS = 18
#: Budgets whose keys are written out; larger ones take the general form, with equal results.
WRITTEN_OUT = range(LEAST_EDITS, 5)
#: Bits of the integer that holds a band.
WIDEST = 31


def _call(name: str, *args) -> Column:
    return F.call_function(name, *(a if isinstance(a, Column) else F.lit(a) for a in args))


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def budget(length: Column) -> Column:
    """Edits allowed between a line of this length and a longer one."""
    return F.greatest(F.lit(LEAST_EDITS), F.floor(F.sqrt(length) / ROOT).cast("int"))


def _band_start(length: Column) -> Column:
    root = F.floor(F.sqrt(length) / ROOT).cast("int")
    out = F.when(length >= (ROOT * (LEAST_EDITS + 1)) ** 2, root * root * (ROOT * ROOT))
    for start in reversed(SHORT_BANDS):
        out = out.when(length >= start, F.lit(start))
    return out.cast("int")


def _bands(length: Column) -> Column:
    """First lengths of the bands in which a line is indexed: its own, and the one below if a shorter partner may be there."""
    own = _band_start(length)
    below = _band_start(own - 1)
    return F.when((own > MIN_CHARS) & (length - own < budget(own - 1)), F.array(own, below)).otherwise(F.array(own))


def _ruler(m: Column) -> Column:
    """Marks from 0 to m such that every number up to m is a difference of two."""
    step = F.floor(F.sqrt(m + 1)).cast("int")
    return F.array_union(F.sequence(F.lit(0), step - 1), F.transform(F.sequence(F.lit(0), F.floor(m / step).cast("int")), lambda j: m - j * step))


def keys(line: Column, length: Column, start: Column) -> Column:
    """Hashes of (band, segment, window) of a line in the band that begins at `start`."""
    k = budget(start)
    size = F.floor(start / (k + 1)).cast("int")

    def of_segment(i: Column) -> Column:
        off = F.least(i, k - i)
        at = F.when(i <= k - i, i * size).otherwise(length - (k - i + 1) * size)
        return F.transform(_ruler(off), lambda x: F.xxhash64(start, i, F.substring(line, at + x + 1, size - off)))

    def written_out(edits: int) -> Column:
        """The same for one budget, without lambdas, which Spark does not compile."""
        width = F.floor(start / (edits + 1)).cast("int")
        out = []
        for i in range(edits + 1):
            off = min(i, edits - i)
            step = math.isqrt(off + 1)
            at = width * i if i <= edits - i else length - width * (edits - i + 1)
            for x in sorted({*range(step), *range(off, -1, -step)}):
                out.append(F.xxhash64(start, F.lit(i), F.substring(line, at + (x + 1), width - off)))
        return F.array(*out)

    found = F.flatten(F.transform(F.sequence(F.lit(0), k), of_segment))
    for edits in reversed(WRITTEN_OUT):
        found = F.when(k == edits, written_out(edits)).otherwise(found)
    return F.array_distinct(found)


def letter_counts(line: Column) -> Column:
    """Counts of some letters, packed."""
    parts = [
        F.shiftleft(((F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c)))) % (1 << _BITS)).cast("long"), i * _BITS)
        for i, c in enumerate(COUNTED)
    ]
    total = parts[0]
    for part in parts[1:]:
        total = total.bitwiseOR(part)
    return total


def ring_codes(letters: Column) -> list[Column]:
    """Two integers for packed counts; codes of two counts differ in as many bits as the counts differ modulo 16, either way round."""
    out = []
    for half in (0, len(COUNTED) // 2):
        total = None
        for i in range(len(COUNTED) // 2):
            count = F.shiftright(letters, (half + i) * _BITS).bitwiseAND(F.lit((1 << _BITS) - 1).cast("long")).cast("int")
            code = _call("shiftrightunsigned", F.lit(0xFF00).cast("long"), count).bitwiseAND(F.lit(0xFF).cast("long"))
            total = code if total is None else total.bitwiseOR(F.shiftleft(code, i * 8))
        out.append(total)
    return out


def letter_groups(letters: Column, edits: Column) -> Column:
    """Hashes of the counts in 2 * edits + 1 groups of letters: an edit spoils two groups at most, so lines within `edits` have one
    in common. With more groups than letters, one hash for all."""
    def masks(groups: int) -> Column:
        mask = (1 << _BITS) - 1
        return F.array(*(F.lit(sum(mask << (i * _BITS) for i in range(g, len(COUNTED), groups))
                                - (1 << 64 if (len(COUNTED) - 1 - g) % groups == 0 else 0)).cast("long") for g in range(groups)))

    out = F.when(edits * 2 + 1 > len(COUNTED), F.array(F.lit(0).cast("long")))
    for k in range(LEAST_EDITS, len(COUNTED) // 2):
        out = out.when(edits == k, F.transform(masks(2 * k + 1), lambda m: F.xxhash64(m, letters.bitwiseAND(m))))
    return out


def pieces_agree(a: Column, b: Column, edits: Column) -> Column:
    """False only if so many small pieces of `a` are missing near their place in `b` that there are more than `edits` edits."""
    count = (edits + 1) * 4
    size = F.floor(F.char_length(a) / count).cast("int")
    found = F.filter(F.sequence(F.lit(0), count - 1), lambda i: F.contains(
        F.substring(b, F.greatest(i * size - edits, F.lit(0)) + 1, size + edits + F.least(i * size, edits)), F.substring(a, i * size + 1, size)))
    return F.size(found) >= count - edits


def _alike(a: Column, b: Column, most: Column, piece) -> Column:
    """The largest number of characters, up to `most`, in which piece(a) and piece(b), as functions of (text, done, more), agree."""
    powers = F.transform(F.sequence(F.lit(0), F.lit(24)), lambda i: F.pow(F.lit(2.0), F.lit(24) - i).cast("int"))
    return F.aggregate(powers, F.lit(0), lambda done, more: F.when(
        done + more <= most, F.when(piece(a, done, more) == piece(b, done, more), done + more).otherwise(done)).otherwise(done))


def distance(a: Column, b: Column, edits: Column) -> Column:
    """Edit distance; null above `edits`. The common beginning and end are left out, but for edits + 1 characters that the band needs."""
    room = F.least(F.char_length(a), F.char_length(b)) - edits - 1

    def rest(text: Column, head: Column, tail: Column) -> Column:
        return F.substring(text, head + 1, F.char_length(text) - head - tail)

    def with_head(head: Column) -> Column:
        tail = _alike(a, b, room - head, lambda t, done, more: F.substring(t, F.char_length(t) - done - more + 1, more))
        return _let(F.struct(head.alias("head"), tail.alias("tail")), with_both)

    def with_both(cut: Column) -> Column:
        return _let(F.struct(rest(a, cut.head, cut.tail).alias("a"), rest(b, cut.head, cut.tail).alias("b")), measured)

    def measured(s: Column) -> Column:
        wide = _call("levenshtein", s.a, s.b, edits)
        by_bits = (edits <= WIDEST) & (F.char_length(s.a) > LONG)
        return F.when(by_bits, edit_distance(s.a, s.b, edits)).otherwise(F.when(wide >= 0, wide))

    return _let(_alike(a, b, room, lambda t, done, more: F.substring(t, done + 1, more)), with_head)


def edit_distance(a: Column, b: Column, edits) -> Column:
    """Edit distance of two strings; null above `edits`, a number or an integer column up to 31.

    Column j of the matrix has one bit for each of the rows j - edits .. j + edits. `up` and `down` are the rows whose value
    is one more, or one less, than the row before. The cost is followed along the lowest diagonal of the band down to the last row,
    and from there along that row. Rows outside the matrix and cells outside the band only ever make the cost higher."""
    edits = edits if isinstance(edits, Column) else F.lit(edits)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    n = F.char_length(a)

    def bit(bits: Column, place: Column) -> Column:
        return _call("shiftrightunsigned", bits, place).bitwiseAND(one)

    def with_fixed(fixed: Column) -> Column:
        """`fixed` holds what does not change from letter to letter."""
        def matches(j: Column, letter: Column) -> Column:
            rows = F.sequence(F.greatest(j - edits, F.lit(1)), F.least(j + edits, n))
            return F.aggregate(rows, none, lambda out, row: F.when(
                F.get(fixed.letters, row - 1) == letter, out.bitwiseOR(_call("shiftleft", one, row - j + edits))).otherwise(out))

        def inverted(bits: Column) -> Column:
            return bits.bitwiseXOR(fixed.full)

        def step(s: Column, letter: Column) -> Column:
            def with_same(eq: Column) -> Column:
                diagonal = (eq.bitwiseAND(s.up) + s.up).bitwiseXOR(s.up).bitwiseOR(eq).bitwiseOR(s.down).bitwiseAND(fixed.full)
                return _let(diagonal, with_diagonal)

            def with_diagonal(d0: Column) -> Column:
                right, left = s.down.bitwiseOR(inverted(d0.bitwiseOR(s.up))), d0.bitwiseAND(s.up)
                return _let(F.struct(d0.alias("d0"), right.alias("right"), left.alias("left")), with_steps)

            def with_steps(h: Column) -> Column:
                shifted = F.shiftrightunsigned(h.d0, 1)
                row = n - s.j + edits
                along = bit(h.right, row) - bit(h.left, row)
                return F.struct(
                    (s.j + 1).alias("j"), h.left.bitwiseOR(inverted(shifted.bitwiseOR(h.right))).alias("up"),
                    shifted.bitwiseAND(h.right).alias("down"),
                    (s.cost + F.when(s.j <= n - edits, one - bit(h.d0, edits * 2)).otherwise(along)).alias("cost"),
                )

            return _let(matches(s.j, letter), with_same)

        start = F.struct(
            F.lit(1).alias("j"), (fixed.full - _call("shiftleft", one, edits) + 1).alias("up"), none.alias("down"),
            edits.cast("long").alias("cost"))
        return F.aggregate(F.split(b, ""), start, step).cost

    fixed = F.struct(F.split(a, "").alias("letters"), (_call("shiftleft", one, edits * 2 + 1) - 1).alias("full"))
    cost = _let(fixed, with_fixed)
    return F.when((F.abs(n - F.char_length(b)) <= edits) & (n > edits) & (cost <= edits), cost.cast("int"))


def _lines(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, copy (hash of the text), pos, line, length, and id and more, which tell lines apart, of all lines but empty ones."""
    rows = docs.select(
        F.col(doc).alias("doc"), F.xxhash64(text).alias("copy"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")
    ).where("line <> ''")
    measured = rows.withColumn("length", F.char_length("line")).withColumn("id", F.xxhash64("line"))
    return measured.withColumn("more", F.shiftleft(F.crc32("line"), 31).bitwiseXOR(F.col("length").cast("long")))


def _place() -> Column:
    return F.struct(F.col("doc").isNull().alias("unknown"), F.col("doc").alias("doc"), F.col("pos").alias("pos"))


def _members(lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """Lines by key, for keys of several lines: key, id, at, length, letters, k, `low`, the key's earliest line, and `hot`, whether they are many."""
    total = firsts.select(F.sum("n")).first()[0] or 0
    heavy = firsts.where((F.col("n") * HEAVY > total) & (F.col("n") > 1)).select("id", "more", "first")  # HEAVY rows at most
    indexed = lines.where(F.col("length") >= MIN_CHARS).join(F.broadcast(heavy), ["id", "more"], "left").where(
        F.col("first").isNull() | (_place() == F.col("first")))
    # in steps of their own, or each key would measure the line again
    banded = indexed.select("id", _place().alias("at"), "line", "length", letter_counts(F.col("line")).alias("letters"), F.explode(
        _bands(F.col("length"))).alias("start"))
    dealt = banded.select(
        F.explode(keys(F.col("line"), F.col("length"), F.col("start"))).alias("key"), "id", "at", "length", "letters",
        budget(F.col("start")).alias("k")).repartition("key")
    once = dealt.groupBy("key", "id").agg(*(F.min(c).alias(c) for c in ("at", "length", "letters", "k")))
    # `low` holds all columns of `dealt`, so that both groupings read one shuffle
    shared = dealt.groupBy("key").agg(
        F.min(F.struct("at", "id", "length", "letters", "k")).alias("low"), F.min("id").alias("least"), F.max("id").alias("most"), (F.count("*") > HOT).alias("hot")
    ).where("least <> most").select("key", "low", "hot")
    return once.join(shared, "key")


def _measures(line: str) -> list[Column]:
    """What `_close` compares, of a struct with length and letters."""
    first, second = ring_codes(F.col(f"{line}letters"))
    return [F.col(f"{line}length").alias("length"), budget(F.col(f"{line}length")).alias("edits"), first.alias("first"), second.alias("second")]


def _close(a: str, b: str) -> Column:
    """Whether the lines of two structs may be near."""
    edits = F.least(F.col(f"{a}.edits"), F.col(f"{b}.edits"))  # the shorter line's
    apart = F.bit_count(F.col(f"{a}.first").bitwiseXOR(F.col(f"{b}.first"))) + F.bit_count(F.col(f"{a}.second").bitwiseXOR(F.col(f"{b}.second")))
    return (F.abs(F.col(f"{a}.length") - F.col(f"{b}.length")) <= edits) & (apart <= edits * 2)


def _marked(rows: DataFrame, key: str, wanted: DataFrame, mark: str) -> DataFrame:
    """`rows` with whether their `key`, a hash, may be in the only column of `wanted`, by a bitmap of bounded size: more keys only
    mark more rows."""
    (name,) = wanted.columns
    word, bits = fresh(rows, "word"), fresh(rows, "bits")

    def place(column: str) -> tuple[Column, Column]:
        return F.shiftrightunsigned(column, 64 - WORD_BITS), F.col(column).bitwiseAND(F.lit(63).cast("long")).cast("int")

    at, bit = place(name)
    words = wanted.groupBy(at.alias(word)).agg(F.bit_or(_call("shiftleft", F.lit(1).cast("long"), bit)).alias(bits))
    at, bit = place(key)
    held = _call("shiftrightunsigned", F.col(bits), bit).bitwiseAND(F.lit(1).cast("long")) == 1
    return rows.withColumn(word, at).join(F.broadcast(words), word, "left").withColumn(mark, F.coalesce(held, F.lit(False))).drop(word, bits)


def _verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids whose lines are near, with `edits`, and `more` of b."""
    pairs = staged(pairs.distinct(), "line_pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = staged(
        _marked(lines.select("id", "line", "more"), "id", wanted, "may").where("may").join(wanted, "id", "left_semi").groupBy("id").agg(
            F.first("line").alias("line"), F.first("more").alias("more")), "line_texts")
    both = pairs.join(texts.toDF("a", "line_a", "more_a"), "a").join(texts.toDF("b", "line_b", "more"), "b")
    ordered = F.char_length("line_a") <= F.char_length("line_b")
    short, long = (F.when(ordered, F.col(x)).otherwise(F.col(y)).alias(c) for x, y, c in (("line_a", "line_b", "s"), ("line_b", "line_a", "l")))
    # Tables of their own: otherwise the optimizer moves the filters into the join, where each use of `s`, `l` and `k` is computed anew.
    ready = staged(both.select("a", "b", "more", short, long).withColumn("k", budget(F.char_length("s"))), "line_pair_texts")
    # verifying costs far more than its few bytes tell, so the rows are dealt out over all tasks
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = ready.where(pieces_agree(F.col("s"), F.col("l"), F.col("k"))).repartition(tasks, "a", "b")
    judged = staged(dealt.select("a", "b", "more", distance(F.col("s"), F.col("l"), F.col("k")).alias("edits")), "line_distances")
    return judged.where("edits IS NOT NULL")


def near_lines(docs: DataFrame, firsts: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """(id, more) of the different lines to which an earlier line is near, once each."""
    lines = _lines(docs, doc, text)
    members = staged(_members(lines, firsts), "line_members")
    measured = members.select("key", "k", "hot", "letters", "low", F.struct("id", "at", *_measures("")).alias("b"))
    stars = measured.where((F.col("low.id") != F.col("b.id")) & (F.col("low.at") < F.col("b.at"))).withColumn(
        "a", F.struct(*_measures("low."))).where(_close("a", "b"))
    found = staged(_verified(stars.select(F.col("low.id").alias("a"), F.col("b.id").alias("b")), lines), "line_stars")
    # from here on without each key's earliest line
    more = measured.where("b.id <> low.id")
    several = more.groupBy("key").agg(F.min("b.id").alias("least"), F.max("b.id").alias("most")).where("least <> most").select("key")
    more = more.join(several, "key", "left_semi")
    held = more.groupBy(F.col("b.id").alias("id"), "k").agg(F.sort_array(F.collect_set("key")).alias("keys")).withColumnRenamed("k", "of_k")
    less = F.slice("keys", 1, F.array_position("keys", F.col("key")).cast("int") - 1)
    groups = F.when(F.col("hot"), letter_groups(F.col("letters"), F.col("k"))).otherwise(F.array(F.lit(0).cast("long")))
    more = staged(more.join(held, (F.col("b.id") == F.col("id")) & (F.col("k") == F.col("of_k"))).select(
        "key", "b", less.alias("less"), groups.alias("groups")), "line_meetings")
    undecided = more.join(found.select(F.col("b").alias("done")).distinct(), F.col("b.id") == F.col("done"), "left_anti")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))

    def dealt(rows: DataFrame, name: str) -> DataFrame:
        """One row for each group, with the groups and keys that come before it."""
        each = rows.select("key", "b", "less", "groups", F.posexplode("groups").alias("n", "group"))
        return each.select("key", "group", F.col("b").alias(name), F.col("less").alias(f"{name}_keys"), F.slice(
            "groups", 1, F.col("n")).alias(f"{name}_groups")).repartition(tasks, "key", "group")

    rest = dealt(undecided, "b").join(dealt(more, "a"), ["key", "group"]).where(
        (F.col("a.id") != F.col("b.id")) & (F.col("a.at") < F.col("b.at")) & _close("a", "b")
        & ~F.arrays_overlap("a_groups", "b_groups") & ~F.arrays_overlap("a_keys", "b_keys"))
    others = _verified(rest.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")), lines)
    return found.union(others).select(F.col("b").alias("id"), "more").distinct()


def decide(docs: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """doc, copy, and `removed`: (place, whether only a near copy stands earlier) of every line to remove, in order."""
    lines = _lines(docs, doc, text)
    firsts = staged(lines.groupBy("id", "more").agg(F.min(_place()).alias("first"), F.count("*").alias("n")), "line_firsts")
    near = staged(near_lines(docs, firsts, text, doc).withColumn("near", F.lit(True)), "line_near")
    judged = firsts.join(near, ["id", "more"], "left").where("n > 1 OR near")
    placed = lines.select("doc", "copy", "pos", "id", "more").join(judged, ["id", "more"])
    again = _place() > F.col("first")
    removed = placed.where(again | F.col("near")).select(
        "doc", "copy", F.struct("pos", (~again).alias("near")).alias("line"))
    return removed.groupBy("doc", "copy").agg(F.array_sort(F.collect_set("line")).alias("removed"))


def dedup(docs: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """All columns of `docs`, the text without its repeated lines, and `line_counts`: lines, removed as copies, and as near copies."""
    copy, own, counts, place, may = (fresh(docs, c) for c in ("copy", "removed", "line_counts", "place", "may"))
    judged = staged(decide(docs, text, doc), "line_removed")
    keyed = docs.withColumn(copy, F.xxhash64(text)).withColumn(place, F.xxhash64(doc, copy))
    keyed = _marked(keyed, place, judged.select(F.xxhash64("doc", "copy").alias("place")), may)
    changed = keyed.where(may)
    other = judged.toDF(*(fresh(keyed, f"of_{c}") for c in judged.columns))
    of_doc, of_copy, of_removed = other.columns
    joined = changed.join(
        other, F.col(of_doc).eqNullSafe(changed[doc]) & (F.col(of_copy) == changed[copy]), "left"
    ).withColumnRenamed(of_removed, own).select(*docs.columns, own)
    # texts that lose nothing are not dealt
    same = keyed.where(~F.col(may)).select(*docs.columns, F.lit(None).cast(judged.schema["removed"].dataType).alias(own))
    joined = joined.union(same)
    lines = F.split(text, "\n", -1)
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(f"{own}.pos"))  # by hash, not line by line
    kept = F.array_join(F.transform(places, lambda place: F.get(lines, place)), "\n")
    near = F.size(F.filter(own, lambda r: r.near))
    none = F.col(own).isNull()
    return joined.select(
        *(F.when(none, F.col(c)).otherwise(kept).alias(c) if c == text else F.col(c) for c in docs.columns),
        F.struct(
            F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("lines"),
            F.when(none, 0).otherwise(F.size(own) - near).cast("long").alias("copies"),
            F.when(none, 0).otherwise(near).cast("long").alias("near_copies"),
        ).alias(counts),
    )


def drop_repeated(docs: DataFrame) -> DataFrame:
    """The documents without repeated lines; one that loses all its text is left out."""
    counts = fresh(docs, "line_counts")
    out = dedup(docs)
    lost = (F.col(f"{counts}.copies") + F.col(f"{counts}.near_copies") > 0) & (F.trim("text") == "")
    return out.where(~F.coalesce(lost, F.lit(False))).drop(counts)
