"""Fuzzy line deduplication by MinHash, in DataFrame and SQL functions alone.

A line's shingles are SHINGLE characters long and begin at every character, with white space or without, so an insertion
changes at most SHINGLE of them; a shorter line is one shingle. Lines are first made distinct by a 64-bit hash. Each distinct
line gets BANDS * ROWS minima of its hashed shingles under XOR permutations; a band is ROWS minima together. With 12
bands of 4, two lines of Jaccard similarity 0.8 meet in a band with probability 0.998, at 0.85 with 0.9998.

Lines that meet are joined by exact Jaccard similarity of their shingle sets. A band shared by many lines never yields
all its pairs: each member is compared with REPS representatives of the band (the same permutations choose them in every
band, so bands of the same lines share them) and components are formed. While bands still hold many pairs from different
components, that is done again with new representatives, so that a large group of lines alike grows together in a few rounds;
within a component no further links are needed. What pairs are left are compared one by one, so nothing is lost.

Of each component (and of each group of equal lines) the first line stays: smallest doc_id, null ids last, then row key
and line number; the others are removed. Lines of white space alone stay. A document that loses all its lines but blank
ones is dropped; null and empty texts stay as they are. Rows equal in id and text are treated alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.components import components
from helixframe.llm.rows import packed, row_key
from helixframe.llm.store import Store

SHINGLE = 8
BANDS = 12
ROWS = 4
THRESHOLD = 0.8
REPS = 4
#: Rounds of representatives go on while more than this many pairs a member are left and each takes a quarter of them, at most MAX_ROUNDS times.
PAIRS = 2
MAX_ROUNDS = 8
#: Shingles of one line whose minima are taken in one row.
GROUP = 16
#: Longs of a bitmap. Shingle sets of some hundred elements leave most of its 1024 bits unflipped, so it tells apart pairs just below the threshold.
WORDS = 16
_SHORT = rf"^.{{1,{SHINGLE - 1}}}(?!.)"
_PATTERN = rf"(?s)(?=(.{{{SHINGLE}}}|{_SHORT}))."


def shingles(line: Column) -> Column:
    """Shingles with repeats, as an array in no order that matters: from each of the first SHINGLE characters on, the line is cut
    into pieces, which costs less than to look ahead from every character."""
    cuts = [F.regexp_extract_all(F.substring(line, k + 1, 2**31 - 1), F.lit(f"(?s).{{{SHINGLE}}}"), F.lit(0)) for k in range(SHINGLE)]
    return F.when(F.length(line).between(1, SHINGLE - 1), F.array(line)).otherwise(F.flatten(F.array(*cuts)))


def permutation(i: int) -> int:
    """Constant of the i-th XOR permutation, as a signed long."""
    x = (i + 1) * 0x9E3779B97F4A7C15 % 2**64
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    x ^= x >> 31
    return x - 2**64 if x >= 2**63 else x


def blank(line: Column) -> Column:
    """Whether a line is white space alone, as the pattern \\s has it; looks no further than its first other character."""
    return F.ltrim(line, F.lit(" \t\n\x0b\f\r")) == ""


def exploded(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, k1, k2, line_no, line) of all lines that are not blank."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), *row_key(doc_id, text), F.col(text).alias("t"))
    return rows.select("doc_id", "k1", "k2", F.posexplode(F.split("t", "\n")).alias("line_no", "line")).filter(~blank(F.col("line")))


def signatures(docs: DataFrame, text: str) -> DataFrame:
    """(key, n, bands): distinct lines, how often they occur, and their band hashes. Lines move once, equal ones of a task as one,
    and only then are cut, each text once, where it has arrived; so minima need not move. In UTF-32 every character has four
    bytes, so a shingle is a slice at a known place, whatever the length of its line. GROUP shingles are one row, whose least
    values update the minima once."""
    lines = docs.select(F.explode(F.split(F.col(text), "\n")).alias("line")).filter(~blank(F.col("line")))
    lines = lines.select(F.xxhash64("line").alias("key"), "line").groupBy("key").agg(F.count("*").alias("n"), F.any_value("line").alias("line"))
    rows = lines.select("key", "n", F.encode("line", "UTF-32").alias("wide"))
    rows = rows.select("key", "n", "wide", F.greatest(F.expr("cast(length(wide) / 4 as int)") - SHINGLE, F.lit(0)).alias("last"))
    rows = rows.select("key", "n", "wide", "last", F.explode(F.sequence(F.lit(0), "last", F.lit(GROUP))).alias("i"))
    h = [f"h{g}" for g in range(GROUP)]  # past the end the last shingle is repeated, which changes no minimum
    at = [F.least(F.col("i") + g, "last") * 4 + 1 for g in range(GROUP)]
    s = rows.select("key", "n", *[F.xxhash64(F.substring(F.col("wide"), x, F.lit(4 * SHINGLE))).alias(c) for x, c in zip(at, h)])
    least = [F.min(F.least(*[F.col(c).bitwiseXOR(F.lit(permutation(i))) for c in h])).alias(f"m{i}") for i in range(BANDS * ROWS)]
    minima = s.groupBy("key", "n").agg(*least)
    bands = [F.xxhash64(F.lit(b), *[f"m{b * ROWS + r}" for r in range(ROWS)]) for b in range(BANDS)]
    return minima.select("key", "n", F.array(*bands).alias("bands"))


def far(x: str, y: str) -> Column:
    """Least number of shingles by which the sets of two bitmaps (columns of x and y) differ."""
    return sum((F.bit_count(F.col(f"{x}{i}").bitwiseXOR(F.col(f"{y}{i}"))) for i in range(WORDS)), F.lit(0))


def verified(pairs: DataFrame, lines: DataFrame, maps: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose shingle sets have at least that Jaccard similarity. Bitmaps rule out most others before a line moves."""
    a = maps.select(F.col("key").alias("a"), F.col("n").alias("na"), *[F.col(f"b{i}").alias(f"x{i}") for i in range(WORDS)])
    b = maps.select(F.col("key").alias("b"), F.col("n").alias("nb"), *[F.col(f"b{i}").alias(f"y{i}") for i in range(WORDS)])
    near = far("x", "y") <= (1 - threshold) / (1 + threshold) * (F.col("na") + F.col("nb")) + 1e-9
    near = pairs.join(a, "a").join(b, "b").filter(near).select("a", "b", "na", "nb")
    return resembling(near, lines, threshold)


def resembling(pairs: DataFrame, lines: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, na, nb) whose shingle sets, of sizes na and nb, have at least that Jaccard similarity, exactly."""
    both = F.size(F.array_intersect(shingles(F.col("la")), shingles(F.col("lb"))))
    a = lines.select(F.col("key").alias("a"), F.col("line").alias("la"))
    b = lines.select(F.col("key").alias("b"), F.col("line").alias("lb"))
    return pairs.join(a, "a").join(b, "b").filter(both >= threshold / (1 + threshold) * (F.col("na") + F.col("nb")) - 1e-9).select("a", "b")


def bitmaps(lines: DataFrame) -> DataFrame:
    """(key, n, b0, b1, ...): the number of different shingles of each line, and their set as WORDS longs: each shingle flips one bit."""
    one = lines.select("key", F.explode(F.array_distinct(shingles(F.col("line")))).alias("s")).select("key", F.xxhash64("s").alias("h"))
    bit = one.select("key", F.pmod("h", F.lit(WORDS)).alias("w"), F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 58) as int))").alias("bit"))
    words = [F.coalesce(F.bit_xor(F.when(F.col("w") == i, F.col("bit"))), F.lit(0).cast("bigint")).alias(f"b{i}") for i in range(WORDS)]
    return bit.groupBy("key").agg(F.count("*").alias("n"), *words)


def similar_lines(docs: DataFrame, signed: DataFrame, store: Store, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(node, component) of the lines that resemble another distinct line."""
    band = signed.select(F.explode("bands").alias("band"), "key")
    shared = band.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    multi = band.join(shared.hint("shuffle_hash"), "band")  # the few shared bands are hashed, all others not sorted
    multi = store.put(multi.hint("rebalance", F.col("key")), "bands")  # few rows are left, which many small files would make slow to read
    keys = multi.select("key").distinct()
    lines = docs.select(F.explode(F.split(F.col(text), "\n")).alias("line")).select(F.xxhash64("line").alias("key"), "line")
    own = store.put(lines.groupBy("key").agg(F.any_value("line").alias("line")).join(keys, "key", "left_semi"), "lines")  # a common line moves once a task
    maps = store.put(bitmaps(own), "bitmaps")

    found, classes, reps, rounds = [], None, [], 0
    while True:
        named = multi.withColumn("c", F.col("key")) if classes is None else multi.join(classes.withColumnRenamed("node", "key"), "key", "left").select("band", "key", F.coalesce("component", "key").alias("c"))
        sizes = named.groupBy("band", "c").agg(F.count("*").alias("n")).groupBy("band").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("s")).filter("k > 1")
        open_bands = store.put(sizes, "open")
        tally = open_bands.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("s")) / 2), F.lit(0.0))).first()
        if rounds and (tally[1] <= PAIRS * tally[0] or tally[1] > 0.75 * before or rounds == MAX_ROUNDS):
            break
        before = tally[1]
        named = store.put(named.join(open_bands.select("band"), "band"), "named")
        chosen = [permutation(-2 - rounds * REPS - i) for i in range(REPS)]
        least = named.groupBy("band").agg(*[F.min(F.col("key").bitwiseXOR(F.lit(x))).alias(f"r{i}") for i, x in enumerate(chosen)])
        least = least.select("band", F.explode(F.array_distinct(F.array(*[F.col(f"r{i}").bitwiseXOR(F.lit(x)) for i, x in enumerate(chosen)]))).alias("rep"))
        least = store.put(least.join(named.select("band", F.col("key").alias("rep"), F.col("c").alias("rc")), ["band", "rep"]), "representatives")
        reps.append(least.select("band", F.col("rep").alias("key")))
        pairs = named.join(least, "band").filter("c <> rc").select(F.least("key", "rep").alias("a"), F.greatest("key", "rep").alias("b")).distinct()
        new = store.put(verified(pairs, own, maps, threshold), "links")
        rounds += 1
        if new.isEmpty():  # no two of what is left are likely to be alike
            classes = components(new, store) if classes is None else classes
            break
        found.append(new)
        classes = components(reduce(DataFrame.unionByName, found), store)

    left = named.join(open_bands.select("band"), "band").join(reduce(DataFrame.unionByName, reps), ["band", "key"], "left_anti")
    left = store.put(left, "left")
    members = left.join(signed.select("key", "bands"), "key").join(maps, "key")
    last = store.put(resembling(close_pairs(members, threshold), own, threshold), "links")
    return classes if last.isEmpty() else components(reduce(DataFrame.unionByName, [*found, last]), store)


def close_pairs(members: DataFrame, threshold: float) -> DataFrame:
    """(a, b, na, nb): members (band, key, c, bands, n, b0, b1, ...) of one band in different components that may reach the threshold.

    Two sets differ in at least as many elements as their bitmaps do in bits, so a pair whose bitmaps are too far apart
    for its sizes is ruled out inside the join, exactly, and never becomes a row. A pair that shares several bands is
    taken in the first of them alone.
    """
    x, y = members.alias("x"), members.alias("y")
    near = far("x.b", "y.b") <= (1 - threshold) / (1 + threshold) * (F.col("x.n") + F.col("y.n")) + 1e-9
    first = F.element_at(F.array_intersect("x.bands", "y.bands"), 1) == F.col("x.band")
    on = (F.col("x.band") == F.col("y.band")) & (F.col("x.key") < F.col("y.key")) & (F.col("x.c") != F.col("y.c")) & near & first
    return x.join(y, on).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"))


def removals(docs: DataFrame, store: Store, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(k1, k2, removed): line numbers to remove, for each row that loses any."""
    signed = store.put(signatures(docs, text), "signatures")
    classes = similar_lines(docs, signed, store, text=text, threshold=threshold)
    groups = signed.filter("n > 1").select("key").join(classes.withColumnRenamed("node", "key"), "key", "full_outer").select("key", F.coalesce("component", "key").alias("c"))
    places = exploded(docs, doc_id, text).select("doc_id", "k1", "k2", "line_no", F.xxhash64("line").alias("key"))
    mine = store.put(places.join(groups, "key").select("c", F.col("doc_id").isNull().alias("z"), "doc_id", "k1", "k2", "line_no"), "occurrences")
    first = mine.groupBy("c").agg(F.min(F.struct("z", "doc_id", "k1", "k2", "line_no")).alias("f")).select("c", F.col("f.k1").alias("f1"), F.col("f.k2").alias("f2"), F.col("f.line_no").alias("fl"))
    first = store.put(first, "first")  # so that the join below is of plain exchanges, whose hot keys Spark can split
    gone = mine.join(first, "c").filter((F.col("k1") != F.col("f1")) | (F.col("k2") != F.col("f2")) | (F.col("line_no") != F.col("fl")))
    out = store.put(gone.groupBy("k1", "k2").agg(F.collect_set("line_no").alias("removed")), "removals")
    store.drop(mine)
    return out


def marked_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`row` (the document), n_lines, n_removed and text with the removed lines gone (null for a null text)."""
    store = Store(docs.sparkSession)
    gone = removals(docs, store, doc_id=doc_id, text=text, threshold=threshold)
    lines = F.split(F.col(f"row.{text}"), "\n")
    none = F.array().cast("array<int>")
    keep = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.coalesce("removed", none), i)), "\n")
    joined = packed(docs, doc_id, text).join(gone, ["k1", "k2"], "left")
    new = F.when(F.col("removed").isNull(), F.col(f"row.{text}")).otherwise(keep)
    return joined.select("row", F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).alias("n_removed"), new.alias("deduplicated"))


def dedup_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Documents, the same columns, without removed lines; those with nothing left but white space go."""
    out = marked_lines(docs, doc_id=doc_id, text=text, threshold=threshold)
    out = out.filter((F.col("n_removed") == 0) | F.col("deduplicated").rlike(r"\S"))
    return out.select(*[F.col("deduplicated").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
