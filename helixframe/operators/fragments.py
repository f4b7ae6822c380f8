"""Sliding-window fragments of genomes, whole or in chunks.

Work is by cells of a fixed length of genome. A cell's text reaches window - 1 bases into the next one (its halo), so that
each cell cuts the windows that begin in it by itself, in time linear in its length. Of chunked genomes a row sends its
bases to the cells that need them, halos included, and no task holds more of a genome than a cell. A name identifies one genome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators.ordering import prefix_sums

#: Bases of a cell, at least (a cell is never shorter than a window), and cells numbered together.
CELL, CELLS_TOGETHER = 1 << 16, 1024


def fragment(genomes: DataFrame, window: int = 128, stride: int = 32, *, genome: str = "genome", sequence: str = "sequence", skip_ambiguous: bool = False, cell: int = CELL) -> DataFrame:
    """(genome, fragment_id, start, end, sequence) of genomes of one row each; `end` is exclusive and a partial tail is dropped.

    With skip_ambiguous a window with any character outside ACGT is dropped and ids stay dense over the survivors; without
    it such a genome raises. Genomes shorter than the window give no rows here; the CLI rejects them.
    """
    size = _size(window, stride, cell)
    rows = genomes.select(F.col(genome).alias("genome"), _plain(F.col(sequence)).alias("bytes"))  # no filter: Spark would push it down, and clean a text twice
    cells = F.sequence(F.lit(0).cast("bigint"), F.expr(f"(length(bytes) - 1) div {size}"))
    text = lambda g: F.substring(F.col("bytes"), (g * size + 1).cast("int"), F.lit(size + window - 1))
    if not skip_ambiguous:
        each = rows.select("genome", F.inline(F.transform(cells, lambda g: F.struct(g.alias("cell"), text(g).alias("bytes")))))
        return _all_windows(each, window, stride, size)
    # A genome is in one row, so the windows kept before a cell are a running sum there: nothing is joined or shuffled.
    counts = F.transform(cells, lambda g: F.size(_kept(text(g), g, window, stride, size)).cast("bigint"))
    begin = F.struct(F.lit(0).cast("bigint").alias("n"), F.array().cast("array<bigint>").alias("before"))
    before = F.aggregate(counts, begin, lambda at, n: F.struct((at["n"] + n).alias("n"), F.array_append(at["before"], at["n"]).alias("before")), lambda at: at["before"])
    placed = F.transform(cells, lambda g: F.struct(g.alias("cell"), text(g).alias("bytes"), F.coalesce(F.element_at("before", (g + 1).cast("int")), F.lit(0).cast("bigint")).alias("before")))
    each = rows.select("genome", "bytes", before.alias("before")).select("genome", F.inline(placed))
    return _kept_windows(each, window, stride, size)


def fragment_chunks(chunks: DataFrame, window: int = 128, stride: int = 32, *, skip_ambiguous: bool = False, cell: int = CELL) -> DataFrame:
    """As fragment, of genomes in chunks (genome, offset, sequence) of any lengths that leave no gap. Rows may come in any order."""
    size = _size(window, stride, cell)
    rows = chunks.select(F.struct("genome").alias("g"), F.col("offset").cast("bigint").alias("offset"), _plain(F.col("sequence")).alias("bytes"))
    first = F.greatest(F.lit(0).cast("bigint"), F.floor((F.col("offset") - (window - 1)) / size))
    last = F.floor((F.col("offset") + F.length("bytes") - 1) / size)

    def part(g: Column) -> Column:
        low = F.greatest(F.col("offset"), g * size)
        high = F.least(F.col("offset") + F.length("bytes"), (g + 1) * size + window - 1)
        piece = F.substring(F.col("bytes"), (low - F.col("offset") + 1).cast("int"), (high - low).cast("int"))
        return F.struct(g.alias("cell"), low.alias("low"), piece.alias("piece"))

    sent = rows.select("g", F.inline(F.when(F.length("bytes") > 0, F.transform(F.sequence(first, last), part))))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("low", F.col("piece").cast("string").alias("t")))), lambda x: x["t"]), "")
    cells = sent.groupBy("g", "cell").agg(joined.cast("binary").alias("bytes"))  # a cell and its halo
    if not skip_ambiguous:
        return _all_windows(cells.select("g.genome", "cell", "bytes"), window, stride, size)
    sizes = cells.select("g", "cell", F.size(_kept(F.col("bytes"), F.col("cell"), window, stride, size)).cast("bigint").alias("n"))
    bucket = F.coalesce(F.expr(f"cell div {CELLS_TOGETHER}"), F.lit(0).cast("bigint"))  # plainly not null, so that no filter keeps Spark from using one exchange for all
    firsts = prefix_sums(sizes, ["g"], "cell", "n", "before", bucket).select("g", "cell", "before")
    # A struct is never null, so the keys are those that the cells are dealt out by: only the sums move.
    both = cells.join(firsts.hint("shuffle_hash"), ["g", "cell"])
    return _kept_windows(both.select("g.genome", "cell", "bytes", "before"), window, stride, size)


def chunked(genomes: DataFrame, bases: int = CELL, *, genome: str = "genome", sequence: str = "sequence") -> DataFrame:
    """(genome, offset, sequence): genomes of one row each in chunks, characters outside ACGT as N. An empty genome has no chunk."""
    rows = genomes.select(F.col(genome).alias("genome"), _plain(F.col(sequence)).alias("bytes"))
    cut = F.transform(F.sequence(F.lit(0), F.expr(f"cast((length(bytes) - 1) div {bases} as int)")), lambda g: F.struct((g * bases).cast("bigint").alias("offset"), F.substring(F.col("bytes"), g * bases + 1, F.lit(bases)).cast("string").alias("sequence")))
    return rows.select("genome", F.inline(F.when(F.length("bytes") > 0, cut)))


def _size(window: int, stride: int, cell: int) -> int:
    if window <= 0 or stride <= 0 or cell <= 0:
        raise ValueError("window, stride and cell must be positive")
    return max(window, cell)


def _plain(sequence: Column) -> Column:
    """Bases in capitals, all other characters as N: one byte a character."""
    seq = F.upper(sequence)
    return F.when(seq.rlike("[^ACGTN]"), F.regexp_replace(seq, "[^ACGT]", "N")).otherwise(seq).cast("binary")


def _starts(data: Column, cell: Column, window: int, stride: int, size: int) -> Column:
    """Starts of the windows that begin in a cell."""
    low = cell * size
    first = low + F.pmod(-low, F.lit(stride))
    last = F.least(low + size - 1, low + F.length(data) - window)
    return F.when(first <= last, F.sequence(first, last, F.lit(stride).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def _kept(data: Column, cell: Column, window: int, stride: int, size: int) -> Column:
    """Starts of those without an N."""
    starts = _starts(data, cell, window, stride, size)
    clean = lambda s: ~F.contains(F.substring(data, (s - cell * size + 1).cast("int"), F.lit(window)), F.lit("N").cast("binary"))
    return F.when(F.contains(data, F.lit("N").cast("binary")), F.filter(starts, clean)).otherwise(starts)


def _all_windows(cells: DataFrame, window: int, stride: int, size: int) -> DataFrame:
    """Fragments of cells (genome, cell, bytes), which hold their halo. A window is a row before it is cut, so that none is built that is not asked for."""
    # A genome shorter than a window has one cell, and is passed over before it can raise.
    wrong = F.contains("bytes", F.lit("N").cast("binary")) & ((F.length("bytes") >= window) | (F.col("cell") > 0))
    cells = cells.filter(F.when(wrong, F.raise_error(F.lit("genome holds unsupported bases")).cast("boolean")).otherwise(F.lit(True)))
    each = cells.select("genome", "cell", "bytes", F.explode(_starts(F.col("bytes"), F.col("cell"), window, stride, size)).alias("start"))
    return each.select("genome", F.expr(f"start div {stride}").alias("fragment_id"), "start", (F.col("start") + window).alias("end"), _cut(window, size))


def _kept_windows(cells: DataFrame, window: int, stride: int, size: int) -> DataFrame:
    """Fragments without an N of cells (genome, cell, bytes, before), numbered from the windows kept before the cell."""
    kept = F.posexplode(_kept(F.col("bytes"), F.col("cell"), window, stride, size)).alias("i", "start")
    each = cells.select("genome", "cell", "bytes", "before", kept)
    return each.select("genome", (F.col("before") + F.col("i")).alias("fragment_id"), "start", (F.col("start") + window).alias("end"), _cut(window, size))


def _cut(window: int, size: int) -> Column:
    return F.substring(F.col("bytes"), (F.col("start") - F.col("cell") * size + 1).cast("int"), F.lit(window)).cast("string").alias("sequence")
