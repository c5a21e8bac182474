"""Sets compared inside groups, and small graphs inside groups, in the memory of tasks: pairs are counted where they are found and never shuffled.

A group of more than BLOCK rows is dealt into blocks, and each task compares two of them, so no task holds more than two blocks of a group. The blocks are files in the shared
folder, written once, of which a task reads its two; so what is written grows with rows, not with pairs of blocks. Rows that belong to every bucket of their category are written and
compared with each other once, not once for each bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillroom.sources.tables import kept, release, stored

#: Rows of a block, cells and hits of a step in a task, rows that a task gathers before it compares.
BLOCK, STEP, GATHER = 8_192, 1_000_000, 20_000
#: Blocks are so many times as large where only words are compared, which are few.
WIDE = 4
NO_SHOP = -(2**31)
#: In place of a bucket: its category's rows with a content against those without.
ACROSS = -(2**31)


def tasks(df: DataFrame) -> int:
    """Tasks for work in memory: it is more than its bytes let expect, so that small partitions aren't merged."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * df.sparkSession.sparkContext.defaultParallelism)


def inside(rows: DataFrame, by: tuple[str, ...], sizes: DataFrame, row: Column, block: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of groups of one block with (block_a, block_b, side), those of larger groups with (block), and the pairs of blocks (*by, block_a, block_b) of larger groups.

    ``sizes`` has an upper bound n of the rows of each group. ``row`` tells a group's rows apart. A block has about ``block`` rows, BLOCK if that is 0.
    """
    block = block or BLOCK
    # Of all rows at most one in ``block`` counts here.
    large = F.broadcast(sizes.where(F.col("n") > block).select(*by, F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    few = rows.join(large, list(by), "left_anti").withColumns({"block_a": F.lit(0), "block_b": F.lit(0), "side": F.lit(0)})
    many = rows.join(large, list(by)).withColumn("block", F.pmod(F.xxhash64(row), "blocks").cast("int")).select(*rows.columns, "block")
    first = large.withColumn("block_a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return few, many, first.select(*by, "block_a", F.explode(F.sequence("block_a", F.col("blocks") - 1)).alias("block_b"))


def across(rows: DataFrame, sizes: DataFrame, row: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Like ``inside``, for each category's rows with a content (side 0) against those without (bucket -1, side 1). Categories that lack either are left out."""
    count = lambda known: F.coalesce(F.sum(F.when((F.col("bucket") >= 0) == known, F.col("n"))), F.lit(0))
    counted = sizes.groupBy("category_id").agg(count(F.lit(True)).alias("known"), count(F.lit(False)).alias("unknown")).where("known > 0 and unknown > 0")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    placed = F.broadcast(counted.select("category_id", (F.greatest("known", "unknown") > BLOCK).alias("large"), blocks("known").alias("k"), blocks("unknown").alias("u")))
    own, known = rows.join(placed, "category_id"), F.col("bucket") >= 0
    few = own.where("not large").select(*rows.columns, F.lit(0).alias("block_a"), F.lit(1).alias("block_b"), (~known).cast("int").alias("side"))
    at = F.pmod(F.xxhash64(row, "bucket"), F.when(known, F.col("k")).otherwise(F.col("u"))).cast("int")
    many = own.where("large").select(*rows.columns, (at + F.when(known, 0).otherwise(F.col("k"))).alias("block"))
    first = placed.where("large").withColumn("block_a", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return few, many, first.select("category_id", "block_a", F.explode(F.sequence("k", F.col("k") + F.col("u") - 1)).alias("block_b"))


def together(dealt_rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Rows of groups of one block brought together and sorted by ``by`` and blocks."""
    return dealt_rows.repartition(tasks(dealt_rows), *by, "block_a", "block_b").sortWithinPartitions(*by, "block_a", "block_b", "side")


def block_of(folder: str, values: dict[str, int]) -> pa.Table | None:
    """The rows of the one subfolder of ``stored`` that ``values`` name, None if it has none."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    # Hadoop names a local file file:/x, which is no URI to Arrow.
    local = folder.startswith("file:") and not folder.startswith("file://")
    files, root = fs.FileSystem.from_uri(folder.removeprefix("file:") if local else folder)
    found = files.get_file_info(fs.FileSelector("/".join([root, *(f"{k}={v}" for k, v in values.items())]), allow_not_found=True))
    parts = [pq.read_table(files.open_input_file(x.path)) for x in sorted(found, key=lambda x: x.path) if x.path.endswith(".parquet")]
    return pa.concat_tables(parts) if parts else None


def paired(folder: str, by: dict[str, int], a: int, b: int) -> pa.Table | None:
    """The rows of two blocks (of one, if they are the same) of a group as ``whole`` would give them; None if a block has none."""
    sides = [block_of(folder, by | {"block": x}) for x in dict.fromkeys((a, b))]
    if any(x is None for x in sides):
        return None
    table = pa.concat_tables(sides)
    side = np.repeat(np.arange(len(sides)), [x.num_rows for x in sides])
    for name, value in (*by.items(), ("block_a", a), ("block_b", b), ("side", side)):
        table = table.append_column(name, pa.array(np.broadcast_to(value, table.num_rows).astype(np.int64)))
    return table


def in_blocks(rows: DataFrame, deal: Callable[[DataFrame], list[tuple[DataFrame, DataFrame, DataFrame]]], by: tuple[str, ...], run: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``run`` gives for tables of whole groups and of pairs of blocks; ``deal`` gives what ``inside`` and ``across`` make of rows."""

    def dealt(rows: DataFrame) -> Iterator[DataFrame]:
        return (reduce(DataFrame.unionByName, x) for x in zip(*[(f, m, p.select(*by, "block_a", "block_b")) for f, m, p in deal(rows)], strict=True))

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole(batches, (*by, "block_a", "block_b")):
            yield from run(table)

    few, many, pairs = dealt(rows)
    alone = pairs.isEmpty()
    release(pairs.sparkSession)
    if alone:
        return together(few, by).mapInArrow(small, schema)
    # They are read for the small groups and again for the large ones, so what leads to them is done once.
    few, many, pairs = dealt(kept(rows))
    found = together(few, by).mapInArrow(small, schema)
    folder, n = stored(many.repartition(tasks(many), *by, "block"), *by, "block"), tasks(many)

    def large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*[ids(batch, c).tolist() for c in (*by, "block_a", "block_b")], strict=True):
                table = paired(folder, dict(zip(by, row, strict=False)), *row[-2:])
                if table is not None:
                    yield from run(table)

    return found.unionByName(pairs.coalesce(1).repartition(4 * n).mapInArrow(large, schema))


def ids(batch: pa.Table, column: str) -> np.ndarray:
    return batch.column(column).to_numpy().astype(np.int64, copy=False)


def starts(columns: list[np.ndarray]) -> np.ndarray:
    """Where rows begin that differ from the row before them."""
    return np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)]) if len(columns[0]) else np.zeros(0, np.int64)


def whole(batches: Iterator[pa.RecordBatch], by: tuple[str, ...], least: int = 0) -> Iterator[pa.Table]:
    """Tables of whole groups, of ``least`` rows or more but for the last, from batches that are sorted by ``by``."""
    kept, n, bound = [], 0, least or GATHER
    for batch in batches:
        kept.append(batch)
        n += batch.num_rows
        if n < bound:
            continue
        full = pa.Table.from_batches(kept)
        last = int(starts([ids(full, c) for c in by])[-1])
        if last:
            yield full.slice(0, last)
        kept, n = full.slice(last).to_batches(), full.num_rows - last
        bound = max(least or GATHER, 2 * n)
    if n:
        yield pa.Table.from_batches(kept)


class Sets:
    """The elements of rows that lie in groups, as postings. A row is compared with the rows ``low`` to ``high`` of its group."""

    def __init__(self, group: np.ndarray, low: np.ndarray, high: np.ndarray, after: np.ndarray, row: np.ndarray, value: np.ndarray):
        n = len(group)
        codes, seen = pd.factorize(value)
        element, found = pd.factorize(group[row] * max(1, len(seen)) + codes)
        both = np.unique(row * max(1, len(found)) + element)
        self.row, self.element = both // max(1, len(found)), both % max(1, len(found))
        # Any value of an element does, for instance for its weight.
        self.value = np.asarray(seen)[found % max(1, len(seen))][self.element] if len(found) else np.zeros(0, np.int64)
        self.size = np.bincount(self.row, minlength=n)
        order = np.argsort(self.element, kind="stable")
        self.posting = self.row[order]
        end = np.cumsum(np.bincount(self.element, minlength=len(found)))[self.element]
        begin = np.empty(len(both), np.int64)
        begin[order] = np.arange(1, len(both) + 1)
        across = ~after[self.row]
        begin[across] = np.searchsorted(self.element[order] * n + self.posting, self.element[across] * n + low[self.row[across]])
        self.begin, self.hits, self.low = begin, np.where((high > low)[self.row], end - begin, 0), low
        self.first = np.searchsorted(self.row, np.arange(n + 1))

    def counts(self, a: int, b: int, at: np.ndarray, cells: int, weight: np.ndarray | None = None) -> np.ndarray:
        """How many elements (or their weights) the rows a to b share with each row that they are compared with."""
        s = slice(self.first[a], self.first[b])
        hits = self.hits[s]
        moved = self.begin[s] - (np.cumsum(hits) - hits)
        met = self.posting[np.repeat(moved, hits) + np.arange(hits.sum())]
        cell = np.repeat(at[self.row[s] - a] - self.low[self.row[s]], hits) + met
        return np.bincount(cell, weights=None if weight is None else np.repeat(weight[s], hits), minlength=cells)


def compared(table: pa.Table, by: tuple[str, ...], values: dict[str, tuple[np.ndarray, np.ndarray]]) -> tuple[dict[str, Sets], Iterator[tuple[int, int, np.ndarray, int]]]:
    """The sets of a table of whole groups (each as its elements' rows and values), and the steps in which rows are compared: rows a to b, the first cell of each, number of cells."""
    n = table.num_rows
    begin = starts([ids(table, c) for c in (*by, "block_a", "block_b")])
    sizes = np.diff(np.r_[begin, n])
    group, end = np.repeat(np.arange(len(begin)), sizes), np.repeat(begin + sizes, sizes)
    side, after = ids(table, "side"), ids(table, "block_a") == ids(table, "block_b")
    middle = np.repeat(begin + sizes - np.add.reduceat(side, begin), sizes)
    low = np.where(after, np.arange(n) + 1, np.where(side == 0, middle, end))
    sets = {k: Sets(group, low, end, after, *v) for k, v in values.items()}
    width = end - low
    work = np.cumsum(width + sum(np.bincount(s.row, weights=s.hits, minlength=n) for s in sets.values()))

    def steps() -> Iterator[tuple[int, int, np.ndarray, int]]:
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(work, (work[a - 1] if a else 0) + STEP)))
            at = np.cumsum(width[a:b]) - width[a:b]
            if cells := int(width[a:b].sum()):
                yield a, b, at, cells
            a = b

    return sets, steps()


def cell_rows(cell: np.ndarray, a: int, at: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two rows of cells. A row without cells begins where the next one does, so the last that begins there is meant."""
    i = np.searchsorted(at, cell, side="right") - 1
    return a + i, low[a + i] + cell - at[i]


def pieces_of(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of the three-letter pieces of texts; a shorter text is its own piece, an empty one has none."""
    plain = texts.to_pylist()
    length = np.array([len(t) for t in plain], np.int64)
    # Characters are numbered from 1, so that 0 stands for one that isn't there.
    letters = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    letters = np.r_[letters, 0, 0]
    row, first = np.repeat(np.arange(len(plain)), length), np.repeat(np.cumsum(length) - length, length)
    place, size = np.arange(len(row)) - first, length[row]
    k = np.flatnonzero((place + 3 <= size) | ((size < 3) & (place == 0)))
    second, third = np.where(size[k] > 1, letters[k + 1], 0), np.where(size[k] > 2, letters[k + 2], 0)
    return row[k], (letters[k] << 42) | (second << 21) | third


def words_of(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of the distinct words of texts, in their order."""
    row, word = elements_of(pc.split_pattern(texts, " "))
    codes, seen = pd.factorize(word)
    some = np.flatnonzero((np.asarray(seen) != "")[codes]) if len(codes) else np.zeros(0, np.int64)
    row, codes = row[some], codes[some]
    first = np.sort(np.unique(row * max(1, len(seen)) + codes, return_index=True)[1])
    return row[first], codes[first]


def key_sets(keys: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of the distinct words of keys; an empty key has one word of its own, so that empty keys are alike."""
    row, word = words_of(keys)
    empty = np.setdiff1d(np.arange(len(keys)), row)
    return np.r_[row, empty], np.r_[word, np.full(len(empty), -1)]


def among(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which of ``keys`` are in ``found``, which is sorted."""
    return found[np.minimum(np.searchsorted(found, keys), len(found) - 1)] == keys if len(found) else np.zeros(len(keys), bool)


def elements_of(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, element) of lists."""
    whole_ = lists.combine_chunks()
    length = whole_.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(whole_)), length), whole_.flatten().to_numpy(zero_copy_only=False)


def crossed(table: pa.Table, x: np.ndarray, y: np.ndarray, kind: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(kind, category_id, a, b) of every listing of rows x and every one of rows y of another shop."""
    (row, listing), (_, shop) = elements_of(table["listings"]), elements_of(table["shops"])
    first = np.searchsorted(row, np.arange(table.num_rows + 1))
    fit = kind >= 0
    x, y, kind = x[fit], y[fit], kind[fit]
    n, m = first[x + 1] - first[x], first[y + 1] - first[y]
    each = np.repeat(np.arange(len(x)), n * m)
    place = np.arange(len(each)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
    a, b = first[x][each] + place // m[each], first[y][each] + place % m[each]
    other = shop[a] != shop[b]
    each, a, b = each[other], a[other], b[other]
    columns = (kind[each], ids(table, "category_id")[x[each]], listing[a], listing[b])
    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["kind", "category_id", "a", "b"])


def similar(rows: DataFrame, sizes: DataFrame, least: float, contained: float | None = None, cosine: float | None = None, kinds: Callable | None = None, spread: bool = False) -> DataFrame:
    """(category_id, bucket, id_a, id_b, j, t, o, c, digit_blocked), id_a < id_b, of the rows of a bucket across shops with equal variants, of which the word or the letter Jaccard
    reaches ``least``, or the overlap ``contained``, or the cosine ``cosine``.

    rows: (category_id, bucket, first_id, key, digits, variants, many, shop), many if there are several shops, else shop (NO_SHOP without one); with ``cosine``
    also squares, the squared weights of the key's distinct words in their order. c is 0 without ``cosine``. Empty keys are like nothing.

    With ``spread`` the rows of bucket -1 are also in every bucket of their category, but for the buckets ``mine``, in which their key has a row that holds their listings; ``every``
    has the category's buckets. These rows are compared with each other once, and the pair is given for each bucket.

    With ``kinds``, a function of j, t, o and digit_blocked that gives a number, -1 for none, and with the rows' lists listings and shops: (kind, category_id, a, b) of the
    listings of such pairs that are of different shops; a pair of rows without a content is not repeated for other buckets.
    """
    by = ("category_id", "part")
    names = ["category_id", "bucket", "id_a", "id_b", "j", "t", "o", "c", "digit_blocked"]

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        word_row, word = words_of(table["key"])
        sets, steps = compared(table, by, {"w": (word_row, word), "p": pieces_of(table["key"])})
        w, p = sets["w"], sets["p"]
        codes = lambda c: pd.factorize(table[c].to_numpy())[0]
        digits, variants, numbers = codes("digits"), codes("variants"), np.array([bool(x) for x in table["digits"].to_pylist()], bool)
        alone, only, first = ~table["many"].to_numpy(), ids(table, "shop"), ids(table, "first_id")
        category, bucket, part = ids(table, "category_id"), ids(table, "bucket"), ids(table, "part")
        if spread:
            mine_row, mine = elements_of(table["mine"])
            covered = np.unique((mine_row << 32) | mine.astype(np.int64))
        if cosine is not None:
            weight = pd.Series(elements_of(table["squares"])[1], index=word).groupby(level=0).first()
            square = weight.reindex(w.value).to_numpy()
            norm = np.bincount(w.row, weights=square, minlength=table.num_rows)
        # With fewer shared elements no threshold can be reached, whatever the other row's size.
        least_w = np.maximum(1, np.ceil(w.size * least - 1e-9)).astype(np.int64)
        least_p = np.maximum(1, np.ceil(p.size * least - 1e-9)).astype(np.int64)

        def out(x: np.ndarray, y: np.ndarray, buckets: np.ndarray, scores: list[np.ndarray], blocked: np.ndarray, category=category, first=first) -> pa.RecordBatch:
            found = [category[x], buckets, np.minimum(first[x], first[y]), np.maximum(first[x], first[y])]
            return pa.RecordBatch.from_arrays([*[pa.array(v.astype(np.int32)) for v in found], *map(pa.array, scores), pa.array(blocked)], names)

        for a, b, at, cells in steps:
            width = np.diff(np.r_[at, cells])
            cw, cp = w.counts(a, b, at, cells), p.counts(a, b, at, cells)
            some = cw > 0 if contained is not None or cosine is not None else cw >= np.repeat(least_w[a:b], width)
            cell = np.flatnonzero(some | (cp >= np.repeat(least_p[a:b], width)))
            x, y = cell_rows(cell, a, at, w.low)
            fit = (variants[x] == variants[y]) & ~(alone[x] & alone[y] & ((only[x] == only[y]) | (only[x] == NO_SHOP) | (only[y] == NO_SHOP)))
            cell, x, y = cell[fit], x[fit], y[fit]
            j = cw[cell] / np.maximum(1, w.size[x] + w.size[y] - cw[cell])
            t = cp[cell] / np.maximum(1, p.size[x] + p.size[y] - cp[cell])
            o = cw[cell] / np.maximum(1, np.minimum(w.size[x], w.size[y]))
            c = np.zeros(len(cell))
            keep = (j >= least) | (t >= least)
            if contained is not None:
                keep |= o >= contained
            if cosine is not None:
                c = w.counts(a, b, at, cells, square)[cell] / np.sqrt(np.maximum(norm[x] * norm[y], 1e-300))
                keep |= c >= cosine - 1e-12
            if spread:
                keep &= (part[x] != ACROSS) | ~among((y << 32) | bucket[x], covered)
            x, y, scores = x[keep], y[keep], [v[keep] for v in (j, t, o, c)]
            blocked = numbers[x] & numbers[y] & (digits[x] != digits[y])
            if kinds is not None:
                yield from crossed(table, x, y, kinds(*scores[:3], blocked))
                continue
            yield out(x, y, bucket[x], scores, blocked)
            if not spread:
                continue
            twice = np.flatnonzero(part[x] == -1)
            for k in np.unique(category[x[twice]]):
                pairs = twice[category[x[twice]] == k]
                every = np.array(table["every"][int(x[pairs[0]])].as_py(), np.int64)
                for i in range(0, len(pairs) if len(every) else 0, max(1, STEP // len(every)) if len(every) else 1):
                    z = np.repeat(pairs[i : i + max(1, STEP // len(every))], len(every))
                    there = np.tile(every, len(z) // len(every))
                    free = ~among((x[z] << 32) | there, covered) & ~among((y[z] << 32) | there, covered)
                    z, there = z[free], there[free]
                    yield out(x[z], y[z], there, [v[z] for v in scores], blocked[z])

    def deal(rows: DataFrame) -> list[tuple[DataFrame, DataFrame, DataFrame]]:
        dealt = [tuple(x.withColumn("part", F.col("bucket")) for x in inside(rows, ("category_id", "bucket"), sizes, F.col("first_id")))]
        if spread:
            apart = across(rows.withColumn("every", F.array().cast("array<int>")), sizes, F.col("first_id"))
            dealt.append(tuple(x.withColumn("part", F.lit(ACROSS)) for x in apart))
        return dealt

    schema = "category_id int, bucket int, id_a int, id_b int, j double, t double, o double, c double, digit_blocked boolean"
    return in_blocks(rows, deal, by, run, "kind bigint, category_id bigint, a bigint, b bigint" if kinds is not None else schema)


def likeness_of(w: Sets, steps: Iterator[tuple[int, int, np.ndarray, int]], n: np.ndarray, shop: np.ndarray) -> np.ndarray:
    """Of each row the sum of its Jaccard to the rows of other shops that it is compared with, times their n."""
    total = np.zeros(len(n))
    for a, b, at, cells in steps:
        c = w.counts(a, b, at, cells)
        cell = np.flatnonzero(c)
        x, y = cell_rows(cell, a, at, w.low)
        score = np.where(shop[x] != shop[y], c[cell] / (w.size[x] + w.size[y] - c[cell]), 0.0)
        total += np.bincount(x, weights=score * n[y], minlength=len(total)) + np.bincount(y, weights=score * n[x], minlength=len(total))
    return total


def likeness(rows: DataFrame, by: tuple[str, ...], sizes: DataFrame) -> DataFrame:
    """(*by, product_id, likeness) of rows (*by, product_id, source_id, n, key): the sum of a row's word Jaccard to each row of another shop of its group, times that row's n. Rows may have
    words, numbers that stand for them, in place of a key, which is less to move."""
    names = [*by, "product_id", "likeness"]

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        sets, steps = compared(table, by, {"w": key_sets(table["key"]) if "key" in table.column_names else elements_of(table["words"])})
        total = likeness_of(sets["w"], steps, ids(table, "n"), ids(table, "source_id"))
        kept = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([*[pa.array(ids(table, c)[kept]) for c in names[:-1]], pa.array(total[kept])], names)

    parts = in_blocks(rows, lambda x: [inside(x, by, sizes, F.col("product_id"), WIDE * BLOCK)], by, run, ", ".join(f"{c} bigint" for c in names[:-1]) + ", likeness double")
    return parts.groupBy(*names[:-1]).agg(F.sum("likeness").alias("likeness"))


def chosen(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(*by, product_id, source_id, shops) of groups (by) of at most BLOCK rows (*by, product_id, source_id, n, key) across shops: of each shop the row with the highest mean word Jaccard
    to the other shops' rows, each weighed by its n; ties go to the smaller product_id. Empty keys are alike. A group is one task's, so its rows are moved once."""
    names = [*by, "product_id", "source_id", "shops"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole(batches, by):
            zero = pa.array(np.zeros(table.num_rows, np.int64))
            for c in ("block_a", "block_b", "side"):
                table = table.append_column(c, zero)
            group = np.zeros(table.num_rows, np.int64)
            group[starts([ids(table, c) for c in by])[1:]] = 1
            group = np.cumsum(group)
            n, shop, product = ids(table, "n"), ids(table, "source_id"), ids(table, "product_id")
            of_shop, place = np.unique(np.stack([group, shop]), axis=1, return_inverse=True)
            place = place.ravel()
            sums, shops = np.bincount(place, weights=n), np.bincount(of_shop[0])
            rest = np.bincount(group, weights=n)[group] - sums[place]
            sets, steps = compared(table, by, {"w": key_sets(table["key"])})
            total = likeness_of(sets["w"], steps, n, shop)
            score = np.round(total / np.maximum(1, rest), 12)
            order = np.lexsort((product, -score, place))
            best = order[starts([place[order]])]
            best = best[shops[group[best]] > 1]
            yield pa.RecordBatch.from_arrays([*[pa.array(ids(table, c)[best]) for c in by], pa.array(product[best]), pa.array(shop[best]), pa.array(shops[group[best]].astype(np.int64))], names)

    moved = rows.select(*by, "product_id", "source_id", "n", "key").repartition(tasks(rows), *by).sortWithinPartitions(*by)
    return moved.mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def labelled(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, node, label) of the nodes of edges: label is the smallest node that a node reaches."""
    order = np.lexsort((np.r_[a, b], np.r_[group, group]))
    g, v = np.r_[group, group][order], np.r_[a, b][order]
    new = np.r_[True, (g[1:] != g[:-1]) | (v[1:] != v[:-1])] if len(g) else np.zeros(0, bool)
    code = np.empty(len(g), np.int64)
    code[order] = np.cumsum(new) - 1
    g, v, x, y = g[new], v[new], code[: len(a)], code[len(a) :]
    label = np.arange(len(v))
    while len(x):
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while np.any((up := label[label]) != label):
            label = up
        x, y = label[x], label[y]
        x, y = x[x != y], y[x != y]
    return g, v, v[label]


def components(edges: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(*by, node, label) of the nodes of edges (*by, a, b): the smallest node reachable inside the group. Each task first thins its own edges to one for each node, so what is moved, and what
    a group's task holds, grows with nodes and tasks, not with pairs."""
    names, schema = [*by, "node", "label"], ", ".join(f"{c} bigint" for c in (*by, "node", "label"))

    def labels(columns: list[np.ndarray]) -> list[np.ndarray]:
        keys = pd.MultiIndex.from_arrays(columns[: len(by)]) if len(by) > 1 else pd.Index(columns[0])
        codes, seen = pd.factorize(keys)
        g, v, label = labelled(codes, columns[-2], columns[-1])
        return [*(np.asarray(seen.get_level_values(i))[g] for i in range(len(by))), v, label]

    def out(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names)

    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n, bound = [], 0, STEP
        for batch in batches:
            kept.append([ids(batch, c) for c in (*by, "a", "b")])
            n += batch.num_rows
            if n >= bound:
                kept = [labels([np.concatenate(c) for c in zip(*kept, strict=True)])]
                n = len(kept[0][0])
                bound = max(STEP, 2 * n)
        if n:
            yield out(labels([np.concatenate(c) for c in zip(*kept, strict=True)]))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole(batches, by, STEP):
            yield out(labels([ids(table, c) for c in names]))

    few = edges.select(*by, "a", "b").mapInArrow(thinned, schema)
    return few.repartition(tasks(edges), *by).sortWithinPartitions(*by).mapInArrow(joined, schema)


def firsts(rows: DataFrame, by: str, order: tuple[str, ...], group: tuple[str, ...]) -> DataFrame:
    """The groups of rows (by, *group, product_id, ...) that stay when each product_id may be in one only: one group after the other in the order of ``order``, with what earlier ones of the same ``by`` took.
    A task holds the numbers taken, not the rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, taken = None, set()
        for table in whole(batches, (by, *group)):
            key, product = ids(table, by), ids(table, "product_id").tolist()
            begin = starts([ids(table, c) for c in (by, *group)]).tolist()
            kept = []
            for a, b in zip(begin, [*begin[1:], len(product)], strict=True):
                if key[a] != at:
                    at, taken = key[a], set()
                if taken.isdisjoint(product[a:b]):
                    taken.update(product[a:b])
                    kept.extend(range(a, b))
            yield from table.take(pa.array(kept, pa.int64())).combine_chunks().to_batches()

    placed = rows.repartition(tasks(rows), by).sortWithinPartitions(by, *order, *group)
    return placed.mapInArrow(run, rows.schema)
