"""Jaccard join of documents by a blocked product of the document by n-gram matrix.

The matrix is cut into blocks of columns, and its product with itself is taken
only where an entry can reach the threshold. A first pass over the blocks
accumulates, for each row, how many of its columns any other row has; a row for
which that is below the bound that its size sets is discarded. Of the rows left,
a pair is an entry of the product if the two meet in one of their first columns,
as many as their size sets, the rarest first; the cells of a column go through
one middle row, so a common column costs as many entries as it has rows, not
their square. Block by block, the columns that both rows of a pair have are
counted and added up, and pairs below the bound of their sizes are discarded.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom import scratch
from linkloom.llm import arrow, runs, shingles
from linkloom.llm.components import components

#: N-grams of one block of columns of the first pass, on average; if that makes more than ``MANY_BLOCKS``, blocks are larger, up to ``WIDEN`` times.
BLOCK_GRAMS, MANY_BLOCKS, WIDEN = 200_000, 20_000, 16
#: Pieces of a block that one task takes; more are merged in several rounds.
PIECES = 512
#: Cells that a row has in a block of columns of the product, about: longer rows are cut into twice as many blocks, and again.
ROW_CELLS = 4096
#: N-grams of a difference, the rarest first, by which a pair that meets in several is made only once.
LEAD = 32
#: The most documents whose ids are sent to every task; beyond that they are joined.
BROADCAST_IDS = 1_000_000
#: Bytes of a hash that tell columns of one block apart; two that look like one are counted too often.
_SHORT = 5


def _digest(grams: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Two sums that tell sets apart."""
    return shingles.mix(grams).sum(), shingles.mix(grams ^ np.uint64(0xD1342543DE82EF95)).sum()


def digests(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, size, d1, d2`` per row: the set's size and a digest of it."""
    rows = arrow.base(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    schema = arrow.struct(rows, ["doc_id"], "size long, d1 long, d2 long")

    def of_slice(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles.shingle_set(shingles.lower_words(t), n) for t in arrow.texts(batch)]
        sums = np.array([_digest(s) for s in sets], np.uint64).view(np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([arrow.col(batch, "doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sums[:, 0].copy()), pa.array(sums[:, 1].copy())], names=schema.fieldNames())

    return arrow.map_text(rows, of_slice, schema)


def _packed(values: np.ndarray) -> bytes:
    """The low bytes of 64-bit numbers."""
    return values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :_SHORT].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // _SHORT, 8), np.uint8)
    wide[:, :_SHORT] = np.frombuffer(raw, np.uint8).reshape(-1, _SHORT)
    return wide.view("<i8").ravel()


def _piece(block: int, part: int, grams: np.ndarray, holder: np.ndarray, nodes: np.ndarray) -> tuple:
    """A piece of a block: its columns, and in ``at`` the place in ``nodes`` of the one row that has each; the number of rows where several do."""
    used, at = np.unique(holder, return_inverse=True)
    own = nodes[used[:-1] if used[-1] == len(nodes) else used]
    return block, part, _packed(grams), at.astype("<u2" if len(own) < 1 << 16 else "<u4").tobytes(), own.astype("<i8").tobytes()


def _counts(block: int, part: int, nodes: np.ndarray, met: np.ndarray) -> tuple:
    """A piece without columns: each row's count of columns that another row has."""
    return block, part, b"", met.astype("<u4").tobytes(), nodes.astype("<i8").tobytes()


_PIECE = "block long, part long, grams binary, at binary, nodes binary"


def _pieces(found: list[tuple]) -> tuple[list[pa.Array], list[str]]:
    return [pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["block", "part", "grams", "at", "nodes"]


def _incidence(docs: DataFrame, n: int, blocks: int, text_col: str) -> DataFrame:
    """The matrix as pieces, one for each slice of documents and block of columns; columns that several rows of a slice have are counted in place."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"))

    def of_slice(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        sets = {}
        for text in arrow.texts(batch):
            grams = shingles.shingle_set(shingles.lower_words(text), n)
            if len(grams):
                sets.setdefault(int(_digest(grams)[0].view(np.int64)), grams)
        if not sets:
            return None
        nodes, own = np.array(list(sets), np.int64), np.concatenate(list(sets.values()))
        at = np.repeat(np.arange(len(sets)), [len(s) for s in sets.values()])
        grams, place, counts = np.unique(own, return_inverse=True, return_counts=True)
        holder = np.empty(len(grams), np.int64)
        holder[place] = at
        holder[counts > 1] = len(nodes)
        block = (shingles.mix(grams) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        cuts = np.searchsorted(block[order], np.arange(blocks + 1))
        part = int(shingles.mix(nodes[:1].view(np.uint64))[0] >> np.uint64(1))
        out = [_counts(int(nodes[0]) % blocks, part, nodes, np.bincount(at[counts[place] > 1], minlength=len(nodes)))]
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            some = order[cuts[k] : cuts[k + 1]]
            out.append(_piece(k, part, grams[some].view(np.int64), holder[some], nodes))
        columns, names = _pieces(out)
        return pa.RecordBatch.from_arrays(columns, names=names)

    return arrow.map_text(rows, of_slice, _PIECE)


def _merged(table: pa.Table, last: bool) -> list[tuple]:
    """One piece for several of a block, and the counts of rows that meet another there; the last round needs the counts alone.

    A row is counted for a column where the two pieces meet that first have it in
    different rows; from then on, the column is one that several rows have.
    """
    block, part = table["block"][0].as_py(), table["part"][0].as_py()
    grams, rows, known, out = [], [], [], []
    for g, a, v in zip(table["grams"].to_pylist(), table["at"].to_pylist(), table["nodes"].to_pylist()):
        if not g:
            out.append((block, part, g, a, v))
            continue
        own, columns = np.frombuffer(v, "<i8"), _unpacked(g)
        at = np.frombuffer(a, "<u2" if len(a) == 2 * len(columns) else "<u4")
        grams.append(columns)
        known.append(at < len(own))
        rows.append(np.append(own, 0)[at])
    if not grams:
        return out
    gram, row, single = np.concatenate(grams), np.concatenate(rows), np.concatenate(known)
    order = np.lexsort((row, single, gram))
    gram, row, single = gram[order], row[order], single[order]
    heads = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    place = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(gram))))
    new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (row[1:] != row[:-1]) | (single[1:] != single[:-1])])
    distinct = np.bincount(place[new], minlength=len(heads))
    shared = ~single[heads] | (distinct > 1)  # sorted first: some piece has it in several rows
    some, met = np.unique(row[single & new & shared[place]], return_counts=True)
    if len(some):
        out.append(_counts(block, part, some, met))
    if not last:
        nodes, holder = np.unique(row[heads], return_inverse=True)
        out.append(_piece(block, part, gram[heads], np.where(shared, len(nodes), holder), nodes))
    return out


def _summed(found: list[tuple]) -> pa.Table:
    """``short, met`` of pieces that are counts."""
    nodes = np.concatenate([np.frombuffer(x[4], "<i8") for x in found]) if found else np.zeros(0, np.int64)
    met = np.concatenate([np.frombuffer(x[3], "<u4") for x in found]).astype(np.int64) if found else np.zeros(0, np.int64)
    return pa.table({"d1": pa.array(nodes), "met": pa.array(met)})


def _met(matrix: DataFrame, pieces: int) -> DataFrame:
    """``d1, met``: each row's count of columns that another row has, from about so many pieces of each block.

    A task never has more than about ``PIECES`` of a block: if there are more,
    they are merged by groups, and the merged ones again, so a column that every
    slice has is one entry of a few pieces in the end.
    """

    def between(table: pa.Table) -> pa.Table:
        columns, names = _pieces(_merged(table, False))
        return pa.table(dict(zip(names, columns)))

    counted = None
    while (groups := -(-pieces // PIECES)) > 1:
        merged = scratch.written(matrix.withColumn("part", F.pmod("part", F.lit(groups))).groupBy("block", "part").applyInArrow(between, _PIECE), "pieces")
        matrix, pieces = merged.where(F.length("grams") > 0), groups
        told = merged.where(F.length("grams") == 0).mapInArrow(_flat, "d1 long, met long")
        counted = told if counted is None else counted.unionByName(told)
    last = matrix.groupBy("block").applyInArrow(lambda t: _summed(_merged(t, True)), "d1 long, met long")
    return (last if counted is None else last.unionByName(counted)).groupBy("d1").agg(F.sum("met").alias("met"))


def _flat(batches):
    for batch in batches:
        found = [(None, None, None, a, v) for a, v in zip(arrow.col(batch, "at").to_pylist(), arrow.col(batch, "nodes").to_pylist())]
        yield from _summed(found).to_batches()


def _left(docs: DataFrame, rows: DataFrame, n: int, share: int, text_col: str) -> DataFrame:
    """``d1`` of the sets that have enough columns in common with others, taken together.

    A row can be counted more than once for a column that several slices have
    with other copies of it, never less; so none that links is discarded.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_GRAMS))
    if blocks > MANY_BLOCKS:
        blocks = max(MANY_BLOCKS, -(-blocks // WIDEN))
    # a slice has so many columns at least, unless it is a partition's last; 4 MB of text are some 500,000 words
    met = _met(_incidence(docs, n, blocks, text_col), -(-total // 300_000))
    sizes = rows.where("size > 0").groupBy("d1").agg(F.min("size").alias("size"))
    return sizes.join(met, "d1").where(F.col("met") * 100 >= F.col("size") * share).select("d1")


def _level(size: int) -> int:
    """A row of that size is cut into 2 ** level blocks of columns."""
    return (max(0, size - 1) // ROW_CELLS).bit_length()


def _blocks(size: str):
    """How many that is, for an expression of the size."""
    return F.expr(f"shiftleft(1L, if({size} <= {ROW_CELLS}, 0, length(bin(({size} - 1) div {ROW_CELLS}))))")


def _cells(docs: DataFrame, nodes: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """``node, size, block, grams``: the rows in ``nodes``, cut into blocks of columns by size. Their ids are broadcast only if few."""
    rows = arrow.base(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    few = nodes.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = rows.join(F.broadcast(nodes) if few else nodes, F.col("doc_id") == F.col("node"), "left_semi")

    def of_slice(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        at, told, parts = [], [], []
        for i, text in enumerate(arrow.texts(batch)):
            grams = shingles.shingle_set(shingles.lower_words(text), n)
            block = (grams & np.uint64((1 << _level(len(grams))) - 1)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            used, starts = np.unique(block[order], return_index=True)
            for k, part in zip(used.tolist(), np.split(grams[order], starts[1:])):
                at.append(i)
                told.append((len(grams), k))
                parts.append(part.view(np.int64))
        if not at:
            return None
        ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        columns = [pa.array(c, pa.int64()) for c in zip(*told)]
        return pa.RecordBatch.from_arrays([arrow.col(batch, "doc_id").take(pa.array(at)), *columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))], names=["node", "size", "block", "grams"])

    return arrow.map_text(rows, of_slice, "node long, size long, block long, grams array<long>")


def _cut(pairs: DataFrame) -> DataFrame:
    """Pairs ``(p, q, p_size, q_size)`` with ``a``, the longer row, ``b``, the other, and how many blocks each is cut into."""
    longer = F.expr("p_size > q_size or (p_size = q_size and p < q)")
    cut = pairs.withColumn("a", F.when(longer, F.col("p")).otherwise(F.col("q"))).withColumn("b", F.when(longer, F.col("q")).otherwise(F.col("p")))
    return cut.withColumn("a_blocks", _blocks("greatest(p_size, q_size)")).withColumn("b_blocks", _blocks("least(p_size, q_size)"))


def _of(cells: DataFrame, side: str) -> DataFrame:
    return cells.select(F.col("node").alias(side), F.col("block").alias(f"{side}_block"), F.col("grams").alias(f"of_{side}"))


def _product(pairs: DataFrame, cells: DataFrame, share: int) -> DataFrame:
    """The entries of the product that ``pairs`` names: ``overlap`` added up over the blocks, and whether it links.

    A block of the longer row meets the block of the other that has its columns.
    """
    blocks = _cut(pairs).join(_of(cells, "a"), "a").withColumn("b_block", F.col("a_block").bitwiseAND(F.col("b_blocks") - 1)).join(_of(cells, "b"), ["b", "b_block"])
    met = blocks.select("p", "q", "p_size", "q_size", F.size(F.array_intersect("of_b", "of_a")).alias("n"))
    summed = met.groupBy("p", "q", "p_size", "q_size").agg(F.sum("n").alias("overlap"))
    return summed.withColumn("linked", F.col("overlap") * (100 + share) >= (F.col("p_size") + F.col("q_size")) * share)


def _differences(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """A row for each column that one row of a pair has and the other lacks, in ``gram``; block by block."""
    cut = _cut(pairs).withColumn("a_block", F.explode(F.expr("sequence(0L, a_blocks - 1)"))).withColumn("b_block", F.col("a_block").bitwiseAND(F.col("b_blocks") - 1))
    both = cut.join(_of(cells, "a"), ["a", "a_block"], "left").join(_of(cells, "b"), ["b", "b_block"], "left")
    own = F.expr("if(a_blocks = b_blocks, of_b, filter(of_b, x -> (x & (a_blocks - 1)) = a_block))")
    none = F.array().cast("array<long>")
    both = both.withColumn("of_a", F.coalesce("of_a", none)).withColumn("of_b", F.coalesce(own, none))
    return both.select(*pairs.columns, F.explode(F.concat(F.array_except("of_b", "of_a"), F.array_except("of_a", "of_b"))).alias("gram"))


def join(docs: DataFrame, n: int = 3, share: int = 90, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(doc_id, size)`` per row, and ``(node, component)`` of the linked documents.

    Two documents link if ``share`` percent of the union of their ``n``-word
    shingles are in both. Documents with equal sets are stood for by the least
    id. Of the others, those that meet in a first column are entries of the
    product with the one among them that meets most. Where that leaves several
    components, the differences from that middle document tell which other
    entries can link, see :func:`_rest`. No pair within a component is built for
    its own sake, and no link that joins two components is lost.

    Null and empty texts, and those without words, have no shingles and no
    links; rows with a null id have no links; rows with one id are one document,
    linked where any of its texts is. Repeated rows, empty tables and other
    columns are harmless.
    """
    rows = scratch.written(digests(docs, n, id_col, text_col), "digests")
    some = rows.where("size > 0 and doc_id is not null")
    least = some.groupBy("d1", "d2").agg(F.min("doc_id").alias("least"))
    same = some.select("d1", "d2", "doc_id").join(least, ["d1", "d2"]).where("doc_id <> least").select(F.col("doc_id").alias("p"), F.col("least").alias("q"))

    left = scratch.written(least.join(_left(docs, rows, n, share, text_col), "d1", "left_semi").select(F.col("least").alias("node")).distinct(), "left")
    cells = scratch.written(_cells(docs, left, n, id_col, text_col), "cells")
    scratch.release(left)
    shared = scratch.written(_first_columns(cells, share), "shared")

    weight = shared.groupBy("node").agg(F.sum("often").alias("w"))
    middle = shared.join(weight, "node").groupBy("gram").agg(F.max(F.struct(F.col("w"), (-F.col("node")).alias("m"), "size")).alias("x")).select("gram", (-F.col("x.m")).alias("p"), F.col("x.size").alias("p_size"))
    star = shared.join(middle, "gram").where("node <> p").select("p", F.col("node").alias("q"), "p_size", F.col("size").alias("q_size")).distinct()
    entries = scratch.written(_product(star, cells, share), "entries")
    scratch.release(shared)

    found = scratch.written(components(entries.where("linked").select("p", "q"), "p", "q"), "components")
    more = _product(_rest(entries, found, cells, share), cells, share)
    links = entries.where("linked").select("p", "q").unionByName(more.where("linked").select("p", "q")).unionByName(same)
    linked = components(links, "p", "q")
    for table in (cells, entries, found):
        scratch.release(table)
    return rows.select("doc_id", "size"), linked


def _first_columns(cells: DataFrame, share: int) -> DataFrame:
    """``gram, node, size, often`` of each set's first columns, the rarest first, that other sets have too.

    With ``share`` percent of the union in both, at least ``share`` percent of
    each set is in both; so one of a set's first columns, one more than it can
    lack, is among the other's first. Columns of one row come before all others.
    """
    each = cells.select("node", "size", F.explode("grams").alias("gram"))
    shared = scratch.written(runs.scan(each, ["gram"], "node", at_least=2, name="cells").distinct(), "cells")
    often = shared.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    own = Window.partitionBy("node")
    alone = F.col("size") - F.count(F.lit(1)).over(own)
    rank = F.row_number().over(own.orderBy("often", "gram")) + alone
    first = F.col("size") - F.ceil(F.col("size") * share / 100 - 1e-9) + 1
    return shared.join(often, "gram").withColumn("rank", rank).where(F.col("rank") <= first).select("gram", "node", "size", "often")


def _rest(entries: DataFrame, found: DataFrame, cells: DataFrame, share: int) -> DataFrame:
    """Pairs in different components that may link, of documents that meet the same middle ``p`` in the product.

    For sets s and y with differences S and Y from p, s and y are
    |S| + |Y| - 2 |S & Y| apart, and |S| and |Y| differ by no more than that. One
    of two documents in different components, say s, doesn't link with p, so its
    S is large; a link takes more than about half of Y in S. N-grams that no
    other difference from p has can't be among them. So of the others, ordered
    from the rarest, one of the first of Y, by how few it can miss, is one of
    the first of S: pairs come from those alone, and none from a Y without enough.
    """
    of_p = found.select(F.col("node").alias("p"), F.col("component").alias("p_component"))
    of_q = found.select(F.col("node").alias("q"), F.col("component").alias("q_component"))
    told = entries.join(of_p, "p", "left").join(of_q, "q", "left").withColumn("p_component", F.coalesce("p_component", "p")).withColumn("component", F.coalesce("q_component", "q"))
    told = told.withColumn("outside", F.expr("component <> p_component")).withColumn("d", F.expr("p_size + q_size - 2 * overlap")).drop("q_component", "p_component", "linked", "overlap")
    told = told.join(told.where("outside").select("p").distinct(), "p", "left_semi")

    ratio = (100 - share) / (100 + share)
    distance = F.col("d")
    reach = F.floor(F.col("q_size") * (1 + 100 / share) * ratio + 1e-9)
    half = F.floor((distance + (F.col("p_size") - F.col("q_size")) * ratio) / 2 + 1e-9) + 1
    as_s = F.greatest(F.lit(1), distance - reach)
    told = told.withColumn("as_s", as_s).withColumn("as_y", F.greatest(as_s, half))
    grams = _differences(told, cells)
    often = grams.groupBy("p", "gram").agg(F.count(F.lit(1)).alias("often")).where("often >= 2")
    own = Window.partitionBy("p", "q")
    grams = grams.join(often, ["p", "gram"]).withColumn("n", F.count(F.lit(1)).over(own)).withColumn("rank", F.row_number().over(own.orderBy("often", "gram")))
    grams = grams.where((F.col("outside") & F.expr("rank <= n - as_s + 1")) | F.expr("rank <= n - as_y + 1"))
    grams = scratch.written(grams.withColumn("lead", F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= LEAD, F.struct("rank", "gram"))).over(own)), lambda x: x["gram"])), "grams")
    told = ("q", "q_size", "component", "d", "n", "rank", "last", "lead")
    s = grams.where(F.col("outside")).withColumn("last", F.expr("n - as_s + 1")).where("rank <= last").select("p", "gram", *(F.col(c).alias(f"s_{c}") for c in told))
    y = grams.withColumn("last", F.expr("n - as_y + 1")).where("rank <= last").select("p", "gram", *(F.col(c).alias(f"y_{c}") for c in told))
    fits = F.least("s_q_size", "y_q_size") * 100 >= F.greatest("s_q_size", "y_q_size") * share
    # what S and Y can have in common before, at and after this n-gram, against what a link takes
    enough = F.expr(f"2 * (least(s_rank, y_rank) + least(s_n - s_rank, y_n - y_rank)) >= s_d + y_d - (s_q_size + y_q_size) * {100 - share} div {100 + share}")
    # of the first n-grams that both have there, only the first makes the pair; both order them alike
    met = F.expr(f"array_intersect(slice(s_lead, 1, greatest(0, least({LEAD}, s_last))), slice(y_lead, 1, greatest(0, least({LEAD}, y_last))))")
    once = F.when(F.size(met) > 0, met[0] == F.col("gram")).otherwise(F.lit(True))
    pairs = s.join(y, ["p", "gram"]).where(F.expr("s_component <> y_component") & fits & enough & once)
    ends = F.expr("if(s_q < y_q, struct(s_q as p, y_q as q, s_q_size as p_size, y_q_size as q_size), struct(y_q as p, s_q as q, y_q_size as p_size, s_q_size as q_size))")
    return pairs.select(ends.alias("x")).select("x.*").distinct()


def classes(docs: DataFrame, n: int = 3, share: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row: the least id reachable by links, its own without any; null without an id."""
    rows, found = join(docs, n, share, id_col, text_col)
    return rows.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 3, share: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the least of its component; those without an id or without words all stay."""
    _, found = join(docs, n, share, id_col, text_col)
    name = f"node-{uuid.uuid4().hex}"  # no column of docs has it
    others = found.where("node <> component").select(F.col("node").alias(name))
    return docs.join(others, F.col(id_col).cast("long") == F.col(name), "left_anti")
