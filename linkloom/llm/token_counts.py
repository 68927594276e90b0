"""Token counts of sections, from tokens of whole documents.

A document is encoded once; cutting it first would change the tokens at the
cuts. Tokens have character spans, sections have character spans, and the two
are joined as intervals. A token that lies in several sections is allocated by
an explicit rule.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm import arrow, segments

RULES = ("first", "last", "most")


@lru_cache(maxsize=2)
def _coder(rank_file: str, pattern: str):
    import tiktoken

    ranks = segments.ranks(rank_file)
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, n in ranks.items():
        sizes[n] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def allocate(starts: np.ndarray, ends: np.ndarray, cuts: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """The section of each token ``[start, end)``, and whether it crosses a boundary.

    Section ``k`` is ``[cuts[k], cuts[k + 1])``. ``first`` and ``last`` take the
    section of the token's first or last position, ``most`` the one that holds
    most of it, the earlier if two hold as much.
    """
    first = np.searchsorted(cuts, starts, "right") - 1
    last = np.searchsorted(cuts, ends - 1, "right") - 1
    crosses = first != last
    if rule == "first":
        return first, crosses
    if rule == "last":
        return last, crosses
    if rule != "most":
        raise ValueError(f"no such rule: {rule}")
    best = first.copy()
    for t in np.flatnonzero(crosses):
        k = np.arange(first[t], last[t] + 1)
        best[t] = k[np.argmax(np.minimum(cuts[k + 1], ends[t]) - np.maximum(cuts[k], starts[t]))]
    return best, crosses


def _tokens(text: str, rank_file: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each token of the whole text starts and ends, in bytes."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    coder, sizes = _coder(rank_file, pattern)
    ends = np.cumsum(sizes[coder.encode_to_numpy(text, disallowed_special=())])
    return np.concatenate([[0], ends[:-1]]), ends


def by_section(docs: DataFrame, rank_file: str, pattern: str, rule: str = "first", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per line of each document: ``doc_id, section, start_char, n_chars, n_tokens, n_crossing``.

    A section is a line with the line feed that ends it, so that sections tile
    the text; ``start_char`` and ``n_chars`` are in code points. ``n_tokens`` are
    the tokens allocated to the section by ``rule`` (they sum to the document's
    tokens), ``n_crossing`` those of them that reach into another section. A
    null or empty text has one section without tokens; a null id stays null;
    repeated rows are counted each; an empty table gives no rows. Other columns
    are ignored. Nothing is shuffled.
    """
    rows = arrow.base(docs, id_col, text_col)
    schema = arrow.struct(rows, ["doc_id"], "section long, start_char long, n_chars long, n_tokens long, n_crossing long")

    def of_slice(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, columns = [], [[] for _ in range(5)]
        for text in arrow.texts(batch):
            raw = np.frombuffer(text.encode(), np.uint8)
            starts, ends = _tokens(text, rank_file, pattern)
            cuts = np.concatenate([[0], np.flatnonzero(raw == 10) + 1, [len(raw)]]).astype(np.int64)
            if len(cuts) > 2 and cuts[-1] == cuts[-2]:
                cuts = cuts[:-1]
            section, crosses = allocate(starts, ends, cuts, rule)
            chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[cuts]
            n = len(cuts) - 1
            counts.append(n)
            for column, values in zip(columns, (np.arange(n), chars[:-1], np.diff(chars), np.bincount(section, minlength=n), np.bincount(section[crosses], minlength=n))):
                column.append(values)
        ids = arrow.col(batch, "doc_id").take(pa.array(np.repeat(np.arange(batch.num_rows), counts)))
        return pa.RecordBatch.from_arrays([ids, *(pa.array(np.concatenate(c).astype(np.int64)) for c in columns)], names=schema.fieldNames())

    return arrow.map_text(rows, of_slice, schema)


def tiles(given: list[tuple[int, int]], n: int) -> tuple[list[int], list[int]]:
    """Cuts that tile a text of ``n`` code points, and the number of the given section that each tile is, or -1.

    Sections are clipped to the text; where two overlap, the earlier one ends
    where the later one starts. Of two that start together, the first given one
    is the earlier, and so is empty.
    """
    clipped = [(min(max(0, a), n), min(max(0, a, b), n)) for a, b in given]
    order = sorted(range(len(given)), key=lambda k: clipped[k][0])
    cuts, of = [0], []
    for k, after in zip(order, [*order[1:], None]):
        start, end = clipped[k]
        end = end if after is None else min(end, clipped[after][0])
        for at, what in ((start, -1), (end, k)):
            if at > cuts[-1]:
                cuts.append(at)
                of.append(what)
    if n > cuts[-1] or not of:
        cuts.append(n)
        of.append(-1)
    return cuts, of


def _by_spans(rows: DataFrame, rank_file: str, pattern: str, rule: str) -> DataFrame:
    """Counts of rows with ``doc_id``, ``text`` and ``given``, an array of structs ``section, start, end`` in code points."""
    schema = arrow.struct(rows, ["doc_id"], "section string, start_char long, n_chars long, n_tokens long, n_crossing long")

    def of_slice(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, columns = [], [[] for _ in range(5)]
        for i, (text, given) in enumerate(zip(arrow.texts(batch), arrow.col(batch, "given").to_pylist())):
            given = [x for x in given or [] if x["start"] is not None and x["end"] is not None]
            raw = np.frombuffer(text.encode(), np.uint8)
            bytes_at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
            cuts, of = tiles([(x["start"], x["end"]) for x in given], len(text))
            tile, crosses = allocate(*_tokens(text, rank_file, pattern), bytes_at[cuts], rule)
            own = np.array(of, np.int64) + 1  # 0 is what no section has
            sums = [np.bincount(own[t], minlength=len(given) + 1) for t in (tile, tile[crosses])]
            starts, sizes = [None] * (len(given) + 1), [0] * (len(given) + 1)
            for k, a, b in zip(own.tolist(), cuts, cuts[1:]):
                starts[k] = a if starts[k] is None else starts[k]
                sizes[k] += b - a
            for k, x in enumerate([None, *given]):
                if k or 0 in own:
                    at.append(i)
                    first = 0 if x is None else min(max(0, x["start"]), len(text))
                    for column, value in zip(columns, (x and x["section"], first if starts[k] is None else starts[k], sizes[k], int(sums[0][k]), int(sums[1][k]))):
                        column.append(value)
        ids = arrow.col(batch, "doc_id").take(pa.array(at, pa.int64()))
        kinds = (pa.string(), *[pa.int64()] * 4)
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, kinds))], names=schema.fieldNames())

    return arrow.map_text(rows, of_slice, schema)


def by_given_sections(docs: DataFrame, sections: DataFrame, rank_file: str, pattern: str, rule: str = "first", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per given section of each document: ``doc_id, section, start_char, n_chars, n_tokens, n_crossing``.

    ``sections`` has ``doc_id, section, start_char, end_char`` (code points, end
    exclusive). They needn't cover the text and are made to tile it as
    :func:`tiles` says; what none has is a row whose section is null. Sections
    without a place, or of no document, are left out; a document's rows are in
    order of start, then end, then name for ties. A null or empty text without
    sections has one row without tokens; a null id has no sections; repeated
    documents are counted each; an empty table gives no rows. Other columns are
    ignored. Sections are joined to their documents before a document is encoded.
    """
    own = sections.select(F.col("doc_id").alias("of"), F.struct(F.col("start_char").cast("long").alias("start"), F.col("end_char").cast("long").alias("end"), F.col("section").cast("string").alias("section")).alias("x"))
    own = own.where("of is not null and x.start is not null and x.end is not null").groupBy("of").agg(F.sort_array(F.collect_list("x")).alias("given"))
    rows = arrow.base(docs, id_col, text_col)
    return _by_spans(rows.join(own, rows["doc_id"] == own["of"], "left").select("doc_id", "text", "given"), rank_file, pattern, rule)


def by_field(docs: DataFrame, fields: list[str], rank_file: str, pattern: str, rule: str = "first", between: str = "\n", id_col: str = "doc_id") -> DataFrame:
    """Per text column of each document: what :func:`by_given_sections` gives for them, joined to one text by ``between``.

    A field's section has the ``between`` that follows it. Null fields are empty.
    Nothing is shuffled.
    """
    texts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    whole = [F.concat(t, F.lit(between)) for t in texts[:-1]] + texts[-1:]
    ends = [sum((F.length(x) for x in whole[: k + 1]), F.lit(0)).cast("long") for k in range(len(whole))]
    starts = [F.lit(0).cast("long"), *ends[:-1]]
    given = F.array(*(F.struct(F.lit(f).alias("section"), a.alias("start"), b.alias("end")) for f, a, b in zip(fields, starts, ends)))
    return _by_spans(docs.select(F.col(id_col).alias("doc_id"), F.concat(*whole).alias("text"), given.alias("given")), rank_file, pattern, rule)
