"""Secrets in texts, told apart by how many owners have them.

Patterns give candidates. Their hashes are counted over the whole corpus by
distinct repositories and owners: a value that many owners or very many
repositories have is a copied example, another looks live. Strings without a telling name or form
are reported only if they look live.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom import scratch
from linkloom.llm import arrow

# The base patterns, with their least lengths.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_ASSIGN_MIN, _ACCESS_MIN = 8, 16
KINDS = ("assign", "access", "hex", "opaque")

_OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{24,}")
#: Least bits a character for a string without a telling name.
OPAQUE_BITS = 3.5
#: A value that more owners have, or more repositories of however few, is a copied example.
LIVE_OWNERS, LIVE_REPOSITORIES = 2, 20


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """``(start, kind, end, value)`` of the base kinds by start, then kind; offsets in code points."""
    found = [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= _ASSIGN_MIN]
    found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= _ACCESS_MIN]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found)


def _bits(value: str) -> float:
    """Shannon entropy in bits a character."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def opaque_spans(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Long strings of mixed digits and letters that no base span touches."""
    found = []
    for m in _OPAQUE.finditer(text):
        value = m[0]
        if any(c.isdigit() for c in value) and any(c.islower() for c in value) and any(c.isupper() for c in value) and _bits(value) >= OPAQUE_BITS:
            if not any(s < m.end() and m.start() < e for s, _, e, _ in taken):
                found.append((m.start(), 3, m.end(), value))
    return found


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(docs: DataFrame, owner_col: str | None = "source", id_col: str = "doc_id", text_col: str = "text", live_owners: int = LIVE_OWNERS, live_repositories: int = LIVE_REPOSITORIES) -> DataFrame:
    """Per row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied``.

    ``owner_col`` holds ``owner/repository`` or just an owner, who is then one
    repository; a row without one is an owner by itself. ``n_live`` and
    ``n_copied`` split all spans by whether at most ``live_owners`` owners and
    ``live_repositories`` repositories have the value; opaque strings are spans
    only if live.
    A null or empty text has no spans; null ids stay null; repeated rows each
    give a row; an empty table gives none. Texts are read once and not moved:
    only candidates are shuffled, summed by (value, owner) first.
    """
    repository = F.col(owner_col).cast("string") if owner_col else F.lit(None).cast("string")
    rows = arrow.base(docs, id_col, text_col, repository=repository)
    schema = arrow.struct(rows, ["doc_id"], "row long, n_assign long, n_access long, n_hex long, base_sha256 string, base string, found array<struct<kind:int,start:int,end:int,h1:long,h2:long,repository:string>>")

    def run(batches):
        row = TaskContext.get().partitionId() << 36
        for batch in arrow.slices(batches, "text"):
            own, counts, shas, bases, found = [], [[], [], []], [], [], []
            for text, repository in zip(arrow.texts(batch), arrow.col(batch, "repository").to_pylist()):
                spans = base_spans(text)
                base = spans_text([x[:3] for x in spans])
                kinds = Counter(k for _, k, _, _ in spans)
                for k in range(3):
                    counts[k].append(kinds[k])
                shas.append(hashlib.sha256(base.encode()).hexdigest())
                bases.append(base)
                spans = spans + opaque_spans(text, spans)
                digests = [xxhash.xxh3_128_intdigest(v.encode()) for _, _, _, v in spans]
                found.append([{"kind": k, "start": s, "end": e, "h1": (d >> 64) - (1 << 63), "h2": (d & ((1 << 64) - 1)) - (1 << 63), "repository": repository} for (s, k, e, _), d in zip(spans, digests)])
                own.append(row)
                row += 1
            kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("repository", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [arrow.col(batch, "doc_id"), pa.array(own, pa.int64()), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(bases, pa.string()), pa.array(found, kind)],
                names=schema.fieldNames(),
            )
        arrow.task_ends()

    first = scratch.written(rows.mapInArrow(run, schema), "secrets")
    spans = first.where(F.size("found") > 0).select("row", F.explode("found").alias("x")).select("row", "x.*")
    spans = spans.withColumn("owner", F.substring_index("repository", "/", 1))
    verdicts = ownership(spans, ["h1", "h2"]).select("h1", "h2", ((F.col("owners") <= live_owners) & (F.col("repositories") <= live_repositories)).alias("live"))
    judged = spans.drop("repository", "owner").join(verdicts, ["h1", "h2"])
    by_row = judged.groupBy("row").agg(
        F.sum(F.col("live").cast("long")).alias("n_live"),
        F.sum((~F.col("live") & (F.col("kind") < 3)).cast("long")).alias("n_copied"),
        F.collect_list(F.when(F.col("live") & (F.col("kind") == 3), F.struct("start", "kind", "end"))).alias("extra"),
        F.collect_list(F.when(F.col("kind") < 3, F.struct("start", "kind", "end"))).alias("known"),
    )
    names = F.array(*(F.lit(k) for k in KINDS))
    text = F.array_join(F.transform(F.array_sort(F.concat("known", "extra")), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")
    by_row = by_row.select("row", "n_live", "n_copied", F.when(F.size("extra") > 0, text).alias("all"))
    zero = F.lit(0).cast("long")
    return first.drop("found").join(by_row, "row", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("all", "base").alias("spans"), F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_copied", zero).alias("n_copied"))


def ownership(spans: DataFrame, value: list[str]) -> DataFrame:
    """``repositories`` and ``owners``, both distinct, and ``copies`` of each value.

    A row (``row``) without an owner is an owner and a repository by itself.
    Summed by value and repository before anything is counted.
    """
    alone = F.when(F.col("repository").isNull(), F.col("row")).alias("alone")
    pairs = spans.groupBy(*value, "owner", "repository", alone).agg(F.count(F.lit(1)).alias("copies"))
    by_owner = pairs.groupBy(*value, "owner", "alone").agg(F.count(F.lit(1)).alias("repositories"), F.sum("copies").alias("copies"))
    return by_owner.groupBy(*value).agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("copies").alias("copies"))
