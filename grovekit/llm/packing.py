"""Filling fixed-capacity containers, shortest pack first, over the histogram of lengths.

Only the histogram (at most one count per length up to the capacity) reaches the driver.  There lengths are placed longest
first into the open packs that are shortest so far, whole groups of equal packs at a time; the result is a list of packing
patterns with their counts.  Documents are numbered within their length and joined back to the patterns' slots by that rank.

A text longer than the capacity is cut into full pieces and a rest; all others stay whole.  Separators lie between neighbours
only, so each piece is counted with one and the capacity is widened by one.  Texts without tokens (null, empty) fill nothing and
are in no container; capacities that are null or not positive hold nothing.  Repeated texts are packed as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.llm.tokens import VOCABULARY, sized
from grovekit.scale import Workspace, distributed_rank, read


@dataclass
class Pattern:
    """``count`` containers, each with ``times`` pieces of each length, longest first."""

    count: int
    pieces: tuple[tuple[int, int], ...]


def pack_histogram(histogram: dict[int, int], capacity: int, separator: int) -> list[Pattern]:
    """Patterns that hold exactly the histogram's pieces (length -> count, all at most ``capacity``).

    Lengths come longest first; each piece goes to an open pack that is shortest so far, if it fits there, or else opens one.
    """
    room_all = capacity + separator
    open_: dict[int, list[Pattern]] = {}
    done: list[Pattern] = []

    def put(p: Pattern, room: int) -> None:
        if p.count:
            open_.setdefault(room, []).append(p) if room > separator else done.append(p)

    for length in sorted(histogram, reverse=True):
        left, size = histogram[length], length + separator
        for room in sorted((r for r in open_ if r >= size), reverse=True):
            for p in open_.pop(room):
                if not left:
                    put(p, room)
                    continue
                each = min(room // size, left // p.count)
                more = left - each * p.count if each < room // size else 0
                for count, times in ((p.count - more, each), (more, each + 1)):
                    put(Pattern(count, (*p.pieces, (length, times)) if times else p.pieces), room - times * size)
                left -= each * p.count + more
        if left:
            fit = room_all // size
            put(Pattern(left // fit, ((length, fit),)), room_all - fit * size)
            put(Pattern(int(left % fit > 0), ((length, left % fit),)), room_all - (left % fit) * size)
    return done + [p for ps in open_.values() for p in ps]


def slots(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """For each length: rows (first rank, first container, times a container, place of the first in the container)."""
    out: dict[int, list] = {}
    used: dict[int, int] = {}
    first = 0
    for p in patterns:
        place = 0
        for length, times in p.pieces:
            rank = used.get(length, 0)
            out.setdefault(length, []).append((rank, first, times, place))
            used[length] = rank + p.count * times
            place += times
        first += p.count
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def pieces_of(sizes: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack_id, doc_id, piece_no, n_piece): each document's pieces for each container size."""
    kept = packs.where("pack_id is not null and capacity_tokens > 0").select("pack_id", F.col("capacity_tokens").cast("bigint").alias("cap")).distinct()
    every = sizes.where("n_tokens > 0").select("doc_id", "n_tokens").join(F.broadcast(kept))  # a handful of sizes, one pass over the documents
    n = F.ceil(F.col("n_tokens") / F.col("cap")).cast("int")
    cut = every.withColumn("piece_no", F.explode(F.sequence(F.lit(0), n - 1)))
    return cut.select("pack_id", "doc_id", "piece_no", F.least(F.col("cap"), F.col("n_tokens") - F.col("piece_no") * F.col("cap")).alias("n_piece"))


def packed(sizes: DataFrame, packs: DataFrame, ws: Workspace) -> DataFrame:
    """(pack_id, container_id, place, doc_id, piece_no, start_token, n_tokens): every piece in its container.

    ``sizes`` is (doc_id, n_tokens), ``packs`` (pack_id, capacity_tokens, separator_tokens), a handful of rows; of a pack_id
    given twice the largest capacity counts.
    """
    packs = packs.where("pack_id is not null and capacity_tokens > 0").groupBy("pack_id").agg(F.max("capacity_tokens").alias("capacity_tokens"), F.max(F.coalesce("separator_tokens", F.lit(0))).alias("separator_tokens"))
    wanted = {r.pack_id: (int(r.capacity_tokens), int(r.separator_tokens)) for r in packs.collect()}
    pieces = ws.save(pieces_of(sizes, packs), "pieces")
    counts: dict[int, dict[int, int]] = {k: {} for k in wanted}
    for r in pieces.groupBy("pack_id", "n_piece").agg(F.count(F.lit(1)).alias("n")).collect():  # at most capacity_tokens rows a pack
        counts[r.pack_id][int(r.n_piece)] = int(r.n)
    table = {k: slots(pack_histogram(counts[k], *wanted[k])) for k in wanted}
    caps = {k: c for k, (c, _) in wanted.items()}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            outs = []
            for (pack, length), g in pdf.groupby(["pack_id", "n_piece"], sort=False):
                t = table[pack][length]
                at = np.searchsorted(t[:, 0], g["rank"].to_numpy(), side="right") - 1
                within = g["rank"].to_numpy() - t[at, 0]
                outs.append(pd.DataFrame({"pack_id": pack, "container_id": t[at, 1] + within // t[at, 2], "place": t[at, 3] + within % t[at, 2], "doc_id": g["doc_id"],
                                          "piece_no": g["piece_no"], "start_token": g["piece_no"].astype("int64") * caps[pack], "n_tokens": g["n_piece"]}))
            if outs:
                yield pd.concat(outs, ignore_index=True)

    ranked = distributed_rank(pieces, ["pack_id", "n_piece"], [F.col("doc_id"), F.col("piece_no")], "rank")
    return ranked.mapInPandas(place, "pack_id int, container_id bigint, place bigint, doc_id bigint, piece_no int, start_token bigint, n_tokens bigint")


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "p6")
    return packed(ws.save(sized(read(spark, sf_dir, "documents"), vocabulary=VOCABULARY), "sizes"), read(spark, sf_dir, "pack_capacity"), ws)


def fill_report(pieces: DataFrame, packs: DataFrame) -> DataFrame:
    """For each container size: containers, pieces, tokens and separators in them, unused share, least possible containers."""
    per = pieces.groupBy("pack_id", "container_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("k"))
    one = per.join(F.broadcast(packs.select("pack_id", "capacity_tokens", "separator_tokens")), "pack_id")
    used = F.col("t") + (F.col("k") - 1) * F.col("separator_tokens")
    return one.groupBy("pack_id", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("k").alias("n_pieces"), F.sum("t").alias("n_tokens"), F.max(used).alias("fullest"),
        (1 - F.sum(used) / (F.count(F.lit(1)) * F.first("capacity_tokens"))).alias("unused_share"),
        F.ceil(F.sum(F.col("t") + F.col("k") * F.col("separator_tokens")) / F.first(F.col("capacity_tokens") + F.col("separator_tokens"))).alias("least_containers"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(p6_packed(spark, sf_dir), read(spark, sf_dir, "pack_capacity"))
