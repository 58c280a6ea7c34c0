"""Resampling: bootstrap over per-entity partials, folds, noise and controls (RSM)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from grovekit.scale import Workspace, parts_for, score_cuts


# The distribution function of the Poisson law of mean 1, up to 8.
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.999998874797402]
#: Draws that one digest gives: eight hex digits each.
DRAWS = 4
#: Rows of a chunk of ranked rows, numbers drawn at once, and the mark of a number that a hash's upper bits don't tell.
CHUNK, CELLS, OPEN = 10_000, 1 << 16, 255


def replicate_weights(df: DataFrame, entity: Sequence[str], replicates: int, seed: int = 42) -> DataFrame:
    """Rows with ``_rep`` and ``_times``: how often a replicate draws the row's entity.

    Draws are independent Poisson numbers of mean 1, read from a digest of seed, entity and replicate, so they are the same in every
    engine and at every layout, and rows of one entity are drawn alike.  Replicates that don't draw the row are left out.
    Nothing is joined: rows are multiplied as they stream into the aggregation that follows, which combines them before its
    shuffle to one row a replicate and partition.
    """
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in entity], F.col("_k").cast("string"))
    blocks = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // DRAWS) - 1)))).withColumn("_h", F.md5(text))
    parts = blocks.withColumn("_i", F.explode(F.lit(list(range(DRAWS))))).where(F.col("_k") * DRAWS + F.col("_i") < replicates)
    drawn = parts.withColumn("_u", F.conv(F.expr("substring(_h, 8 * _i + 1, 8)"), 16, 10).cast("bigint"))
    times = F.lit(len(POISSON))
    for k, c in reversed(list(enumerate(POISSON))):
        times = F.when(F.col("_u") < math.ceil(c * (1 << 32)), k).otherwise(times)
    return drawn.select(*df.columns, (F.col("_k") * DRAWS + F.col("_i")).cast("bigint").alias("_rep"), times.alias("_times")).where("_times > 0")


def bootstrap_sums(partials: DataFrame, entity: Sequence[str], sums: Sequence[str], replicates: int, by: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """(_rep, by…, _s0, _s1, …): sums of the columns ``sums`` over resampled entities, for each replicate; one pass over the partials."""
    named = [F.col(c).alias(f"_s{i}") for i, c in enumerate(sums)]
    w = replicate_weights(partials.select(*entity, *by, *named), entity, replicates, seed)
    return w.groupBy("_rep", *by).agg(*[F.sum(F.col(f"_s{i}") * F.col("_times")).alias(f"_s{i}") for i in range(len(sums))])


def bootstrap_ratio(partials: DataFrame, entity: Sequence[str], num: str, den: str, replicates: int) -> DataFrame:
    """(b, value): ratio of sums over resampled entities, for each replicate."""
    return bootstrap_sums(partials, entity, [num, den], replicates).select(F.col("_rep").alias("b"), (F.col("_s0") / F.col("_s1")).alias("value"))


def paired_bootstrap(partials: DataFrame, entity: Sequence[str], a: str, b: str, den: str, replicates: int) -> DataFrame:
    """(b, delta): second system minus first on the same draws."""
    return bootstrap_sums(partials, entity, [a, b, den], replicates).select(F.col("_rep").alias("b"), ((F.col("_s1") - F.col("_s0")) / F.col("_s2")).alias("delta"))


def bootstrap_macro_f1(partials: DataFrame, entity: Sequence[str], replicates: int) -> DataFrame:
    """(b, value): macro F1 of each replicate from (entity, cls, tp, n_pred, n_true)."""
    s = bootstrap_sums(partials, entity, ["tp", "n_pred", "n_true"], replicates, by=["cls"])
    return s.groupBy(F.col("_rep").alias("b")).agg(F.avg(2 * F.col("_s0") / F.greatest(F.col("_s1") + F.col("_s2"), F.lit(1.0))).alias("value"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _times(hashes: np.ndarray) -> np.ndarray:
    return np.searchsorted(POISSON, hashes / 2.0**64, side="right").astype(np.uint8)


@cache
def _by_top_bits() -> np.ndarray:
    """The Poisson number of each value of a hash's upper 16 bits, or ``OPEN`` where the lower bits decide."""
    low = np.arange(1 << 16, dtype=np.uint64) << np.uint64(48)
    least, most = _times(low), _times(low | np.uint64((1 << 48) - 1))
    return np.where(least == most, least, OPEN).astype(np.uint8)


def drawn(images: np.ndarray, replicates: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """(b, w): Poisson numbers of mean 1 by a hash of image and replicate, a row for each of a few replicates from ``b`` on, a column for each image.

    About ``CELLS`` numbers are held at once, however many replicates there are; ``w`` is overwritten by the next ones.
    """
    table = _by_top_bits()
    with np.errstate(over="ignore"):
        left = _mixed(images.astype(np.int64).view(np.uint64) + np.uint64(seed))
        right = np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    each = min(replicates, max(1, CELLS // max(1, len(left))))
    hashes, moved, weights = (np.empty((each, len(left)), kind) for kind in (np.uint64, np.uint64, np.uint8))
    for b in range(0, replicates, each):
        h, m, w = (x[: replicates - b] for x in (hashes, moved, weights))
        np.add(left[None, :], right[b : b + each, None], out=h)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # as in _mixed, in place
            np.right_shift(h, np.uint64(shift), out=m)
            np.bitwise_xor(h, m, out=h)
            np.multiply(h, np.uint64(factor), out=h)
        np.right_shift(h, np.uint64(48), out=m)  # the last step of _mixed leaves these bits alone
        np.take(table, m.view(np.int64), out=w, mode="clip")
        if len(at := np.flatnonzero(w.reshape(-1) == OPEN)):
            whole = h.reshape(-1)[at]
            w.reshape(-1)[at] = _times(whole ^ (whole >> np.uint64(31)))
        yield b, w


def image_weights(images: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """The numbers of :func:`drawn` at once, a row for each image and a column for each replicate."""
    return np.concatenate([w.astype(np.float32) for _, w in drawn(images, replicates, seed)]).T


def bootstrap_ap(flags: DataFrame, truths: DataFrame, replicates: int, ws: Workspace, seed: int = 42, band_rows: int = 100_000) -> DataFrame:
    """(b, cls, ap): 101-point average precision of each replicate, images resampled.

    ``flags`` is (stem, cls, score, tie, tp), matched once; ``truths`` (stem, cls, n).  Neither is copied: rows are sorted into
    ranges of class, falling score and tie, so rows of equal score part too, and streamed off as chunks of ``CHUNK`` rows with their
    weighted counts for all replicates; the counts of the chunks before it are carried into each.  What leaves a chunk is the best
    precision for each replicate and recall step that it reaches.  A task holds one batch of chunks and the weights of a few
    replicates, whatever the tables' size.  ``tie`` orders rows of equal score; it may be a struct, which is sorted field by
    field.  Of rows with the same tie, false ones come first; rows without class count nowhere.
    """
    kind = flags.schema["tie"].dataType
    ties = [F.col(f"tie.{f}").alias(f"_tie{i}") for i, f in enumerate(kind.names)] if isinstance(kind, StructType) else [F.col("tie").alias("_tie0")]
    order = ["cls", F.desc("score"), *[f"_tie{i}" for i in range(len(ties))], "tp"]
    flags = ws.save(flags.where("cls IS NOT NULL").select(F.col("stem").cast("bigint").alias("stem"), "cls", "score", *ties, "tp"), "flags")
    ws.release()
    parts, chunk = parts_for(flags.count(), band_rows), min(CHUNK, band_rows)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seq = 0
        for pdf in batches:
            cls, stem, tp = pdf["cls"].to_numpy(), pdf["stem"].to_numpy(), pdf["tp"].to_numpy(bool)
            rows = []
            for lo, hi in pairwise([0, *(np.flatnonzero(cls[1:] != cls[:-1]) + 1), len(cls)]):
                for at in range(lo, hi, chunk):
                    own = slice(at, min(at + chunk, hi))
                    true = np.flatnonzero(tp[own])
                    n, t = np.empty((2, replicates), np.int32)
                    for b, w in drawn(stem[own], replicates, seed):
                        n[b : b + len(w)] = w.sum(axis=1, dtype=np.int32)
                        t[b : b + len(w)] = w.take(true, axis=1).sum(axis=1, dtype=np.int32)
                    rows.append((int(cls[at]), seq, stem[own], tp[own], n, t))
                    seq += 1
            yield pd.DataFrame(rows, columns=["cls", "seq", "stem", "tp", "n", "t"])

    def true_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for cls, own in pdf.groupby("cls"):
                g, stem, n = sums.setdefault(int(cls), np.zeros(replicates)), own["stem"].to_numpy(), own["n"].to_numpy(float)
                for at in range(0, len(own), CHUNK):
                    for b, w in drawn(stem[at : at + CHUNK], replicates, seed):
                        g[b : b + len(w)] += w.astype(float) @ n[at : at + CHUNK]
        yield pd.DataFrame(list(sums.items()), columns=["cls", "g"])

    # a chunk's place is that of its range, then its number there
    ranged = flags.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("cls", "stem", "tp")
    chunks = ws.save(ranged.mapInPandas(pack, "cls int, seq int, stem array<bigint>, tp array<boolean>, n array<int>, t array<int>").withColumn("part", F.spark_partition_id()), "chunks")
    ws.drop("flags")
    ws.release()
    parted = truths.select(F.col("stem").cast("bigint").alias("stem"), "cls", "n").mapInPandas(true_part, "cls int, g array<double>")
    real = ws.save(parted.select("cls", F.posexplode("g").alias("b", "g")).groupBy("cls", "b").agg(F.sum("g").alias("g")), "real")
    whole = real.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("b", "g"))).alias("o")).select("cls", F.col("o.g").alias("g"))  # one number a replicate
    key = ["cls", "part", "seq"]
    earlier = Window.partitionBy("cls", "b").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    long = chunks.select(*key, F.posexplode(F.arrays_zip("n", "t")).alias("b", "x"))
    carried = long.select(*key, "b", *[F.coalesce(F.sum(f"x.{c}").over(earlier), F.lit(0)).alias(f"{c}0") for c in ("n", "t")])
    carried = carried.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("b", "n0", "t0"))).alias("o")).select(*key, F.col("o.n0").alias("n0"), F.col("o.t0").alias("t0"))  # one number a replicate

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                yield best_of(int(r.cls), np.asarray(r.stem), np.asarray(r.tp, dtype=bool), *(np.asarray(x, dtype=float) for x in (r.n0, r.t0, r.g)))

    def best_of(cls: int, stem: np.ndarray, tp: np.ndarray, n0: np.ndarray, t0: np.ndarray, g: np.ndarray) -> pd.DataFrame:
        true = np.flatnonzero(tp)  # precision falls at all other rows
        found = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
        for b, w in drawn(stem, replicates, seed) if len(true) else ():
            few = slice(b, b + len(w))
            k = np.cumsum(w, axis=1, dtype=np.int32).take(true, axis=1) + n0[few, None]
            hit = np.cumsum(w.take(true, axis=1), axis=1, dtype=np.int32) + t0[few, None]
            precision = hit / np.maximum(k, 1)
            step = lambda x, i: np.floor(np.divide(x, g[i, None], out=np.zeros_like(x), where=g[i, None] > 0) * 100 + 1e-9).astype(int).clip(0, 100)
            first, last = step(hit[:, [0, -1]], np.arange(b, b + len(w))).T
            one = np.flatnonzero(first == last)
            found.append((b + one, first[one], precision[one].max(axis=1)))
            if len(more := np.flatnonzero(first != last)):
                at = step(hit[more], b + more)
                begins = np.flatnonzero(np.c_[np.ones(len(more), bool), at[:, 1:] != at[:, :-1]])
                found.append((b + more[begins // len(true)], at.ravel()[begins], np.maximum.reduceat(precision[more].ravel(), begins)))
        b, t, p = map(np.concatenate, zip(*found, strict=True))
        return pd.DataFrame({"cls": cls, "b": b.astype("int64"), "t": t.astype("int32"), "p": p})[p > 0]

    tasks = 2 * parts  # set, as the chunks' bytes say little of the work in them
    placed = chunks.select(*key, "stem", "tp").repartition(tasks, *key).join(carried.join(whole, "cls").repartition(tasks, *key), key)
    points = placed.mapInPandas(best, "cls int, b bigint, t int, p double")
    top = points.groupBy("cls", "b", "t").agg(F.max("p").alias("p"))
    grid = top.groupBy("cls", "b").agg(F.map_from_entries(F.collect_list(F.struct("t", "p"))).alias("m"))  # 101 steps at most
    envelope = F.aggregate(F.sequence(F.lit(0), F.lit(100)), F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("sum")), lambda s, i: F.struct(
        F.greatest(s["run"], F.coalesce(F.try_element_at("m", 100 - i), F.lit(0.0))).alias("run"), (s["sum"] + F.greatest(s["run"], F.coalesce(F.try_element_at("m", 100 - i), F.lit(0.0)))).alias("sum")))
    return real.where("g > 0").join(grid, ["cls", "b"], "left").select("b", "cls", F.coalesce(envelope["sum"] / 101, F.lit(0.0)).alias("ap"))


def interval(df: DataFrame, c: str) -> DataFrame:
    ci = F.percentile(c, F.array(F.lit(0.025), F.lit(0.975)))
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(c).alias("mean"), ci[0].alias("lo"), ci[1].alias("hi"), F.avg((F.col(c) > 0).cast("int")).alias("p_above"))


def positions(df: DataFrame, key: str) -> DataFrame:
    """Rows with ``pos``: their place in the order of ``key``, from 0, by counts of key ranges rather than one global sort."""
    cuts = score_cuts(df, key, parts_for(df.count()))
    banded = df.withColumn("_b", F.size(F.filter(F.lit(cuts), lambda c: c <= F.col(key))))
    sizes = banded.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    off = sizes.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))  # one row a range
    w = Window.partitionBy("_b").orderBy(key)
    return banded.withColumn("_r", F.row_number().over(w)).join(off, "_b").withColumn("pos", F.col("_o") + F.col("_r") - 1).drop("_b", "_r", "_o")


def fold_of(key: Column, folds: int, seed: int = 42) -> Column:
    """A fold for each entity, by hash: rows of one entity never part."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds)).cast("int")


def jitter(df: DataFrame, sd: float, drop: float, seed: int) -> DataFrame:
    """Boxes moved by normal noise of ``sd``, a share ``drop`` lost; repeatable for the same table layout and seed."""
    moved = {c: F.col(c) + sd * F.randn(seed + i) for i, c in enumerate(("x1", "y1", "x2", "y2"))}
    return df.where(F.rand(seed) >= drop).withColumns(moved)


def spoil_labels(df: DataFrame, cls: str, classes: int, share: float, key: Sequence[str], seed: int) -> DataFrame:
    """A share of labels replaced by the next class, chosen by a hash of the key."""
    u = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    return df.withColumn("noisy", F.when(u < share, (F.col(cls) + 1) % classes).otherwise(F.col(cls)))


def donors(df: DataFrame, key: str) -> DataFrame:
    """(key, donor): each entity's successor in the order of the key, the last's being the first; keys are numbered by ``positions``."""
    p = positions(df.select(key).distinct(), key)
    n = p.count()
    nxt = p.select(F.pmod(F.col("pos") - 1, F.lit(n)).alias("pos"), F.col(key).alias("donor"))
    return p.join(nxt, "pos").select(key, "donor")
