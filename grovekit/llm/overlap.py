"""Same or near-same records across splits, found by Aho-Corasick automata over sharded evaluation passages.

A record is normalised to a text.  Of the tree it names that is the phrase of variety, block and number; of its document, a
phrase of four symbols for each box: the cells of cx, cy, w and h on a grid.  The evaluation records' phrases are the passages; a
box also passes under the neighbouring cells that may hold a box within the tolerance.  Passages are sharded by evaluation
record, an automaton is built of each shard in the task that scans with it, and a training text is scanned whole by every shard
that may match it (a shard with more texts than one task should scan has several salted copies).  A record's passages are all in
one automaton and a text is scanned in one piece, so the task itself merges the matched intervals into the coverage of each
(evaluation record, training record) and only pairs covered well enough leave it; those are checked exactly, by a largest
one-to-one pairing of their boxes.

Which shards may match is known beforehand: names are sharded by the name itself, and a record that may miss m boxes has
partners for both boxes of one of m + 1 disjoint pairs, so a text goes to the shards of those records only with which it shares
such a pair (``find_routes``).  No pair is lost, and texts aren't copied for each shard.

An evaluation record needs all but a fifth of its boxes matched, so only its rarest passages, that fifth and ``SPARE`` more,
are searched, and ``SPARE`` of them must be covered: no true pair is lost (a counting filter, not a sample).  Documents with the
very same boxes, and rows that name the same tree, form one class; only classes are compared, and members are joined to the
classes' pairs at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grovekit.functions.names import split_name, tree_key
from grovekit.scale import Workspace, parts_for, read, salt_of

TOLERANCE, EPS = 0.01, 1e-9
CELL = 0.02  # about twice the tolerance: then a box lies near two cells a dimension, near three if it is at a cell's centre
LEAST_BOXES, SHARE = 6, (4, 5)
SPARE = 4
#: Phrases in one automaton (at most four nodes each); boxes or names of training texts that one copy of it scans; matches
#: that are expanded at once.
SHARD_PHRASES, SCAN_UNITS, EXPANDED = 400_000, 4_000_000, 2_000_000
NEAR_CELLS = 20  # about so many phrases a box: 2 or 3 cells in each of four dimensions
CELLS, FIRST_SYMBOL, END = 60_000, 0x10000, "\n"
#: Routes: cells twice as wide, for fewer of them are near a box; steps in a cell; rows that a task forms at once.
ROUTE_CELL, STEPS, FORMED = 0.04, 256, 1_000_000
FAR = 1e6  # coordinates beyond count as this for routes

COVERED = "pid bigint, tid bigint, covered int"
OF_TEXT, OF_RECORD = "token bigint, tid bigint, at bigint", "token bigint, pid bigint, near_a bigint, near_b bigint"


def document_boxes(tree_doc: DataFrame) -> DataFrame:
    """(doc_no, n, boxes): all boxes of a document as flat array<double> cx, cy, w, h, in sorted order; its latest row counts.

    A box is read from bbox_yolo, or else from bbox_pixel with the image's width and height; a box with neither is none.
    """
    def four(a: Column) -> Column:
        return (F.size(a) == 4) & ~F.exists(a, lambda x: x.isNull() | F.isnan(x))

    def box(im: Column, a: Column) -> Column:
        y, p, w, h = a["bbox_yolo"], a["bbox_pixel"], im["width"], im["height"]
        px = F.struct(((p[0] + p[2]) / 2 / w).alias("cx"), ((p[1] + p[3]) / 2 / h).alias("cy"), ((p[2] - p[0]) / w).alias("w"), ((p[3] - p[1]) / h).alias("h"))
        yo = F.struct(y[0].alias("cx"), y[1].alias("cy"), y[2].alias("w"), y[3].alias("h"))
        return F.when(four(y), yo).when(four(p) & (w > 0) & (h > 0), px)

    per_image = F.transform(F.filter(F.map_values("images"), lambda im: im["annotations"].isNotNull()), lambda im: F.transform(im["annotations"], lambda a: box(im, a)))
    boxes = F.array_sort(F.filter(F.flatten(per_image), lambda b: b.isNotNull()))
    latest = tree_doc.where("doc_no is not null").select("doc_no", "ingested_at", boxes.alias("b")).where("size(b) > 0").groupBy("doc_no").agg(F.max(F.struct("ingested_at", "b")).alias("m"))
    return latest.select("doc_no", F.size("m.b").alias("n"), F.flatten(F.transform("m.b", lambda b: F.array(b["cx"], b["cy"], b["w"], b["h"]))).alias("boxes"))


def box_rows(classes: DataFrame) -> DataFrame:
    """(id, n, ord, v) with one row for each box of a class."""
    at = F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.slice("boxes", i * 4 + 1, 4)))
    return classes.where("n > 0").select("id", "n", at.alias("ord", "v"))


def cell_key(v: Column) -> Column:
    """A number for the cells of a box, for counting how often they occur (equal numbers of different cells do no harm)."""
    return F.xxhash64(*[F.floor(v[d] / CELL) for d in range(4)])


class Names:
    """Passages and texts that are one phrase: the words of ``key``.  So that decides on the one shard that can hold a text's phrase."""

    columns, whole = ("key",), "key"

    def phrases(self, df: pd.DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, None]:
        return [f"{END}{k}{END}" for k in df["key"]], np.arange(len(df)), np.zeros(len(df), dtype=np.int64), None

    def text(self, df: pd.DataFrame) -> tuple[str, np.ndarray, np.ndarray, None]:
        keys = df["key"].tolist()
        return END + END.join(keys) + END, np.cumsum([len(k) + 1 for k in keys]), np.arange(len(keys)), None


class Boxes:
    """Passages and texts of four symbols a box; passages only of the boxes in ``ords``, but under every cell that is near enough."""

    columns, whole = ("boxes", "ords"), None

    def __init__(self, near: float) -> None:
        self.near = near

    @staticmethod
    def _cells(v: np.ndarray) -> np.ndarray:
        return np.clip(np.floor(v / CELL) + 1000, 0, CELLS).astype(np.int64)

    @staticmethod
    def _spell(cells: np.ndarray) -> str:
        return (cells + FIRST_SYMBOL).astype("<u4").tobytes().decode("utf-32-le")

    def phrases(self, df: pd.DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        ords = [np.asarray(o, dtype=np.int64) for o in df["ords"]]
        v = np.concatenate([np.asarray(b, dtype=float).reshape(-1, 4)[o] for b, o in zip(df["boxes"], ords, strict=True)])
        owner, place = np.repeat(np.arange(len(df)), [len(o) for o in ords]), np.concatenate(ords)
        reach = self.near + 2 * EPS  # beyond what the exact test allows, so rounding loses no cell
        low, high = self._cells(v - reach), self._cells(v + reach)
        at, cells = [], []
        for step in product(range(int((high - low).max(initial=0)) + 1), repeat=4):
            c = low + np.array(step)
            ok = np.flatnonzero((c <= high).all(axis=1))
            at.append(ok)
            cells.append(c[ok])
        at, text = np.concatenate(at), self._spell(np.concatenate(cells))
        return [text[i : i + 4] for i in range(0, len(text), 4)], owner[at], place[at], v[at]

    def text(self, df: pd.DataFrame) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        boxes = [np.asarray(b, dtype=float).reshape(-1, 4) for b in df["boxes"]]
        v = np.concatenate(boxes)
        cells = np.hstack([self._cells(v), np.full((len(v), 1), ord(END) - FIRST_SYMBOL)])
        return self._spell(cells), np.arange(1, len(v) + 1) * 5 - 1, np.repeat(np.arange(len(boxes)), [len(b) for b in boxes]), v


def merged_length(key: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, length): for each key the length of the union of its intervals [start, stop)."""
    order = np.lexsort((start, key))
    key, start, stop = key[order], start[order], stop[order]
    first = np.r_[True, key[1:] != key[:-1]]
    rank = np.cumsum(first) - 1
    wide = int(stop.max(initial=0)) + 1
    reached = np.maximum.accumulate(stop + rank * wide) - rank * wide  # the furthest end so far within the key
    before = np.where(first, 0, np.r_[0, reached[:-1]])
    return key[first], np.bincount(rank, weights=np.maximum(0, stop - np.maximum(start, before)), minlength=rank[-1] + 1 if len(rank) else 0).astype(np.int64)


class _Shard:
    """The automaton of one shard's passages, and for each phrase the passages that have it."""

    def __init__(self, codec, parts: list[pd.DataFrame], least: int) -> None:
        import ahocorasick

        df = pd.concat(parts, ignore_index=True)
        phrases, owner, place, self.v = codec.phrases(df)
        codes, words = pd.factorize(np.array(phrases, dtype=object), sort=False)
        order = np.argsort(codes, kind="stable")
        self.start = np.searchsorted(codes[order], np.arange(len(words) + 1))
        self.owner, self.place, self.ids = owner[order], place[order], df["id"].to_numpy(np.int64)
        self.v = self.v[order] if self.v is not None else None
        self.codec, self.least, self.auto = codec, least, ahocorasick.Automaton()
        for i, w in enumerate(words):
            self.auto.add_word(w, i)
        self.auto.make_automaton()

    def scan(self, df: pd.DataFrame) -> Iterator[pd.DataFrame]:
        text, ends, row, v = self.codec.text(df)
        found = list(self.auto.iter(text))
        if not found:
            return
        stop, what = np.array(found, dtype=np.int64).T
        unit = np.searchsorted(ends, stop)
        n = self.start[what + 1] - self.start[what]
        # whole texts at a time, so that a pair's intervals are merged in one step
        total, lines = np.cumsum(n), row[unit]
        begin = 0
        while begin < len(n):
            base = total[begin - 1] if begin else 0
            end = int(np.searchsorted(total, base + EXPANDED, side="right"))
            end = int(np.searchsorted(lines, lines[max(begin, min(end, len(n) - 1))], side="left")) if end < len(n) else end
            if end <= begin:
                end = int(np.searchsorted(lines, lines[begin], side="right"))
            yield from self._covered(df, unit[begin:end], what[begin:end], n[begin:end], row, v)
            begin = end

    def _covered(self, df: pd.DataFrame, unit: np.ndarray, what: np.ndarray, n: np.ndarray, row: np.ndarray, v: np.ndarray | None) -> Iterator[pd.DataFrame]:
        unit = np.repeat(unit, n)
        p = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[what], n)
        if v is not None:
            ok = (np.abs(self.v[p] - v[unit]) <= self.codec.near + EPS).all(axis=1)
            unit, p = unit[ok], p[ok]
        if len(p):
            key, covered = merged_length(self.owner[p] * len(df) + row[unit], self.place[p], self.place[p] + 1)
            ok = covered >= self.least
            yield pd.DataFrame({"pid": self.ids[key[ok] // len(df)], "tid": df["id"].to_numpy(np.int64)[key[ok] % len(df)], "covered": covered[ok].astype("int32")})


def scan_texts(passages: DataFrame, texts: DataFrame, codec, phrases: int, units: int, least: int = 1, routes: DataFrame | None = None) -> DataFrame:
    """(pid, tid, covered): passages of each evaluation record found in each training text, of those with at least ``least``.

    Both frames have id and the codec's columns; ``phrases`` and ``units`` are about how many phrases the passages and how many
    boxes or names the texts have.  Memory in a task is bounded by one shard's passages; texts stream by in batches.  With
    ``routes`` (pid, tid, n: the text's units) a text is sent to the shards of its records only, and names to the one shard that
    can hold them; else to all shards.
    """
    spark = passages.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = parts_for(phrases, SHARD_PHRASES)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    key = F.col(codec.whole or "id")
    if codec.whole:
        shards, salts = max(shards, tasks, parts_for(units, SCAN_UNITS)), 1
        sent = texts.withColumn("shard", salt_of(key, shards))
    elif routes is not None:
        shards = max(shards, tasks)
        to = routes.select(F.col("tid").alias("id"), "n", salt_of(F.col("pid"), shards).alias("shard")).distinct()
        salts = parts_for(to.groupBy("shard").agg(F.sum("n").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0, SCAN_UNITS)
        sent = texts.join(to.select("id", "shard"), "id")
    else:
        salts = max(parts_for(units, SCAN_UNITS), -(-tasks // shards))
        sent = texts.withColumn("shard", every(shards))
    cols = ["id", *codec.columns]
    p = passages.select(*cols, salt_of(key, shards).alias("shard"), every(salts).alias("salt"), F.lit(0).alias("kind"))
    t = sent.select(*[F.col(c) if c in texts.columns else F.lit(None).cast(passages.schema[c].dataType).alias(c) for c in cols], salt_of(F.col("id"), salts).alias("salt"), "shard", F.lit(1).alias("kind")).select(*p.columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, waiting, ready = None, [], None
        for pdf in batches:
            for key, part in pdf.groupby(["shard", "salt", "kind"], sort=False):
                if key[:2] != at:
                    at, waiting, ready = key[:2], [], None
                if key[2] == 0:
                    waiting.append(part)
                elif waiting or ready:
                    if ready is None:
                        ready, waiting = _Shard(codec, waiting, least), []
                    yield from ready.scan(part.reset_index(drop=True))

    return p.unionByName(t).repartition(shards * salts * 2, "shard", "salt").sortWithinPartitions("shard", "salt", "kind").mapInPandas(run, COVERED)


def misses(n: int) -> int:
    """Boxes that a record of ``n`` boxes may have without a partner."""
    return n - -(-n * SHARE[0] // SHARE[1])


@cache
def gap_of(n: int) -> float:
    """A gap that enough of the neighbours in the order of cx keep to, whatever the ``n`` boxes are.

    Of n // 2 disjoint pairs of neighbours ``misses(n) + 1`` are wanted; as cx counts as between 0 and 1, at most ``spare`` of them
    are wider than 1 / (spare + 1).
    """
    return 1 / (n // 2 - misses(n))


@cache
def gap_for(n: int) -> float:
    """The widest gap_of the records that may be nearly the same as a text of ``n`` boxes."""
    fewest = max(LEAST_BOXES, n - misses(n))
    return max(gap_of(k) for k in range(fewest, max(fewest, n * SHARE[1] // SHARE[0]) + 1)) + 2 * TOLERANCE + 1e-6


def _sorted_boxes(df: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n, row, cx, steps) of all boxes of a batch, by row and cx: the boxes' rows, cx between 0 and 1, and coordinates in whole steps."""
    boxes = [np.asarray(b, dtype=float).reshape(-1, 4) for b in df["boxes"]]
    n, v = np.array([len(b) for b in boxes]), np.concatenate(boxes)
    row, real = np.repeat(np.arange(len(n)), n), np.isfinite(v).all(axis=1)
    cx = np.clip(np.nan_to_num(v[:, 0], nan=1.0), 0, 1)
    order = np.lexsort((cx, row))
    steps = np.floor(np.clip(np.nan_to_num(v, nan=0.0), -FAR, FAR) * (STEPS / ROUTE_CELL)).astype(np.int64)
    steps[~real] = np.iinfo(np.int64).min  # such a box has no partner
    return n, row, cx[order], steps[order]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _cell_hash(cells: np.ndarray) -> np.ndarray:
    h = np.zeros(len(cells), dtype=np.uint64)
    for d in range(4):
        h = _mix(h * np.uint64(0xD6E8FEB86659FD93) + cells[:, d].astype(np.uint64))
    return h


def _token(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _mix(first * np.uint64(3) + second).view(np.int64)


def _packed(small: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(len(small), dtype=np.int64)
    for d in range(small.shape[1]):
        out |= small[:, d] << (bits * d)
    return out


def text_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """OF_TEXT: every pair of a text's boxes whose cx are near enough, by the cells it lies in, with its place in these."""
    for df in batches:
        n, row, cx, steps = _sorted_boxes(df)
        gap = np.array([gap_for(int(k)) for k in n])
        until = np.searchsorted(row * 4 + cx, row * 4 + cx + gap[row], side="right")
        until = np.minimum(until, np.cumsum(n)[row])
        pairs, real = np.maximum(until - np.arange(len(row)) - 1, 0), steps[:, 0] > np.iinfo(np.int64).min
        cells = steps // STEPS
        hashed, place, ids = _cell_hash(cells), _packed(steps - cells * STEPS, 8), df["id"].to_numpy(np.int64)
        total, begin = np.cumsum(pairs), 0
        while begin < len(row):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + FORMED, side="right")))
            k = pairs[begin:end]
            a = np.repeat(np.arange(begin, end), k)
            b = a + 1 + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            ok = real[a] & real[b]
            a, b = a[ok], b[ok]
            swap = hashed[a] > hashed[b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            yield pd.DataFrame({"token": _token(hashed[a], hashed[b]), "tid": ids[row[a]], "at": place[a] | place[b] << 32})
            begin = end


def record_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """OF_RECORD: a record's cheapest pairs of neighbours, one more than it may miss boxes, under all cells where partners may lie.

    One of these disjoint pairs has partners for both boxes.  ``often`` says how often the cells of the boxes occur.
    """
    reach = int(np.ceil((TOLERANCE + 2 * EPS) * STEPS / ROUTE_CELL))
    for df in batches:
        n, row, cx, steps = _sorted_boxes(df)
        often = np.concatenate([np.asarray(o, dtype=float) for o in df["often"]])
        start = np.cumsum(n) - n
        a = np.concatenate([s + np.arange(0, k - 1, 2) for s, k in zip(start, n, strict=True)])
        real = steps[:, 0] > np.iinfo(np.int64).min
        low, high = (steps - reach) // STEPS, (steps + reach) // STEPS
        kinds = (high - low + 1).prod(axis=1)
        gap = np.array([gap_of(int(k)) for k in n])
        a = a[real[a] & real[a + 1] & (cx[a + 1] - cx[a] <= gap[row[a]] + 1e-9)]
        cost = kinds[a] * kinds[a + 1] * (1 + often[a]) * (1 + often[a + 1])
        a = a[np.lexsort((cost, row[a]))]
        rank = np.arange(len(a)) - np.searchsorted(row[a], row[a])
        a = a[rank <= np.array([misses(int(k)) for k in n])[row[a]]]
        ids = df["id"].to_numpy(np.int64)
        for begin in range(0, len(a), FORMED // 64):
            yield from _under_all_cells(a[begin : begin + FORMED // 64], row, ids, steps, low, high, kinds)


def _under_all_cells(a: np.ndarray, row: np.ndarray, ids: np.ndarray, steps: np.ndarray, low: np.ndarray, high: np.ndarray, kinds: np.ndarray) -> Iterator[pd.DataFrame]:
    many = kinds[a] * kinds[a + 1]
    pair = np.repeat(np.arange(len(a)), many)
    k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)

    def kind_of(box: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cells = low[box].copy()
        for d in range(4):
            wide = high[box, d] - low[box, d] + 1
            cells[:, d] += k % wide
            k = k // wide
        return _cell_hash(cells), _packed(steps[box] - cells * STEPS + STEPS, 16)

    first, second = a[pair], a[pair] + 1
    (ha, na), (hb, nb) = kind_of(first, k % kinds[first]), kind_of(second, k // kinds[first])
    for ok, h1, h2, n1, n2 in ((ha <= hb, ha, hb, na, nb), (ha >= hb, hb, ha, nb, na)):
        yield pd.DataFrame({"token": _token(h1[ok], h2[ok]), "pid": ids[row[first[ok]]], "near_a": n1[ok], "near_b": n2[ok]})


def find_routes(records: DataFrame, texts: DataFrame) -> DataFrame:
    """(pid, tid): evaluation records (id, boxes, often) and texts (id, boxes) that share one of the record's pairs of boxes.

    A true pair has partners for all but ``misses`` boxes of the record, so for both boxes of one of ``misses + 1`` disjoint pairs.
    Pairs meet by the cells they lie in, and are near by their places in the cells, in whole steps (a step more than the tolerance).
    """
    reach = int(np.ceil((TOLERANCE + 2 * EPS) * STEPS / ROUTE_CELL))
    met = texts.select("id", "boxes").mapInPandas(text_pairs, OF_TEXT).join(records.select("id", "boxes", "often").mapInPandas(record_pairs, OF_RECORD), "token")
    bits = lambda c, at, mask: F.shiftrightunsigned(c, at).bitwiseAND(F.lit(mask).cast("bigint"))
    for k in range(8):
        met = met.where(F.abs(bits("at", 8 * k, STEPS - 1) + STEPS - bits("near_a" if k < 4 else "near_b", 16 * (k % 4), 0xFFFF)) <= reach)
    return met.select("pid", "tid").distinct()


def pair_count(a: np.ndarray, b: np.ndarray, near: float = TOLERANCE) -> int:
    """Size of the largest one-to-one pairing of boxes that differ by at most ``near`` in every coordinate."""
    close = [np.flatnonzero((np.abs(b - x) <= near + EPS).all(axis=1)) for x in a]
    owner = np.full(len(b), -1)

    def settle(i: int) -> bool:
        seen, stack, came = set(), [i], {}
        while stack:
            k = stack.pop()
            for j in close[k]:
                if j in seen:
                    continue
                seen.add(j)
                came[j] = k
                if owner[j] < 0:
                    while True:
                        k = came[j]
                        before = np.flatnonzero(owner == k)
                        owner[j] = k
                        if k == i:
                            return True
                        j = before[0]
                stack.append(owner[j])
        return False

    return sum(settle(i) for i in range(len(a)))


def near_pairs(eval_classes: DataFrame, train_classes: DataFrame, ws: Workspace) -> DataFrame:
    """(pid, tid) of classes (id, n, boxes) that are nearly the same, each side with at least ``LEAST_BOXES`` boxes."""
    up, of = SHARE
    need = lambda n: F.ceil(n * up / F.lit(float(of)) - 1e-9)
    e, t = eval_classes.where(f"n >= {LEAST_BOXES}"), train_classes.where(f"n >= {LEAST_BOXES}")
    often = box_rows(t).groupBy(cell_key(F.col("v")).alias("cell")).agg(F.count(F.lit(1)).alias("often"))
    rare = Window.partitionBy("id").orderBy("often", "ord")
    own = box_rows(e).select("id", "n", "ord", cell_key(F.col("v")).alias("cell")).join(often, "cell", "left").withColumn("often", F.coalesce("often", F.lit(0))).withColumn("rank", F.row_number().over(rare))
    searched = F.when(F.col("rank") <= F.col("n") - need(F.col("n")) + SPARE, F.col("ord"))
    own = own.groupBy("id").agg(F.collect_list(searched).alias("ords"), F.array_sort(F.collect_list(F.struct("ord", "often")))["often"].alias("often"))  # a record's boxes
    records = ws.save(e.join(own, "id"), "records")
    routes = ws.save(find_routes(records, t).join(t.select(F.col("id").alias("tid"), "n"), "tid"), "routes")
    passages = records.join(routes.select(F.col("pid").alias("id")).distinct(), "id", "left_semi")
    size = passages.agg(F.sum(F.size("ords")).alias("n")).first()["n"] or 0
    covered = scan_texts(passages, t, Boxes(TOLERANCE), size * NEAR_CELLS, 0, min(SPARE, LEAST_BOXES - 1), routes)
    a, b = e.select(F.col("id").alias("pid"), F.col("n").alias("pn"), F.col("boxes").alias("pb")), t.select(F.col("id").alias("tid"), F.col("n").alias("tn"), F.col("boxes").alias("tb"))
    sized = covered.join(a.select("pid", "pn"), "pid").join(b.select("tid", "tn"), "tid")
    larger = F.greatest("pn", "tn")
    searched = F.least(F.col("pn"), F.col("pn") - need(F.col("pn")) + SPARE)
    cand = ws.save(sized.where((F.least("pn", "tn") >= need(larger)) & (F.col("covered") >= searched - (F.col("pn") - need(larger)))).select("pid", "tid"), "candidates")

    @F.pandas_udf("int")
    def paired(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([pair_count(np.asarray(p, float).reshape(-1, 4), np.asarray(q, float).reshape(-1, 4)) for p, q in zip(x, y, strict=True)], dtype="int32")

    checked = cand.join(a, "pid").join(b, "tid").withColumn("paired", paired("pb", "tb"))
    return checked.where(F.col("paired") * of >= larger * up).select("pid", "tid")


def named_pairs(rows: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): (pid, tid) of the evaluation and training classes that name one tree, and (row_id, s, name) of all rows with a name."""
    words = rows.where("tree is not null").select("row_id", "s", F.translate("tree", "|", " ").alias("key"), (F.col("s") == "train").alias("t"))
    classes = ws.save(words.groupBy("t", "key").agg(F.min("row_id").alias("id")), "names")
    ev, tr = classes.where("not t"), classes.where("t")
    counts = {r["t"]: r["n"] for r in classes.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    pairs = scan_texts(ev, tr, Names(), counts.get(False, 0), counts.get(True, 0)).select("pid", "tid")
    return ws.save(pairs, "named"), words.join(classes, ["t", "key"]).select("row_id", "s", F.col("id").alias("name"))


def overlap_classes(manifest: DataFrame, tree_doc: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, by_name, by_boxes): rows (row_id, s, source, name, id) with their classes of names and of boxes, and the classes' pairs (pid, tid).

    Rows whose new_split names no split, rows with null row_id and, for the boxes, rows without document are in no pair of
    that kind.  Rows listed again are rows of their own.
    """
    rows = ws.save(manifest.where("row_id is not null").select("row_id", "doc_no", "source", split_name(F.col("new_split")).alias("s"), tree_key(F.col("tree_id")).alias("tree")).where("s is not null"), "rows")
    by_name, named = named_pairs(rows, ws)
    docs = ws.save(document_boxes(tree_doc).withColumn("sig", F.sha2(F.col("boxes").cast("string"), 256)), "docs")
    classes = ws.save(docs.groupBy("sig").agg(F.min(F.struct("doc_no", "n", "boxes")).alias("m")).select("sig", F.col("m.doc_no").alias("id"), "m.n", "m.boxes"), "classes")
    member = ws.save(docs.select("doc_no", "sig").join(classes.select("sig", "id"), "sig").select("doc_no", "id"), "member")
    ws.drop("docs")
    whole = ws.save(rows.join(named.select("row_id", "name").dropDuplicates(["row_id"]), "row_id", "left").join(member, "doc_no", "left").select("row_id", "s", "source", "name", "id"), "held")
    on = whole.where("id is not null").groupBy("id").agg(F.max(F.col("s") != "train").alias("ev"), F.max(F.col("s") == "train").alias("tr"))
    sides = ws.save(classes.join(on, "id").select("id", "n", "boxes", "ev", "tr"), "sides")
    ws.drop("classes", "member")
    return whole, by_name, ws.save(near_pairs(sides.where("ev").drop("ev", "tr"), sides.where("tr").drop("ev", "tr"), ws), "near")


def cross_split_pairs(manifest: DataFrame, tree_doc: DataFrame, ws: Workspace) -> DataFrame:
    """(eval_row, train_row, reason) for all cross-split overlaps; a pair may come for both reasons.  Empty tables give an empty result."""
    rows, by_name, by_boxes = overlap_classes(manifest, tree_doc, ws)

    def expand(pairs: DataFrame, c: str, reason: str) -> DataFrame:
        ev, tr = rows.where("s <> 'train'").select(F.col(c).alias("pid"), F.col("row_id").alias("eval_row")), rows.where("s = 'train'").select(F.col(c).alias("tid"), F.col("row_id").alias("train_row"))
        return pairs.join(ev, "pid").join(tr, "tid").select("eval_row", "train_row", F.lit(reason).alias("reason"))

    return expand(by_name, "name", "tree").union(expand(by_boxes, "id", "boxes"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cross_split_pairs(read(spark, sf_dir, "split_manifest"), read(spark, sf_dir, "tree_doc"), Workspace(spark, "p2"))
    return pairs.select(F.least("eval_row", "train_row").alias("row_lo"), F.greatest("eval_row", "train_row").alias("row_hi")).distinct()


def overlap_report(rows: DataFrame, by_name: DataFrame, by_boxes: DataFrame) -> DataFrame:
    """For each evaluation split and source: its rows, those that overlap with training rows, by reason, and the pairs.

    Pairs are counted by the sizes of the classes, without forming them: by name, plus by boxes, less those that are both.
    """
    tr = rows.where("s = 'train'")
    cells = rows.where("s <> 'train'").groupBy(F.col("s").alias("new_split"), "source", "name", "id").agg(F.count(F.lit(1)).alias("n"))
    size = lambda c, k: tr.where(f"{c} is not null").groupBy(F.col(c).alias(k)).agg(F.count(F.lit(1)).alias("k"))
    per = lambda pairs, c, out: pairs.join(size(c, "tid"), "tid").groupBy(F.col("pid").alias(c)).agg(F.sum("k").alias(out))
    both_sizes = tr.where("name is not null and id is not null").groupBy(F.col("name").alias("tn"), F.col("id").alias("tb")).agg(F.count(F.lit(1)).alias("k"))
    both = cells.select("name", "id").where("name is not null and id is not null").distinct()
    both = both.join(by_name.select(F.col("pid").alias("name"), F.col("tid").alias("tn")), "name").join(both_sizes, "tn").join(by_boxes.select(F.col("pid").alias("id"), F.col("tid").alias("tb")), ["id", "tb"])
    both = both.groupBy("name", "id").agg(F.sum("k").alias("b"))
    out = cells.join(per(by_name, "name", "t"), "name", "left").join(per(by_boxes, "id", "x"), "id", "left").join(both, ["name", "id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("bigint")
    return out.groupBy("new_split", "source").agg(F.sum("n").alias("n_rows"), total(F.col("t").isNotNull() | F.col("x").isNotNull()).alias("overlapping_rows"), total(F.col("t").isNotNull()).alias("by_tree"),
                                                  total(F.col("x").isNotNull()).alias("by_boxes"), F.sum(F.col("n") * (zero("t") + zero("x") - zero("b"))).cast("bigint").alias("n_pairs"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_report(*overlap_classes(read(spark, sf_dir, "split_manifest"), read(spark, sf_dir, "tree_doc"), Workspace(spark, "p2")))
