"""Files whose schemas drift: every change from file to file, and one consistent table.

Lines are cells by the delimiter and quoting of their file's header, all in built-in expressions; a file is never gathered.
For each file and its predecessor in the run the schema graphs (columns, types, name parts, name groups, neighbours, and what
range the values of shared epochs have) are matched by similarity flooding: start similarities flow along equally labelled
edges of the pairwise graph until they settle.  The settled scores alone select the correspondences, one-to-one, best
first, above ``LEAST_SCORE``; an exact test of the selected columns' values on shared epochs confirms or drops each.

Defined cases: null and blank lines, comments (``#``), repeated headers and lines are no data; a column that is blank or nan
throughout has no type and is neither renamed nor retyped; files without header line yield nothing; an empty table yields an
empty result.  Names are compared without byte order mark, quotes and blanks around; letter case counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INTEGER, NUMBER = r"^[+-]?[0-9]+$", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
DELIMITERS = [",", ";", "\t", "|"]


def clean(c: Column) -> Column:
    """A cell or name without byte order mark, quotes and blanks around it."""
    edge = r"^[\s\x{FEFF}\x{00A0}\"']+|[\s\x{FEFF}\x{00A0}\"']+$"
    return F.regexp_replace(c, edge, "")


def split_cells(line: Column, delimiter: str) -> Column:
    """Cells of a delimited line; a delimiter inside double quotes belongs to its cell."""
    d = re.escape(delimiter)
    cell = rf'(\s*"(?:[^"]|"")*"[^{d}]*|[^{d}]*)(?:{d}|$)'
    found = F.regexp_extract_all(line, F.lit(cell), F.lit(1))
    # after a line's last cell the pattern matches once more, on nothing, unless the line ends with the delimiter's match
    return F.transform(F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(1))), clean)


def by_delimiter(line: Column, delimiter: Column) -> Column:
    out = F.when(F.lit(False), F.array(F.lit("")))
    for d in DELIMITERS:
        out = out.when(delimiter == d, split_cells(line, d))
    return out


def headers(lines: DataFrame) -> DataFrame:
    """(run_name, file_id, written_at, delimiter, cols, epoch_at) of each file, from its line 1.

    The delimiter is the one that gives the header most cells (the first of them on a tie); epoch_at is the 0-based place of
    the epoch column: a column named ``epoch`` in any case, or else the first.
    """
    head = lines.where((F.col("line_no") == 1) & F.col("line").isNotNull()).groupBy("run_name", "file_id").agg(F.min(F.struct("written_at", "line")).alias("m"))
    line = F.col("m.line")
    counts = [F.struct(F.size(split_cells(line, d)).alias("n"), F.lit(-i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)]
    out = head.select("run_name", "file_id", F.col("m.written_at").alias("written_at"), line.alias("line"), F.greatest(*counts)["d"].alias("delimiter"))
    out = out.withColumn("cols", by_delimiter(F.col("line"), F.col("delimiter"))).drop("line")
    at = F.array_position(F.transform("cols", lambda c: F.lower(c)), "epoch")
    return out.withColumn("epoch_at", F.when(at > 0, at - 1).otherwise(F.lit(0)).cast("int"))


def data_rows(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """(run_name, file_id, line_no, epoch, cols, cells) of the lines that hold data."""
    body = lines.where("line_no > 1 and line is not null").where(~F.col("line").rlike(r"^[\s\x{FEFF}]*(#.*)?$"))
    rows = body.select("file_id", "line_no", "line").join(heads.select("run_name", "file_id", "delimiter", "cols", "epoch_at"), "file_id")
    rows = rows.withColumn("cells", by_delimiter(F.col("line"), F.col("delimiter")))
    mark = F.get("cells", F.col("epoch_at"))
    epoch = F.regexp_extract(mark, r"^([0-9]{1,18})", 1)
    header = (mark != "") & (epoch == "")
    return rows.where(mark.isNotNull() & ~header).select("run_name", "file_id", "line_no", F.expr("try_cast(nullif(regexp_extract(get(cells, epoch_at), '^([0-9]{1,18})', 1), '') AS bigint)").alias("epoch"), "cols", "cells")


def long_cells(rows: DataFrame) -> DataFrame:
    """(file_id, epoch, col, value) of the cells that say something: neither blank nor nan."""
    n = F.least(F.size("cols"), F.size("cells"))
    pairs = F.arrays_zip(F.slice("cols", F.lit(1), n).alias("col"), F.slice("cells", F.lit(1), n).alias("value"))
    out = rows.select("run_name", "file_id", "line_no", "epoch", F.explode(pairs).alias("p")).select("run_name", "file_id", "line_no", "epoch", F.col("p.col").alias("col"), F.col("p.value").alias("value"))
    return out.where("value <> '' and lower(value) <> 'nan'")


def as_number(c: Column) -> Column:
    """A number in any of the formats seen: point or comma decimals, exponent, per cent, h:mm:ss as seconds, ``n/m`` as n."""
    plain = F.when(c.rlike(NUMBER), c.try_cast("double"))
    comma = F.when(c.rlike(r"^[+-]?[0-9]+,[0-9]+([eE][+-]?[0-9]+)?$"), F.regexp_replace(c, ",", ".").try_cast("double"))
    cent = F.when(c.rlike(r"^[+-]?[0-9]+([.,][0-9]+)?\s*%$"), F.round(F.regexp_replace(F.regexp_replace(c, r"\s*%$", ""), ",", ".").try_cast("double") / 100, 12))
    clock = F.when(c.rlike(r"^[0-9]+:[0-5][0-9]:[0-5][0-9]$"), F.split(c, ":")[0].cast("double") * 3600 + F.split(c, ":")[1].cast("double") * 60 + F.split(c, ":")[2].cast("double"))
    part = F.when(c.rlike(r"^[0-9]+/[0-9]+$"), F.split(c, "/")[0].cast("double"))
    return F.coalesce(plain, comma, cent, clock, part)


def column_types(cells: DataFrame) -> DataFrame:
    """(file_id, col, type): integer, number or text."""
    flags = cells.groupBy("file_id", "col").agg(F.min(F.col("value").rlike(INTEGER).cast("int")).alias("i"), F.min(F.col("value").rlike(NUMBER).cast("int")).alias("n"))
    return flags.select("file_id", "col", F.when(F.col("i") == 1, "integer").when(F.col("n") == 1, "number").otherwise("text").alias("type"))


# ---------------------------------------------------------------- similarity flooding

#: Settled scores below this (the best pair of the graph has 1) are no correspondence.
LEAST_SCORE = 0.005
#: Columns move about, so what a pair's neighbours say counts less than its own name, type and values.
NEXT_WEIGHT = 0.25


@lru_cache(maxsize=1 << 16)
def _parts(name: str) -> frozenset[str]:
    return frozenset(p for p in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower()) if p)


@lru_cache(maxsize=1 << 16)
def _alike(a: str, b: str) -> float:
    """Start similarity of two names: shared parts and shared letter pairs."""
    if a == b:
        return 1.0
    x, y = _parts(a), _parts(b)
    ga, gb = ({s[i : i + 2] for i in range(len(s) - 1)} for s in (a.lower(), b.lower()))
    dice = lambda p, q: 2 * len(p & q) / (len(p) + len(q)) if p or q else 0.0
    return 0.5 * dice(x, y) + 0.5 * dice(ga, gb) + 0.01


Profile = tuple[float, ...]  # mean, least, largest, first and last value on the epochs that both files hold


def _same_range(a: Profile | None, b: Profile | None) -> float:
    """1 for equal ranges, falling fast with their mean relative distance; 0 where a column has no values to compare."""
    if a is None or b is None:
        return 0.0
    d = sum(abs(x - y) / (abs(x) + abs(y)) if x != y else 0.0 for x, y in zip(a, b, strict=True)) / len(a)
    return 1 / (1 + (d / 0.001) ** 2)


class SchemaGraph:
    """Columns in order, and what each is tied to: the file, its type, name parts and group, the next column, its values.

    ``links`` are incidence matrices, a row a column; ``names`` the nodes' names, by kind.
    """

    def __init__(self, cols: list[tuple[str, str | None]]) -> None:
        names = [c for c, _ in cols]
        groups = [re.split(r"[/._]", c, maxsplit=1) for c in names]
        tied = {"type": [[str(t)] for _, t in cols], "part": [sorted(_parts(c)) for c in names], "group": [[g[0].lower()] if len(g) == 2 and g[0] else [] for g in groups], "file": [[""]] * len(cols)}
        self.names = {"column": names}
        self.links: dict[str, np.ndarray] = {}
        for kind, of in tied.items():
            self.names[kind] = list(dict.fromkeys(x for xs in of for x in xs))
            at = {x: i for i, x in enumerate(self.names[kind])}
            m = np.zeros((len(cols), len(at)))
            for i, xs in enumerate(of):
                m[i, [at[x] for x in xs]] = 1
            self.links[kind] = m
        self.links["next"] = np.eye(len(cols), k=1)


def flood(old: list[tuple[str, str | None]], new: list[tuple[str, str | None]], old_profiles: dict[str, Profile] | None = None, new_profiles: dict[str, Profile] | None = None,
          tolerance: float = 1e-4, most: int = 200) -> dict[tuple[str, str], float]:
    """Settled similarity of every pair of columns (old name, new name) of two schemas.

    What a pair of nodes sends along a label is divided among all pairs it reaches by that label, forth and back; every round
    starts from the start similarities plus what has settled so far, scaled so that the best pair has 1.
    """
    a, b = SchemaGraph(old), SchemaGraph(new)
    start = {k: np.array([[_alike(x, y) for y in b.names[k]] for x in a.names[k]]).reshape(len(a.names[k]), len(b.names[k])) for k in a.names}
    pa, pb = old_profiles or {}, new_profiles or {}
    start["values"] = np.array([[1.0 if o == n else _same_range(pa.get(o), pb.get(n)) for n, _ in new] for o, _ in old]).reshape(len(old), len(new))
    flows = {}
    for k in a.links:
        ma, mb = a.links[k], b.links[k]
        flows[k] = (ma / np.maximum(ma.sum(1, keepdims=True), 1), mb / np.maximum(mb.sum(1, keepdims=True), 1), ma / np.maximum(ma.sum(0, keepdims=True), 1), mb / np.maximum(mb.sum(0, keepdims=True), 1))
    now = {k: v.copy() for k, v in start.items()}
    for _ in range(most):
        send = {k: start[k] + now[k] for k in now}
        nxt = {k: v.copy() for k, v in send.items()}
        for k, (fa, fb, ga, gb) in flows.items():
            to, weight = ("column", NEXT_WEIGHT) if k == "next" else (k, 1.0)
            nxt[to] += weight * (fa.T @ send["column"] @ fb)
            nxt["column"] += weight * (ga @ send[to] @ gb.T)
        nxt["values"] += send["column"]
        nxt["column"] += send["values"]
        best = max(v.max(initial=0.0) for v in nxt.values()) or 1.0
        nxt = {k: v / best for k, v in nxt.items()}
        moved = max(np.abs(nxt[k] - now[k]).max(initial=0.0) for k in now)
        now = nxt
        if moved < tolerance:
            break
    return {(o, n): float(now["column"][i, j]) for i, (o, _) in enumerate(old) for j, (n, _) in enumerate(new)}


def one_to_one(scored: list[tuple[float, str, str]], least: float = LEAST_SCORE) -> list[tuple[str, str]]:
    """Best pairs first, each name once, of those that score at least ``least``; equal scores in order of the names."""
    used_o, used_n, out = set(), set(), []
    for v, o, n in sorted(scored, key=lambda r: (-r[0], r[1], r[2])):
        if v >= least and o not in used_o and n not in used_n:
            used_o.add(o)
            used_n.add(n)
            out.append((o, n))
    return out


# ---------------------------------------------------------------- changes

def file_pairs(heads: DataFrame) -> DataFrame:
    """(run_name, prev_id, file_id, prev_cols, cols) of each file that has a predecessor in its run."""
    w = Window.partitionBy("run_name").orderBy("written_at", "file_id")
    out = heads.withColumn("prev_id", F.lag("file_id").over(w)).withColumn("prev_cols", F.lag("cols").over(w))
    return out.where("prev_id is not null").select("run_name", "prev_id", "file_id", "prev_cols", "cols")


def open_columns(pairs: DataFrame) -> DataFrame:
    """(prev_id, file_id, old, src, other, col): columns only in one of the two files, where both have such columns.

    ``src`` is the file that has the column, ``other`` the one that hasn't; ``old`` tells whether it is the preceding one.
    """
    gone, come = F.array_except("prev_cols", "cols"), F.array_except("cols", "prev_cols")
    both = pairs.where((F.size(gone) > 0) & (F.size(come) > 0))
    row = lambda c, old, src, other: both.select("prev_id", "file_id", F.lit(old).alias("old"), F.col(src).alias("src"), F.col(other).alias("other"), F.explode(F.array_distinct(c)).alias("col"))
    return row(gone, True, "prev_id", "file_id").union(row(come, False, "file_id", "prev_id"))


def shared_values(columns: DataFrame, cells: DataFrame) -> DataFrame:
    """(prev_id, file_id, old, col, epoch, v): the open columns' values on the epochs that both files hold, numbers in one format."""
    known = cells.where("epoch is not null")
    held = known.select(F.col("file_id").alias("other"), "epoch").distinct()
    mine = known.select(F.col("file_id").alias("src"), "col", "epoch", "value").join(columns, ["src", "col"]).join(held, ["other", "epoch"])
    return mine.select("prev_id", "file_id", "old", "col", "epoch", F.coalesce(as_number(F.col("value")).cast("string"), F.col("value")).alias("v"))


def correspondences(pairs: DataFrame, types: DataFrame, shared: DataFrame, score=flood, least: float = LEAST_SCORE) -> DataFrame:
    """(prev_id, file_id, old_name, new_name): one-to-one between columns only in one of two files, selected by flooding scores."""
    kinds = types.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("col", "type"))).alias("kinds"))  # a file's columns
    # texts count as numbers of their own, so that equal texts have equal ranges
    x = F.coalesce(F.col("v").try_cast("double"), F.pmod(F.xxhash64("v"), F.lit(1_000_003)).cast("double"))
    per = shared.groupBy("prev_id", "file_id", "old", "col").agg(F.array(F.avg(x), F.min(x), F.max(x), F.min_by(x, "epoch"), F.max_by(x, "epoch")).alias("p"))
    ranges = per.groupBy("prev_id", "file_id").agg(*[F.collect_list(F.when(F.col("old") == old, F.struct("col", "p"))).alias(name) for old, name in ((True, "old_ranges"), (False, "new_ranges"))])  # a pair's columns
    cols = pairs.join(ranges, ["prev_id", "file_id"]).join(kinds, "file_id", "left").join(kinds.select(F.col("file_id").alias("prev_id"), F.col("kinds").alias("prev_kinds")), "prev_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                old, new = list(dict.fromkeys(r.prev_cols)), list(dict.fromkeys(r.cols))
                ko, kn = dict(r.prev_kinds or {}), dict(r.kinds or {})
                po, pn = ({c["col"]: tuple(c["p"]) for c in cs} for cs in (r.old_ranges, r.new_ranges))
                settled = score([(c, ko.get(c)) for c in old], [(c, kn.get(c)) for c in new], po, pn)
                kept_o, kept_n = set(new), set(old)
                rows += [(r.prev_id, r.file_id, o, n) for o, n in one_to_one([(settled[o, n], o, n) for o in old if o not in kept_o for n in new if n not in kept_n], least)]
            yield pd.DataFrame(rows, columns=["prev_id", "file_id", "old_name", "new_name"])

    few = cols.select("prev_id", "file_id", "prev_cols", "cols", "prev_kinds", "kinds", "old_ranges", "new_ranges")
    return few.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file_id").mapInPandas(run, "prev_id bigint, file_id bigint, old_name string, new_name string")


def renames(selected: DataFrame, shared: DataFrame) -> DataFrame:
    """The selected correspondences whose columns hold the same values on the epochs that both files hold, at least on one."""
    side = lambda old, name, v: shared.where(F.col("old") == old).select("prev_id", "file_id", "epoch", F.col("col").alias(name), F.col("v").alias(v))
    met = selected.join(side(True, "old_name", "ov"), ["prev_id", "file_id", "old_name"]).join(side(False, "new_name", "nv"), ["prev_id", "file_id", "new_name", "epoch"])
    return met.groupBy("prev_id", "file_id", "old_name", "new_name").agg(F.bool_and(F.col("ov") == F.col("nv")).alias("same")).where("same").drop("same")


def schema_changes(pairs: DataFrame, types: DataFrame, renamed: DataFrame) -> DataFrame:
    """(file_id, change, old_name, new_name): renamed, added, removed and retyped columns of each file against its predecessor."""
    gone = pairs.select("file_id", F.explode(F.array_distinct(F.array_except("prev_cols", "cols"))).alias("name"))
    come = pairs.select("file_id", F.explode(F.array_distinct(F.array_except("cols", "prev_cols"))).alias("name"))
    removed = gone.join(renamed.select("file_id", F.col("old_name").alias("name")), ["file_id", "name"], "left_anti")
    added = come.join(renamed.select("file_id", F.col("new_name").alias("name")), ["file_id", "name"], "left_anti")
    stay = pairs.select("prev_id", "file_id", F.explode(F.array_intersect("prev_cols", "cols")).alias("col"))
    was = types.select(F.col("file_id").alias("prev_id"), "col", F.col("type").alias("old_type"))
    retyped = stay.join(types, ["file_id", "col"]).join(was, ["prev_id", "col"]).where("type <> old_type")
    row = lambda df, change, old, new: df.select("file_id", F.lit(change).alias("change"), old.alias("old_name"), new.alias("new_name"))
    none = F.lit("")
    return row(renamed, "renamed", F.col("old_name"), F.col("new_name")).union(row(added, "added", none, F.col("name"))).union(
        row(removed, "removed", F.col("name"), none)).union(row(retyped, "retyped", F.col("col"), F.col("col")))


# ---------------------------------------------------------------- one consistent table

def canonical_names(renamed: DataFrame, heads: DataFrame, targets: list[str]) -> DataFrame:
    """(run_name, col, name): the one name of every column that was renamed within its run.

    Names tied by renames of a run, directly or through others, get the one of them that ``targets`` has (the first in order of
    the names, if several), or else the smallest.  Grouped are the different names of a run, not its files or rows.
    """
    pairs = renamed.join(heads.select("run_name", "file_id"), "file_id").select("run_name", "old_name", "new_name").distinct()
    wanted = set(targets)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                parent: dict[str, str] = {}

                def find(x: str, parent: dict[str, str] = parent) -> str:
                    while parent.setdefault(x, x) != x:
                        x = parent[x]
                    return x

                for p in r.pairs:
                    a, b = find(p["old_name"]), find(p["new_name"])
                    parent[a] = b
                groups: dict[str, list[str]] = {}
                for x in list(parent):
                    groups.setdefault(find(x), []).append(x)
                for names in groups.values():
                    best = min(names, key=lambda n: (n not in wanted, n))
                    rows += [(r.run_name, n, best) for n in names]
            yield pd.DataFrame(rows, columns=["run_name", "col", "name"])

    grouped = pairs.groupBy("run_name").agg(F.collect_list(F.struct("old_name", "new_name")).alias("pairs"))
    return grouped.mapInPandas(run, "run_name string, col string, name string")


def epoch_table(cells: DataFrame, heads: DataFrame, names: DataFrame, typed: list[DataFrame]) -> DataFrame:
    """One row for each (run_name, epoch) of the files and of the typed exports, with the exports' columns as doubles.

    Of several values for an epoch the latest file's counts (the largest of equally late ones); numbers are read in every format
    seen; other columns of a run, and cells that are no number, are kept as text in the map ``extras``.
    """
    targets = list(dict.fromkeys(c for t in typed for c in t.columns if c not in ("run_name", "epoch")))
    named = cells.where("epoch is not null").join(names, ["run_name", "col"], "left").withColumn("name", F.coalesce("name", "col"))
    timed = named.join(heads.select("file_id", "written_at"), "file_id").where(~(F.lower("name") == "epoch"))
    last = timed.groupBy("run_name", "epoch", "name").agg(F.max(F.struct("written_at", "file_id", "line_no", "value"))["value"].alias("value"))
    rows = last.groupBy("run_name", "epoch").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("m"))  # a row's columns
    value = lambda t: as_number(F.col("m")[t])
    files = rows.select("run_name", "epoch", F.lit("file").alias("origin"), *[value(t).alias(t) for t in targets],
                        F.map_filter("m", lambda k, v: ~k.isin(targets) | as_number(v).isNull()).alias("extras"))
    out = files
    for i, t in enumerate(typed):
        text = lambda c: F.btrim(F.col(f"`{c}`").cast("string"))
        have = [c for c in t.columns if c not in ("run_name", "epoch")]
        num = t.select("run_name", F.regexp_extract(text("epoch"), r"^([0-9]+)", 1).try_cast("bigint").alias("epoch"), *[(as_number(text(c)) if c in have else F.lit(None).cast("double")).alias(c) for c in targets])
        one = num.where("epoch is not null").groupBy("run_name", "epoch").agg(*[F.max(F.col(f"`{c}`")).alias(c) for c in targets])
        out = out.union(one.select("run_name", "epoch", F.lit(f"export_{i + 1}").alias("origin"), *[F.col(f"`{c}`") for c in targets], F.create_map().cast("map<string,string>").alias("extras")))
    return out
