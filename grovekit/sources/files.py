"""Scans of the file formats of detection corpora (SRC-01..12), all with explicit schemas.

Formats that Spark reads itself (CSV, text, JSON) stay in the JVM; binary formats are decoded from ``binaryFile`` rows
(path, content) in Arrow batches, one file at a time, and should be kept as Parquet afterwards.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.functions.names import split_name
from grovekit.scale import removed_at_end, shared_dir, tidy

MANIFEST = "tree_id string, variety string, new_split string, B1 int, B2 int, B3 int, B4 int"


def manifest_csv(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """A split manifest: byte order mark and blanks removed, new_split read by its meaning (null if it names none)."""
    df = spark.read.csv(path, header=True, schema=schema, enforceSchema=True, mode="PERMISSIVE")
    return df.withColumn("tree_id", tidy(F.col("tree_id"))).withColumn("new_split", split_name(F.col("new_split")))


def manifest_counts(manifest: DataFrame, classes: Sequence[str] = ("B1", "B2", "B3", "B4")) -> DataFrame:
    """(tree_id, new_split, cls, n): the class columns as rows; rows without split are left out."""
    kept = manifest.where("new_split is not null")
    return kept.unpivot(["tree_id", "new_split"], list(classes), "cls", "n")


def tree_json(spark: SparkSession, path: str) -> DataFrame:
    """(file, body) of JSON documents, one a file, without byte order mark."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"^\x{FEFF}", "").alias("body"))


def folder_split(file: Column) -> Column:
    """The split that a file's folder names, ``valid`` being val."""
    return split_name(F.regexp_extract(file, r"/([^/]+)/[^/]*$", 1))


def yolo_labels(spark: SparkSession, path: str) -> DataFrame:
    """(stem, line_no, cls, cx, cy, w, h) of label files ``cls cx cy w h``; short lines and negative classes are left out."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(stem_of(F.col("_metadata.file_path")).alias("stem"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    return yolo_lines(raw)


def yolo_lines(lines: DataFrame) -> DataFrame:
    part = F.split(F.trim(F.col("line")), r"\s+")
    out = lines.withColumn("_p", part).where(F.size("_p") >= 5)
    num = lambda i: F.get("_p", F.lit(i)).try_cast("double")
    out = out.select("stem", "line_no", num(0).cast("int").alias("cls"), num(1).alias("cx"), num(2).alias("cy"), num(3).alias("w"), num(4).alias("h"))
    return out.where("cls >= 0 and cx is not null and cy is not null and w is not null and h is not null")


def stem_of(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def tree_and_side(stem: Column) -> tuple[Column, Column]:
    """``{tree}_{side}``: what precedes the last underscore, and the number behind it (null if there is none)."""
    form = r"^(.*)_([0-9]+)$"
    return F.when(stem.rlike(form), F.regexp_extract(stem, form, 1)).otherwise(stem), F.when(stem.rlike(form), F.regexp_extract(stem, form, 2).cast("int"))


def corpus_and_rest(key: Column) -> tuple[Column, Column]:
    """``PREFIX_rest``."""
    return F.regexp_extract(key, r"^([^_]*)_?(.*)$", 1), F.regexp_extract(key, r"^([^_]*)_?(.*)$", 2)


DETECTIONS = "stem string, row_index int, x1 double, y1 double, x2 double, y2 double, score double, cls int, p array<double>, anchor bigint"


def decode_npz(files: DataFrame, prefix: str = "") -> DataFrame:
    """Detections of NPZ dumps given as (content): one N x 6 matrix a stem (box, score, class), or N x 11 with probabilities and anchor.

    Only keys with ``prefix`` are read, and lose it; classes outside 0..3 are left out; unreadable files yield nothing.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for blob in pdf["content"]:
                try:
                    dump = np.load(io.BytesIO(blob), allow_pickle=False)
                    keys = [k for k in dump.files if k.startswith(prefix)]
                except (ValueError, OSError, EOFError, KeyError):
                    continue
                parts = []
                for k in keys:
                    m = np.asarray(dump[k], dtype=float)
                    m = m.reshape(-1, m.shape[-1] if m.size else 6)
                    i = np.flatnonzero((m[:, 5] >= 0) & (m[:, 5] <= 3))
                    full = m.shape[1] >= 11
                    parts.append((np.full(len(i), k[len(prefix):], dtype=object), i, m[i, :5], m[i, 5], list(m[i, 6:10]) if full else [None] * len(i), list(m[i, 10]) if full else [None] * len(i)))
                if parts:
                    box = np.concatenate([p[2] for p in parts])
                    yield pd.DataFrame({"stem": np.concatenate([p[0] for p in parts]), "row_index": np.concatenate([p[1] for p in parts]).astype("int32"), **{c: box[:, j] for j, c in enumerate(("x1", "y1", "x2", "y2", "score"))},
                                        "cls": np.concatenate([p[3] for p in parts]).astype("int32"), "p": [x for p in parts for x in p[4]], "anchor": pd.array([x for p in parts for x in p[5]], dtype="Int64")})

    return files.select("content").mapInPandas(run, DETECTIONS)


def npz_dumps(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    return decode_npz(spark.read.format("binaryFile").load(path), prefix)


def decode_depth(files: DataFrame, width: int, height: int) -> DataFrame:
    """(path, v, u, mm) of raw little-endian uint16 depth images given as (path, content); 0 is no data; other sizes are skipped."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, blob in zip(pdf["path"], pdf["content"], strict=True):
                if blob is None or len(blob) != 2 * width * height:
                    continue
                z = np.frombuffer(blob, dtype="<u2").reshape(height, width)
                v, u = np.nonzero(z)
                yield pd.DataFrame({"path": path, "v": v.astype("int32"), "u": u.astype("int32"), "mm": z[v, u].astype("int32")})

    return files.select("path", "content").mapInPandas(run, "path string, v int, u int, mm int")


def struct_numbers(text: Column, field: str) -> Column:
    """All numbers of ``field{...}`` or ``field=[...]`` in a printed structure, as array<double>."""
    inner = F.regexp_extract(text, rf"{field}\s*[=:]?\s*[\[{{(]([^\]}})]*)", 1)
    return F.transform(F.regexp_extract_all(inner, F.lit(r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"), F.lit(0)), lambda x: x.cast("double"))


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified) of binary files; their pixels are not decoded here."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def views_of_trees(stems: DataFrame) -> DataFrame:
    """(tree, stems): the sorted image stems of each tree."""
    tree, _ = tree_and_side(F.col("stem"))
    return stems.groupBy(tree.alias("tree")).agg(F.array_sort(F.collect_set("stem")).alias("stems"))


def file_states(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, size, time of change) of every file under ``path``, sorted: what a stored result depends on."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not found.exists(p):
        return []
    out, files = [], found.listFiles(p, True)
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def signature(*parts) -> str:
    """Digest of the parameters and inputs (see :func:`file_states`) that a stored result depends on."""
    import hashlib

    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def stored(spark: SparkSession, name: str, key: str, make, lasting: bool = False) -> DataFrame:
    """The result of ``make()`` kept as a table under ``name`` and ``key``; made again only if the table is not complete.

    A table is complete once the committer has left its ``_SUCCESS`` mark; other errors are not taken for "not there yet".
    It is removed when the program ends, unless ``lasting``.
    """
    path = f"{shared_dir(spark)}/kept/{name}/{key}"
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        make().write.mode("overwrite").parquet(path)
    if not lasting:
        removed_at_end(spark, path)
    return spark.read.parquet(path)


def scan_in_chunks(spark: SparkSession, name: str, path: str, files_a_chunk: int, scan) -> DataFrame:
    """``scan(paths)`` of all files under ``path`` in chunks, each kept as soon as it is complete: a scan that was cut short goes on.

    A chunk's key holds its files' sizes and times of change, so a changed file is scanned anew with its chunk.
    """
    states = file_states(spark, path)
    out = None
    for i in range(0, len(states), files_a_chunk):
        part = states[i : i + files_a_chunk]
        df = stored(spark, name, signature(part), lambda part=part: scan([p for p, _, _ in part]), lasting=True)
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise FileNotFoundError(f"no files under {path}")
    return out


def parse_bank(specs: Sequence[str], least: int = 2) -> dict[str, tuple[str, ...]]:
    """``NAME=VAL=TEST`` (or with TRAIN in front) to paths by name; a repeated name, an empty path or too few members is an error."""
    out: dict[str, tuple[str, ...]] = {}
    for s in specs:
        name, *paths = [x.strip() for x in s.split("=")]
        if not name or len(paths) not in (2, 3) or not all(paths):
            raise ValueError(f"not NAME=VAL=TEST: {s!r}")
        if name in out:
            raise ValueError(f"{name} is given twice")
        out[name] = tuple(paths)
    if len(out) < least:
        raise ValueError(f"{len(out)} members, at least {least} are needed")
    return out
