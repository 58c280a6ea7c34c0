"""Deeply nested records as related flat tables, by Dewey labels.

Every object of a document gets the label of its path of ordinals (``4.0.5.2``: member 4, element 0, its member 5, element 2).
Cutting the last two ordinals off an element's label (the last one off a plain member's) gives its parent, so no join is
needed to keep parent and child together.  Objects are grouped by their schema path (``images``, ``images.annotations`` …),
one table each.

* :func:`typed_table` does it for nested Spark columns, with built-in expressions only.
* :func:`json_nodes` does it for JSON text whose members are optional, wrapped, differently shaped or typed; it parses
  every body once, however deep.  A body that is not complete JSON (null, blank, cut off, with a rest behind it) yields no
  node; one that is a list of documents yields each of them, labelled by its ordinal.

(source_row, node) is unique in every table and (source_row, parent) names the parent's row: source_row tells rows apart that
were filed twice under one document number.  Null or empty collections yield no rows, null elements yield no row but keep
their ordinal, and repeated documents are repeated in the tables (only :func:`linked_appearances` is distinct).  Columns of
the input other than the keys and the named nested ones are ignored, so clashing names do no harm.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grovekit.scale import Workspace

#: Members that hold many objects: as list, as object of named objects, or as a single object.
COLLECTIONS = ("images", "annotations", "bunches", "appearances")

NODE_SCHEMA = "doc_no bigint, source_row string, path string, node string, parent string, name string, members map<string,string>, parent_members map<string,string>"


def parent_label(node: Column, steps: int = 2) -> Column:
    """The label with its last ``steps`` ordinals cut off; the root's label is empty."""
    return F.regexp_replace(node, r"(?:^|\.)[0-9]+" + (r"\.[0-9]+" if steps == 2 else "") + "$", "")


def _elements(c: Column, kind: T.DataType) -> tuple[Column, T.StructType]:
    """A collection as array<struct<name, value>>, and the type of its objects."""
    if isinstance(kind, T.MapType):
        return F.map_entries(c), kind.valueType
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value"))), kind.elementType
    raise TypeError(f"not a collection of objects: {kind.simpleString()}")


def _flat(kind: T.DataType) -> bool:
    inner = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType if isinstance(kind, T.MapType) else kind
    return not isinstance(inner, T.StructType)


def typed_table(df: DataFrame, keys: Sequence[str], path: Sequence[str], up: Sequence[str] = ()) -> DataFrame:
    """The table of the objects at ``path`` (e.g. ``("images", "annotations")``) of nested columns.

    Columns: the keys, ``node``, ``parent``, ``name`` (the map key of a named object), the object's own flat members, and
    ``up``: members of the object's ancestors, named ``<collection>_<member>`` (``name`` for the ancestor's map key).
    """
    fields = df.schema
    at = [f.name for f in fields].index(path[0])
    arr, kind = _elements(F.col(f"`{path[0]}`"), fields[path[0]].dataType)
    ids = [f"_k{i}" for i in range(len(keys))]
    out = df.select(*[F.col(f"`{k}`").alias(i) for k, i in zip(keys, ids, strict=True)], F.posexplode(arr).alias("_pos", "_e0"))
    label = [F.lit(at), F.col("_pos")]
    keep: list[Column] = []
    out = out.where("_e0.value is not null").select(*ids, F.concat_ws(".", *label).alias("_node"), "_e0")
    for depth, name in enumerate(path[1:], 1):
        ordinal = [f.name for f in kind].index(name)
        arr, child = _elements(F.col(f"_e{depth - 1}.value.`{name}`"), kind[name].dataType)
        keep = [F.col(f"_e{i}") for i in range(depth)]
        out = out.select(*ids, "_node", *keep, F.posexplode(arr).alias("_pos", f"_e{depth}")).where(f"_e{depth}.value is not null")
        out = out.withColumn("_node", F.concat_ws(".", "_node", F.lit(ordinal), "_pos")).drop("_pos")
        kind = child
    last = f"_e{len(path) - 1}"
    own = [F.col(f"{last}.value.`{f.name}`").alias(f.name) for f in kind if _flat(f.dataType)]
    ups = []
    for u in up:
        owner, member = u.rsplit(".", 1)
        e = f"_e{list(path).index(owner)}"
        ups.append((F.col(f"{e}.key") if member == "name" else F.col(f"{e}.value.`{member}`")).alias(f"{owner}_{member}"))
    return out.select(*[F.col(i).alias(k) for k, i in zip(keys, ids, strict=True)], F.col("_node").alias("node"), parent_label(F.col("_node")).alias("parent"), F.col(f"{last}.key").alias("name"), *ups, *own)


def _scalar(v) -> str | None:
    if v is None:
        return None
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return v
    try:
        return json.dumps(v, ensure_ascii=False)
    except RecursionError:
        return _written(v)


def _written(v) -> str:
    """JSON text of a value of any depth, like ``json.dumps``."""
    out, todo = [], [v]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            out.append(x[0])
        elif isinstance(x, list):
            parts = [p for y in x for p in ((", ",), y)][1:]
            todo += reversed([("[",), *parts, ("]",)])
        elif isinstance(x, dict):
            parts = [p for k, y in x.items() for p in ((", ",), (json.dumps(k, ensure_ascii=False) + ": ",), y)][1:]
            todo += reversed([("{",), *parts, ("}",)])
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


def shred(doc, collections: frozenset[str], label: str = "") -> Iterator[tuple]:
    """(path, node, parent, name, members, parent's members) of every object of a parsed document, parents first.

    ``label``: the document's own label, its ordinal in a list of documents.
    """
    stack = [("", label, None, None, doc, {})]
    while stack:
        path, node, parent, name, obj, up = stack.pop()
        members, children = {}, []
        for i, (k, v) in enumerate(obj.items()):
            here, below = f"{node}.{i}" if node else str(i), f"{path}.{k}" if path else k
            if k in collections and isinstance(v, (dict, list)):
                named = isinstance(v, dict) and v and all(isinstance(x, dict) for x in v.values())
                items = list(v.items()) if named else [(None, x) for x in (v if isinstance(v, list) else [v] if v else [])]
                children += [(below, f"{here}.{e}", node, n, x) for e, (n, x) in enumerate(items) if isinstance(x, dict)]
            elif isinstance(v, dict):
                children.append((below, here, node, None, v))
            else:
                members[k] = _scalar(v)
        yield path, node, parent, name, members, up
        inherit = members if name is None else members | {"name": name}
        stack += [(*c, inherit) for c in reversed(children)]


def unwrap(doc, collections: frozenset[str]):
    """The object that holds the collections: the document itself, or what the envelopes around it hold, however many."""
    level = [doc]
    while level:
        for x in level:
            if isinstance(x, dict) and collections & x.keys():
                return x
        level = [v for x in level if isinstance(x, dict) for v in x.values() if isinstance(v, dict)]
    return doc if isinstance(doc, dict) else None


def documents_of(value, collections: frozenset[str]) -> list[tuple[str, dict]]:
    """(label, document) of a parsed body: one document, or a list of them (of lists too), each labelled by its ordinals."""
    if not isinstance(value, list):
        doc = unwrap(value, collections)
        return [] if doc is None else [("", doc)]
    out, todo = [], [("", value)]
    while todo:
        label, v = todo.pop()
        if isinstance(v, list):
            todo += [(f"{label}.{i}" if label else str(i), x) for i, x in reversed(list(enumerate(v)))]
        elif (doc := unwrap(v, collections)) is not None:
            out.append((label, doc))
    return out


def parse_document(body: str | None):
    """The parsed JSON of a body, without byte order mark; None if it is not one complete JSON value."""
    if body is None:
        return None
    text = body.lstrip("\ufeff \t\r\n")
    try:
        return json.loads(text)
    except RecursionError:
        return _parse_deep(text)
    except ValueError:
        return None


_TOKEN = re.compile(r'[ \t\r\n]*(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity))')


def _parse_deep(text: str):
    """``json.loads`` for values nested deeper than the interpreter's stack: a stack of open lists and objects."""
    open_: list = []  # (container, key waiting for its value)
    at, end, want = 0, len(text.rstrip(" \t\r\n")), "value"
    result = None
    while at < end:
        m = _TOKEN.match(text, at)
        if not m or want == "nothing":
            return None
        at = m.end()
        sign = m[1]
        if sign in ("[", "{") and want in ("value", "value or ]"):
            open_.append([[] if sign == "[" else {}, None])
            want = "value or ]" if sign == "[" else "key or }"
            continue
        if sign == ":" and want == ":":
            want = "value"
            continue
        if sign == "," and want == "more" and open_:
            want = "value" if isinstance(open_[-1][0], list) else "key"
            continue
        if m[2] and want in ("key", "key or }"):
            try:
                open_[-1][1], want = json.loads(m[2]), ":"
            except ValueError:
                return None
            continue
        if sign in ("]", "}"):
            if not open_ or isinstance(open_[-1][0], list) != (sign == "]") or want not in ("more", "value or ]" if sign == "]" else "key or }"):
                return None
            value = open_.pop()[0]
        elif sign is None and want in ("value", "value or ]"):
            try:
                value = json.loads(m[2] or m[3])
            except ValueError:
                return None
        else:
            return None
        if not open_:
            result, want = value, "nothing"
        else:
            box, key = open_[-1]
            box.append(value) if isinstance(box, list) else box.__setitem__(key, value)
            want = "more"
    return result if want == "nothing" else None


def json_nodes(df: DataFrame, key: str, row: str, body: str, collections: Sequence[str] = COLLECTIONS) -> DataFrame:
    """One row for each object of each JSON body: schema path, Dewey label, parent's label, members as text."""
    many = frozenset(collections)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, r, b in zip(pdf["k"], pdf["r"], pdf["b"], strict=True):
                for label, doc in documents_of(parse_document(b), many):
                    rows += [(k, r, *n) for n in shred(doc, many, label)]
                if len(rows) > 20_000:
                    yield _frame(rows)
                    rows = []
            yield _frame(rows)

    return df.select(F.col(key).cast("bigint").alias("k"), F.col(row).cast("string").alias("r"), F.col(body).alias("b")).mapInPandas(run, NODE_SCHEMA)


def _frame(rows: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_no", "source_row", "path", "node", "parent", "name", "members", "parent_members"], dtype=object)
    return out.astype({"doc_no": "Int64"})


def whole(c: Column) -> Column:
    """A whole number given as number or as text; null if it is none, or beyond four bytes."""
    t = F.btrim(c.cast("string"))
    return F.when(t.rlike(r"^[+-]?[0-9]+(\.0*)?$"), F.regexp_replace(t, r"\.0*$", "").try_cast("int"))


def numbers(c: Column) -> Column:
    """array<double> of a JSON list, or of numbers separated by blanks or commas."""
    t = F.regexp_replace(c, r"[\[\]]", " ")
    parts = F.filter(F.split(t, r"[\s,;]+"), lambda x: x != "")
    return F.when(c.isNotNull(), F.transform(parts, lambda x: x.try_cast("double")))


def tree_tables(tree_doc: DataFrame, tree_raw: DataFrame, ws: Workspace) -> dict[str, DataFrame]:
    """trees, images, annotations, bunches and appearances of both document tables, with the same columns.

    ``tree_doc`` has a column ``source_row`` that is unique (:func:`grovekit.scale.with_source_row`); a raw document's is its
    raw_id.  Raw bodies are parsed once, into a working table that all five tables read.
    """
    docs = tree_doc.withColumn("source_row", F.concat(F.lit("doc:"), F.col("source_row")))
    nodes = ws.save(json_nodes(tree_raw.withColumn("source_row", F.concat(F.lit("raw:"), F.col("raw_id"))), "doc_no", "source_row", "body"), "nodes")
    m, up = (lambda k: F.col("members")[k]), (lambda k: F.col("parent_members")[k])
    at = lambda path: nodes.where(F.col("path") == path)
    keys = ["source_row", "doc_no"]
    ids = [*keys, "node", "parent"]
    trees = docs.select(*keys, F.lit("").alias("node"), "tree_id", "tree_name", "split", "detector").union(
        at("").select(*keys, "node", m("tree_id"), m("tree_name"), m("split"), m("detector")))
    images = typed_table(docs, keys, ["images"]).select(*ids, F.col("name").alias("side"), "side_index", "filename", "width", "height").union(
        at("images").select(*ids, F.coalesce("name", m("side")), whole(m("side_index")), m("filename"), whole(m("width")), whole(m("height"))))
    ann = typed_table(docs, keys, ["images", "annotations"], up=["images.side_index"]).select(
        *ids, F.col("images_side_index").alias("side_index"), "box_index", "class_id", "class_name", "bbox_yolo", "bbox_pixel", "conf").union(
        at("images.annotations").select(*ids, whole(up("side_index")), whole(m("box_index")), whole(m("class_id")), m("class_name"), numbers(m("bbox_yolo")), numbers(m("bbox_pixel")), m("conf").try_cast("double")))
    bunches = typed_table(docs, keys, ["bunches"]).select(*ids, "bunch_id", F.col("class").alias("class_name"), "class_mismatch", "appearance_count").union(
        at("bunches").select(*ids, m("bunch_id"), F.coalesce(m("class"), m("class_name")), m("class_mismatch").try_cast("boolean"), whole(m("appearance_count"))))
    app = typed_table(docs, keys, ["bunches", "appearances"], up=["bunches.bunch_id"]).select(
        *ids, F.col("bunches_bunch_id").alias("bunch_id"), "side", "side_index", "box_index", "bbox_pixel").union(
        at("bunches.appearances").select(*ids, up("bunch_id"), m("side"), whole(m("side_index")), whole(m("box_index")), numbers(m("bbox_pixel"))))
    return {"trees": trees, "images": images, "annotations": ann, "bunches": bunches, "appearances": app}


def linked_appearances(tables: dict[str, DataFrame]) -> DataFrame:
    """Distinct (doc_no, bunch_id, side_index, box_index) of appearances that point at an annotation of their document.

    An appearance without side_index has that of the image called by its ``side``.  Documents without doc_no have none.
    """
    app = tables["appearances"].select("doc_no", "bunch_id", "side", "side_index", "box_index").where("doc_no is not null and box_index is not null").distinct()
    told = app.where("side_index is not null").select("doc_no", "bunch_id", "side_index", "box_index")
    sides = tables["images"].select("doc_no", "side", F.col("side_index").alias("s")).where("doc_no is not null and side is not null and s is not null").distinct()
    by_name = app.where("side_index is null").join(sides, ["doc_no", "side"]).select("doc_no", "bunch_id", F.col("s").alias("side_index"), "box_index")
    boxes = tables["annotations"].select("doc_no", "side_index", "box_index").where("doc_no is not null")
    return told.union(by_name).distinct().join(boxes, ["doc_no", "side_index", "box_index"], "left_semi").select("doc_no", "bunch_id", "side_index", "box_index")
