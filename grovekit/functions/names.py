"""Reading dirty names by their meaning: trees, splits, sessions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from grovekit.scale import tidy

# The spellings of the three splits (English and Indonesian) and the placeholders that name no session.
SPLIT_WORDS = {
    "train": ["train", "training", "latih", "pelatihan"],
    "val": ["val", "valid", "validation", "validasi"],
    "test": ["test", "testing", "uji", "pengujian"],
}
PLACEHOLDERS = ["", "-", "--", "?", "n/a", "na", "nan", "none", "null", "unknown", "tidak diketahui", "tidak ada"]


def tree_key(c: Column) -> Column:
    """One text per physical tree: variety, block and number, whatever the spelling; null where nothing is named.

    Byte order marks, blanks, letter case, the kind of separator, leading zeros of the number and a mark of a further visit
    behind the number don't count.  A name that hasn't this form stands for itself, without case and separators.
    """
    plain = F.btrim(F.regexp_replace(F.regexp_replace(F.lower(c), "[﻿​]", ""), r"[^\p{L}\p{N}]+", "_"), F.lit("_"))
    form = r"^([a-z]+)_([a-z]+[0-9]+[a-z]*)_0*([0-9]+)(?:_.*|[a-z].*)?$"
    keyed = F.concat_ws("|", F.regexp_extract(plain, form, 1), F.regexp_extract(plain, form, 2), F.regexp_extract(plain, form, 3))
    return F.when(plain.rlike(form), keyed).when(plain != "", plain)


def split_name(c: Column) -> Column:
    """train, val or test by meaning; null where none is named."""
    word = F.lower(tidy(c))
    out = F.when(F.lit(False), F.lit(""))
    for name, words in SPLIT_WORDS.items():
        out = out.when(word.isin(words), F.lit(name))
    return out


def told(c: Column) -> Column:
    """A name without blanks around it; null for blanks and placeholders."""
    word = tidy(c)
    return F.when(~F.lower(word).isin(PLACEHOLDERS), word)
