"""Sentence boundaries across languages and scripts, by a finite transducer over the events of a text.

A lexer turns text into events (end marks that end, end marks that may be carried on, opening and closing quotes and brackets,
paragraph breaks, list items, blanks between Thai characters); each event is decided from a bounded stretch of text around it.
A finite transducer, compiled once from the rules in :func:`step`, reads the events and says where sentences end; its state is
what is open, whether that stood at the sentence's start, and whether an end mark has just been read inside it.

Long documents are cut into chunks in one pass.  Each chunk is lexed once, with whole runs of characters on both sides as context,
so that no run of blanks, letters or marks is ever cut.  A chunk's events form a function from the state before it to the state
after it; these functions are composed by a parallel prefix scan (doubling steps, over chunks of all documents at once),
which gives every chunk its true first state; the kept events are then read from there, all chunks independently.

Defined cases: null and blank texts have no sentences; a text without any end mark is one sentence per paragraph; quotes or
brackets left open are closed by the end of their paragraph; quotes and brackets count down to ``DEPTH`` levels, deeper ones are
plain characters (a finite transducer knows finitely many levels); repeated documents are repeated.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grovekit.scale import Workspace, read

CHUNK = 8192
#: Whole runs (of blanks, of letters and digits, of one other character) that a chunk sees on either side.
CONTEXT = 32

# Abbreviations (lower case, inner points kept, without the last point) that never end a sentence by themselves,
# and those that end it where the next one visibly begins.
NEVER = """dr ir prof sdr sdri bpk ibu no nr gbr tbl pk hlm hal kab kec kel prov jl jln vs s.d a.n a.l u.b u.p d.a mis tgl yth lih lamp agt
    lampiran jml min maks mr mrs ms st fig figs sec secs eq eqs chap ch app cf e.g i.e p pp p.p vol incl approx resp std dev viz
    jan feb mar apr jun jul aug sep sept oct okt nov dec des fr gen gov sen rev hon capt lt col sgt ed eds al et rp dept est
    डॉ सं श्री प्रो क्र पृ د أ م ص""".split()
# After these a lower-case word goes on with the sentence only if it is one of the words below.
LISTING = "dll dsb dst etc a.m p.m".split()
GOES_ON = """yang dan atau untuk dari di ke pada dengan oleh tetapi namun serta agar karena sebab sebelum sesudah setelah sampai hingga akan belum sudah
    tidak bukan adalah ialah juga itu ini para by on in at of and or but for from to with that which who as is are was were has have had will
    would can could should may until before after because since so than then when while""".split()
MAY_END = "dll dsb dst etc a.m p.m ltd inc co corp u.s u.k e.u u.n jr sr m.si m.sc ph.d b.sc s.t s.p s.si s.kom m.t m.p m.kom".split()

MARKS, SPACE = ".?!…。！？؟।॥｡．︒‼⁇⁈⁉", r"[^\S\n]"
OPEN = {"(": "B", "[": "B", "{": "B", "（": "B", "［": "B", "｛": "B", "【": "B", "「": "Q", "『": "Q", "《": "Q", "〈": "Q", "“": "Q", "«": "Q"}
CLOSE = {")": "B", "]": "B", "}": "B", "）": "B", "］": "B", "｝": "B", "】": "B", "」": "Q", "』": "Q", "》": "Q", "〉": "Q", "”": "Q", "»": "Q"}
ITEM = rf"(?:[-*•·‣▪–]|\(?[0-9]{{1,3}}[.)]|\(?[a-z][.)])(?:{SPACE}+)(?=\S)"
HEAD = rf"(?:(?:bab|chapter|bagian|section|part|pasal|lampiran|appendix|bagian|kapitel)[ \t]+(?:[0-9]+(?:\.[0-9]+){{0,8}}|[ivxlc]+)\.(?=[ \t]+\S)|[0-9]+(?:\.[0-9]+){{1,8}}\.?(?=[ \t]+\S)|[IVXLC]+\.(?=[ \t]+\S))"
COLONS = tuple(":,：，、،")
PARA = rf"\n{SPACE}*(?:\n{SPACE}*)+"
THAI = "฀-๿"
LEXER = re.compile(
    rf"(?P<para>{PARA}(?:{ITEM}|(?i:{HEAD}))?)|(?P<item>\n{SPACE}*{ITEM})|(?P<thai>(?<=[{THAI}])\s+(?=[{THAI}]))"
    rf"|(?P<mark>[{re.escape(MARKS)}]+)|(?P<open>[{re.escape(''.join(OPEN))}])|(?P<close>[{re.escape(''.join(CLOSE))}])|(?P<quote>\")"
)
LEADING = re.compile(rf"\s*(?:{ITEM}|(?i:{HEAD}))")
BREAK = re.compile(rf"{SPACE}*(?:{PARA}|\n{SPACE}*{ITEM}|\s*\Z)")
WORD = re.compile(r"[^\W_](?:[\w.ऀ-ॿ]*)?\Z")
UNIT = re.compile(r"(?:[0-9]\s?|[°/])\Z")
# A sentence may begin small: a name with digits or capitals inside, a label with a number, an abbreviation of single letters.
STARTER = re.compile(r"(?:[a-z]+[0-9A-Z]\w*|[a-z]+ (?=[0-9]+ ?[:=])|(?:[a-z]\.){2,})")
LINE_NUMBER = re.compile(r"\n(?:(?=\n)|[^\S\n]*\(?([0-9]{1,3})([.)])(?=\s))")


def _after(text: str, p: int) -> str:
    """What follows position p: end, no (the sentence visibly goes on), low, up (a new one may begin), letter (no case)."""
    if BREAK.match(text, p):
        return "end"
    q = p
    while q < len(text) and text[q].isspace():
        q += 1
    spaced, r = q > p, q
    while r < len(text) and (text[r] in OPEN or text[r] in "\"'‘"):
        r += 1
    c = text[r : r + 1]
    if not c:
        return "end"
    if c.isdigit() or c.isupper():
        return "up"
    if c.islower():
        return "up" if STARTER.match(text, r) else "low"
    if not c.isalpha():
        return "no"
    if not spaced and r == q and (text.startswith("と", r) or text.startswith("って", r)):
        return "no"
    return "letter"


def _word_before(text: str, s: int) -> str:
    m = WORD.search(text, max(0, s - 24), s)
    return m.group() if m else ""


def _mark(text: str, s: int, e: int) -> str | None:
    """end: ends a sentence outside quotes and brackets; soft: doesn't, but may close what a quotation carries; None: no mark."""
    run, prev, nxt = text[s:e], text[s - 1 : s], text[e : e + 1]
    closed = nxt in CLOSE or nxt == '"'  # what closes here decides by what follows it
    if run == ".":
        if prev.isdigit() and nxt.isdigit():
            return None
        word = _word_before(text, s)
        low = word.lower()
        unit = bool(UNIT.search(text, max(0, s - len(word) - 3), s - len(word)))  # 22°C, 9 MB, 640 px
        if nxt and not nxt.isspace() and (nxt.isalnum() or nxt == "_"):
            if nxt.isupper():
                if low in NEVER or low in MAY_END or (len(word.rsplit(".", 1)[-1]) == 1 and not unit) or f"{low}.{nxt.lower()}" in MAY_END or re.match(r"[A-Z][a-z]?\.", text[e : e + 3]):
                    return None
                return "end"
            if nxt.isascii() or nxt == "_":
                starts = STARTER.match(text, e) and not re.match(r"[\w]+\.\w", text[e : e + 40])
                return "end" if starts and word.isalpha() and low not in NEVER else None
            return "end" if low not in NEVER else None
        after = "up" if closed else _after(text, e)
        if after == "end":
            return "end"
        if not prev or prev.isspace():
            return "soft"
        if low in LISTING and after == "low":
            return "soft" if re.match(r"\s*(\w*)", text[e : e + 40])[1] in GOES_ON else "end"
        if low in MAY_END:
            return "soft" if after in ("no", "low") else "end"
        last = low.rsplit(".", 1)[-1]
        if low in NEVER or (len(last) == 1 and last.isalpha() and not unit):
            return "soft"
        if after == "low" and not unit and len(low) <= 3 and low.isascii() and low.isalpha() and not set(low) & set("aeiouy"):
            return "soft"
        return "soft" if after == "no" else "end"
    if all(c in ".…" for c in run):
        after = "no" if closed else _after(text, e)
        return "end" if after in ("end", "up") else "soft"
    if nxt == "=":
        return None
    return "soft" if not closed and _after(text, e) == "no" else "end"


# ---------------------------------------------------------------- the transducer

#: Levels of open quotes and brackets that are told apart; only the outermost one's place matters.
DEPTH = 6
#: Paragraph or item, and Thai blank; marks; opening (0 anywhere, 1 behind a colon or comma); closing by what follows; the
#: straight quote, which opens or closes, by both.
AFTER = ("end", "up", "low", "no", "letter")
SYMBOLS = ["P", "T", "E", "S", *[f"o{k}{c}" for k in "BQ" for c in "01"], *[f"c{k}_{r}" for k in "BQ" for r in AFTER], *[f"d{c}_{r}" for c in "01" for r in AFTER]]
START = ((), "", True)


def carries_on(kind: str, place: str, mark: str, after: str) -> bool:
    """Whether the sentence goes on behind a closed quotation or bracket whose last mark was ``mark``.

    ``place`` says where it was opened: at the sentence's start, behind a colon or comma, or amid the sentence.
    """
    if after in ("no", "end"):
        return after == "no"
    if mark == "S":
        return after != "up" or place == "amid"
    if kind == "B":
        return place != "start" and after != "up"
    if after == "up":
        return False
    return place != "colon"


def step(state: tuple, symbol: str, gap: bool) -> tuple[tuple, bool]:
    """(next state, whether a sentence ends here); a state is (what is open and where it began, the mark just read, fresh)."""
    stack, mark, fresh = state
    if gap:
        mark, fresh = "", False
    if symbol == "P":
        return START, True
    if symbol == "T":
        return (START, True) if not stack else ((stack, mark, fresh), False)
    if symbol in "ES":
        if not stack:
            return (START, True) if symbol == "E" else ((stack, "", False), False)
        return (stack, symbol, False), False
    held = [k for k, _ in stack]
    what = "D" if symbol[0] == "d" else symbol[1]
    if symbol[0] == "o" or (symbol[0] == "d" and "D" not in held):
        colon = (symbol[2] if symbol[0] == "o" else symbol[1]) == "1"
        place = "start" if fresh else "colon" if colon else "amid"
        return ((*stack, (what, "in" if stack else place)) if len(stack) < DEPTH else stack, "", fresh), False
    if what not in held:
        return (stack, mark, False), False
    at = len(held) - 1 - held[::-1].index(what)
    place, stack = stack[at][1], stack[:at]
    if not mark or stack:
        return (stack, mark, False), False
    return (((), "", False), False) if carries_on(what, place, mark, symbol.split("_")[1]) else (START, True)


class Transducer:
    """Tables over all states reachable from the start: next_[symbol, state] and ends[symbol, state]."""

    def __init__(self) -> None:
        alphabet = [(s, g) for s in SYMBOLS for g in (False, True)]
        self.code = {a: i for i, a in enumerate(alphabet)}
        states, todo = {START: 0}, [START]
        trans: dict[tuple[int, int], tuple[int, bool]] = {}
        while todo:
            st = todo.pop()
            for i, (s, g) in enumerate(alphabet):
                nxt, ends = step(st, s, g)
                if nxt not in states:
                    states[nxt] = len(states)
                    todo.append(nxt)
                trans[i, states[st]] = states[nxt], ends
        self.size = len(states)
        self.next_ = np.zeros((len(alphabet), self.size), dtype=np.int16)
        self.ends = np.zeros((len(alphabet), self.size), dtype=bool)
        for (i, k), (n, e) in trans.items():
            self.next_[i, k], self.ends[i, k] = n, e
        self.steps = [list(zip(map(int, self.next_[i]), map(bool, self.ends[i]), strict=True)) for i in range(len(alphabet))]


_machine: list[Transducer] = []


def machine() -> Transducer:
    if not _machine:
        _machine.append(Transducer())
    return _machine[0]


class _Lists:
    """Numbers at the begins of a paragraph's lines so far, each with its mark; read on as far as asked, once over the text."""

    def __init__(self, seen: Iterable[str] = ()) -> None:
        self.seen, self.at, self.next = set(seen), 0, None

    def read(self, text: str, upto: int) -> set[str]:
        while self.at < upto:
            m = self.next or LINE_NUMBER.search(text, self.at)
            if not m:
                self.at = len(text)
            elif m.start() >= upto:
                self.next, self.at = m, max(self.at, upto)
                break
            else:
                self.next, self.at = None, m.end()
                self.seen.add(m[1].lstrip("0") + m[2]) if m[1] else self.seen.clear()
        return self.seen


def _is_item(text: str, m: re.Match, lists: _Lists) -> bool:
    """A line that begins with a number is an item only as a list's first or next number; else it is a wrapped line."""
    own = re.match(r"\n\s*\(?([0-9]{1,3})([.)])", m.group())
    if not own or int(own[1]) <= 1:
        return True
    return f"{int(own[1]) - 1}{own[2]}" in lists.read(text, m.start())


def events(text: str, lo: int, hi: int, first: bool, seen: Iterable[str] = ()) -> list[tuple[int, int]]:
    """(code, where a sentence would end) of the events that begin in [lo, hi).

    ``first``: 0 is the begin of the whole text; else ``seen`` are the list numbers of the paragraph before 0.
    """
    code, out, last, at, lists = machine().code, [], 0, 0, _Lists(seen)
    if first:
        m = LEADING.match(text)
        at = last = m.end() if m else 0
    while True:
        m = LEXER.search(text, at)
        if not m or m.start() >= hi:
            return out
        kind, s, e = m.lastgroup, m.start(), m.end()
        at = e
        if kind == "para":
            symbol, stop = "P", s
        elif kind == "item":
            if not _is_item(text, m, lists):
                at = s + 1
                continue
            symbol, stop = "P", s
        elif kind == "thai":
            symbol, stop = "T", s
        elif kind == "mark":
            found = _mark(text, s, e)
            if found is None:
                continue
            symbol, stop = "E" if found == "end" else "S", e
        else:
            colon = "01"[text[max(0, s - 3) : s].rstrip()[-1:] in COLONS]
            symbol = f"o{OPEN[m.group()]}{colon}" if kind == "open" else (f"d{colon}_" if kind == "quote" else f"c{CLOSE[m.group()]}_") + _after(text, e)
            stop = e
        if s >= lo:
            gap = not text[last:s].isspace() and s > last
            out.append((code[symbol, gap], stop))
        last = e


def _trimmed(text: str, a: int, b: int) -> tuple[int, int] | None:
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    return (a, b) if a < b else None


def split_sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of a text's sentences, read in one go."""
    if not text:
        return []
    steps, state, cuts = machine().steps, 0, []
    for code, stop in events(text, 0, len(text), True):
        state, ends = steps[code][state]
        if ends:
            cuts.append(stop)
    spans = (_trimmed(text, a, b) for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True))
    return [s for s in spans if s]


# ---------------------------------------------------------------- distributed

def _kind(c: str) -> str:
    return " " if c.isspace() else "w" if c.isalnum() or c == "_" else c


def _run_edge(text: str, p: int, runs: int, step: int) -> int:
    """The place so many whole runs before (step -1) or behind (step 1) p."""
    last, n = None, 0
    while (p > 0) if step < 0 else (p < len(text)):
        k = _kind(text[p - 1] if step < 0 else text[p])
        if k != last:
            n, last = n + 1, k
            if n > runs:
                break
        p += step
    return p


def cut_text(text: str, chunk: int, context: int = CONTEXT) -> Iterator[tuple[int, int, int, list[str], str]]:
    """(begin, lo, hi, list numbers before begin, part) of a text's chunks: [lo, hi) of the text and whole runs around it.

    No chunk begins amid blanks; a run of blanks belongs to the chunk before it, however long it is.
    """
    lists, lo = _Lists(), 0
    while lo < len(text):
        hi = min(len(text), lo + chunk)
        while hi < len(text) and text[hi].isspace():
            hi += 1
        begin, end = _run_edge(text, lo, context, -1), _run_edge(text, hi, context, 1)
        yield begin, lo, hi, sorted(lists.read(text, begin)), text[begin:end]
        lo = hi


CUT = "doc_id bigint, k int, last boolean, begin int, lo int, hi int, seen array<string>, part string"


def chunked(docs: DataFrame, chunk: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CUT.split(", ")]
        for pdf in batches:
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                rows = []
                for k, (begin, lo, hi, seen, part) in enumerate(cut_text(text, chunk)):
                    rows.append((doc, k, hi == len(text), begin, lo, hi, seen, part))
                    if len(rows) == 256:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    return docs.mapInPandas(run, CUT).repartition("doc_id", "k")


LEXED = "doc_id bigint, k int, codes array<smallint>, before array<int>, behind array<int>, f array<smallint>"


def lexed(chunks: DataFrame) -> DataFrame:
    """(doc_id, k, codes, before, behind, f): a chunk's events, the text's ends around each, and its state function.

    The first chunk has one event more at its begin and the last at its end, with code -1: there a sentence ends in any state.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = machine()
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                text = r.part
                found = events(text, r.lo - r.begin, r.hi - r.begin, r.begin == 0, () if r.seen is None else r.seen)
                f = np.arange(m.size, dtype=np.int16)
                for code, _ in found:
                    f = m.next_[code][f]
                marks = [(-1, 0)] * (r.k == 0) + found + [(-1, len(text))] * bool(r.last)
                before, behind = [], []
                for _, c in marks:
                    a = b = c
                    while a > 0 and text[a - 1].isspace():
                        a -= 1
                    while b < len(text) and text[b].isspace():
                        b += 1
                    before.append(r.begin + a)
                    behind.append(r.begin + b)
                rows.append((r.doc_id, r.k, np.array([c for c, _ in marks], dtype=np.int16), np.array(before, dtype=np.int32), np.array(behind, dtype=np.int32), f))
            yield pd.DataFrame(rows, columns=["doc_id", "k", "codes", "before", "behind", "f"])

    return chunks.mapInPandas(run, LEXED)


def prefix_states(functions: DataFrame, ws: Workspace) -> DataFrame:
    """(doc_id, k, state): the state before chunk k, by composing all functions before it in doubling steps."""
    now = functions.select("doc_id", "k", "f")
    most = now.agg(F.max("k")).first()[0] or 0
    reach, i = 1, 0
    while reach <= most:
        before = now.select("doc_id", (F.col("k") + reach).alias("k"), F.col("f").alias("g"))
        composed = F.when(F.col("g").isNull(), F.col("f")).otherwise(F.transform("g", lambda s: F.get(F.col("f"), s)))
        nxt = ws.save(now.join(before, ["doc_id", "k"], "left").select("doc_id", "k", composed.alias("f")), f"scan{i}")
        if i:
            ws.drop(f"scan{i - 1}")
        now, reach, i = nxt, reach * 2, i + 1
    return now.select("doc_id", (F.col("k") + 1).alias("k"), F.get("f", F.lit(0)).cast("int").alias("state"))


def read_chunks(started: DataFrame) -> DataFrame:
    """(doc_id, k, edge, start_pos, end_pos): spans within a chunk, and one edge row with its first end and its last start."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps = machine().steps
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                state, start, first = r.state, None, None
                for code, a, b in zip(r.codes, r.before, r.behind, strict=True):
                    ends = True
                    if code >= 0:
                        state, ends = steps[code][state]
                    if not ends:
                        continue
                    if start is None:
                        first = a
                    elif start < a:
                        rows.append((r.doc_id, r.k, False, start, a))
                    start = b
                rows.append((r.doc_id, r.k, True, start, first))
            out = pd.DataFrame(rows, columns=["doc_id", "k", "edge", "start_pos", "end_pos"])
            yield out.astype({"start_pos": "Int32", "end_pos": "Int32"})

    return started.mapInPandas(run, "doc_id bigint, k int, edge boolean, start_pos int, end_pos int")


def sentence_units(documents: DataFrame, ws: Workspace, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, start_pos, end_pos) of all sentences of all documents (doc_id, text)."""
    docs = documents.select("doc_id", "text").where("doc_id is not null and text is not null")

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, a, b) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for a, b in split_sentences(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "start_pos", "end_pos"])

    short = docs.where(F.length("text") <= chunk).mapInPandas(whole, "doc_id bigint, start_pos int, end_pos int")
    events_ = ws.save(lexed(chunked(docs.where(F.length("text") > chunk), chunk)), "lexed")
    started = events_.drop("f").join(prefix_states(events_, ws), ["doc_id", "k"], "left").withColumn("state", F.coalesce("state", F.lit(0)))
    found = ws.save(read_chunks(started), "read")
    earlier = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)  # one row a chunk, not its sentences
    edges = found.where("edge").select("doc_id", F.last("start_pos", ignorenulls=True).over(earlier).alias("start_pos"), "end_pos").where("start_pos < end_pos")
    return short.union(found.where("not edge").select("doc_id", "start_pos", "end_pos")).union(edges)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_units(read(spark, sf_dir, "documents"), Workspace(spark, "p8"))
