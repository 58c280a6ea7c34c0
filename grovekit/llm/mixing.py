"""Mixing sources to target weights by soft memberships and projected-gradient least squares.

A naive Bayes classifier is fitted on the table of labelled documents.  Every document, labelled or not, gets its posterior shares
of the sources asked for, given its text and the source it names: a name is taken for right with the probability ``TRUST``,
and the text decides how the rest is shared (all of it, where none is named).  Nonnegative document rates, at most the source's ``max_repeats``, are fitted by projected
gradient steps so that two families of token totals meet the targets: those expected by the posteriors, and those of the
sources that the documents name themselves (a document that names none counts there by its posterior too).  Where both
can't be met, the named sources' totals are what the mix is asked for, so the last steps close only these.  Documents of
sources that no mix asks for take part like all others, with a target of none for what they name.

A membership is a document's posterior shares of all sources, each of them counted as it is.  Documents with the same two
likeliest sources, in parts of ``1 / GRAIN`` of both, and the same named source share one rate: such a bin's membership is the mean
of its documents' whole posteriors, weighted by tokens, so its totals are exactly the sums over its documents, with the shares of
every source.  The corpus is aggregated to these sums by bin; a step needs nothing else, and with K sources there are at
most (K + 1) ** 2 * GRAIN / 2 * (K + 2) bins however many documents there are, so the steps are taken on that table.  Rates
become whole copies by carrying the error on within bounded blocks of a source, largest documents
first, so a block's error is at most half of its smallest document.

A source without documents, or whose capped documents don't suffice, falls short; its shortfall is reported and left open,
others keep their targets.  Null and empty texts get no copies.  Null or nonpositive targets ask for nothing; of repeated
targets of a mix and source the largest counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.functions.names import told
from grovekit.llm.tokens import VOCABULARY, sized
from grovekit.scale import Workspace, read

#: Hash places of words; words' weight that the sources' common word shares have in each source.
FEATURES, SMOOTH = 1 << 14, 5000.0
#: Steps on both families; steps at most on the named sources' totals, which settle to ``CLOSE`` of their target.
STEPS, CLOSING, CLOSE = 3000, 20_000, 1e-7
GRAIN = 128
#: How probable it is that a document belongs to the source it names.
TRUST = 0.9
#: Documents of a source that are rounded to whole copies in one task.
BLOCK = 50_000


def source_name(c: Column) -> Column:
    return F.lower(told(c))


def words(text: Column) -> Column:
    """Words, and pairs of letters in scripts without blanks."""
    dense = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}"
    return F.transform(F.regexp_extract_all(text, F.lit(rf"[{dense}]{{1,2}}|[\p{{L}}\p{{M}}&&[^{dense}]]+"), F.lit(0)), F.lower)


def posteriors(labelled: DataFrame, documents: DataFrame, sources: list[str]) -> DataFrame:
    """(doc_id, p): posterior share of each of ``sources`` by the text alone, for all ``documents`` (doc_id, text).

    ``labelled`` is (text, source); fitted on all labelled documents by counting words, hashed to ``FEATURES``, by source: a table
    of bounded size.  Counts are smoothed towards the words' shares in all sources, so that new words speak for none.  Words of
    a text aren't independent, so its log-likelihood is divided by the square root of their number.  Without labelled
    documents all shares are equal; a source without labelled documents has none.
    """
    hashed = lambda c: F.transform(words(c), lambda w: F.pmod(F.xxhash64(w), F.lit(FEATURES)).cast("int"))
    known = labelled.where(F.col("source").isin(sources)).select("source", hashed(F.col("text")).alias("w"))
    docs = {r["source"]: r["n"] for r in known.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not docs:
        return documents.select("doc_id", F.lit([1.0 / len(sources)] * len(sources)).alias("p"))
    counts = np.zeros((FEATURES, len(sources)))
    for r in known.select("source", F.explode("w").alias("w")).groupBy("source", "w").agg(F.count(F.lit(1)).alias("n")).collect():  # at most FEATURES rows a source
        counts[r["w"], sources.index(r["source"])] = r["n"]
    every = (counts.sum(axis=1) + 1) / (counts.sum() + FEATURES)
    like = np.log((counts + SMOOTH * every[:, None]) / (counts.sum(axis=0) + SMOOTH))
    prior = np.array([np.log(docs[s] / sum(docs.values())) if s in docs else -np.inf for s in sources])
    table = documents.sparkSession.sparkContext.broadcast((like, prior))

    @F.pandas_udf("array<double>")
    def read_(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        like, prior = table.value
        for ws in batches:
            out = []
            for w in ws:
                z = prior + like[w].sum(axis=0) / np.sqrt(len(w)) if len(w) else prior
                e = np.exp(z - z.max())
                out.append(e / e.sum())
            yield pd.Series(out)

    return documents.select("doc_id", read_(hashed(F.coalesce("text", F.lit("")))).alias("p"))


def shares_of(odds: Column) -> Column:
    total = F.aggregate(odds, F.lit(0.0), lambda s, x: s + x)
    return F.transform(odds, lambda x: x / total)


def with_name(p: Column, named: Column, sources: list[str]) -> Column:
    """Posterior shares of the sources and, last, of what nobody asks for, given the text's shares and the source named.

    Where an asked source is named, the text shares the rest among the asked ones; it says nothing of others.
    """
    slip = (1 - TRUST) / len(sources)
    told_ = F.transform(p, lambda x, i: x * F.when(F.get(F.lit(sources), i) == named, TRUST).otherwise(slip))
    odds = F.concat(told_, F.array(F.when(named.isin(sources), 0.0).otherwise(TRUST)))
    return F.when(named.isNull(), F.concat(p, F.array(F.lit(0.0)))).otherwise(shares_of(odds))


def two_likeliest(p: Column) -> Column:
    """struct<first, second, part>: the two likeliest sources (the earlier of equal ones), the second's share of both in 1 / GRAIN.

    ``second`` is -1 where its part is 0.
    """
    order = F.array_sort(F.transform(p, lambda x, i: F.struct((-x).alias("x"), i.cast("int").alias("i"))))
    a, b = F.get(order, F.lit(0)), F.get(order, F.lit(1))
    part = F.coalesce(F.round(F.try_divide(b["x"], a["x"] + b["x"]) * GRAIN).cast("int"), F.lit(0))
    return F.struct(a["i"].alias("first"), F.when(part > 0, b["i"]).otherwise(-1).alias("second"), part.alias("part"))


def memberships(units: list, sources: int) -> np.ndarray:
    """A row for each of units: posterior shares, then shares of what is named; each with what nobody asks for.

    ``named`` is the source's number, -1 for none named (then the posterior counts), -2 for one that nobody asks for.  ``p`` are the
    posterior shares of all sources; without it, those of a document of no others than (first, second, part).
    """
    u = np.zeros((len(units), 2 * (sources + 1)))
    for row, r in zip(u, units, strict=True):
        if r.get("p") is not None:
            row[: sources + 1] = r["p"]
        else:
            row[r["first"]] = 1 - r["part"] / GRAIN
            if r["part"]:
                row[r["second"]] = r["part"] / GRAIN
        if r["named"] == -1:
            row[sources + 1 :] = row[: sources + 1]
        elif r["named"] >= 0:
            row[sources + 1 + r["named"]] = 1
        else:
            row[-1] = 1
    return u


def fit_rates(u: np.ndarray, tokens: np.ndarray, cap: np.ndarray, target: np.ndarray, width: int) -> np.ndarray:
    """Rates (0 to ``cap``) of the memberships ``u`` with their ``tokens``, by projected gradient steps on squared gaps of totals.

    The first ``width`` dimensions are expected totals, the others named ones.  The last steps, on the named totals alone,
    must settle: at the targets, or where no rate can grow any more.
    """
    weight = u * tokens[:, None]
    total = weight.sum(axis=0)
    scale = np.divide(1.0, total, out=np.zeros_like(total), where=total > 0)
    r = np.zeros(len(u))
    for _ in range(STEPS):
        r = np.clip(r - u @ ((weight.T @ r - target) * scale) / 2, 0, cap)  # halved: each document is in both families
    named, gap = u[:, width:], np.inf
    for _ in range(CLOSING):
        pull = (weight[:, width:].T @ r - target[width:]) * scale[width:]
        new = np.clip(r - named @ pull, 0, cap)
        gap = np.abs(weight[:, width:].T @ (new - r)).max(initial=0.0)
        r = new
        if gap <= CLOSE * max(1.0, target.max(initial=0.0)):
            return r
    raise RuntimeError(f"a mix is not settled after {CLOSING} steps: the last moved {gap:g} tokens")


def whole_copies(rated: DataFrame) -> DataFrame:
    """(mix_id, doc_id, source, n_tokens, copies) of (mix_id, doc_id, source, n_tokens, rate, cap): rates rounded with carried error."""
    sizes = {(r["mix_id"], r["source"]): max(1, -(-r["n"] // BLOCK)) for r in rated.groupBy("mix_id", "source").agg(F.count(F.lit(1)).alias("n")).collect()}  # a number a mix and source
    keys = F.create_map(*[x for (m, s), n in sizes.items() for x in (F.lit(f"{m}/{s}"), F.lit(n))]) if sizes else F.create_map().cast("map<string,int>")
    blocks = F.coalesce(F.try_element_at(keys, F.concat_ws("/", F.col("mix_id"), F.col("source"))), F.lit(1))
    dealt = rated.withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks).cast("int"))

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id"], ascending=[False, True])
        t, r, cap = pdf["n_tokens"].to_numpy(float), pdf["rate"].to_numpy(float), pdf["cap"].to_numpy(int)
        out, owed = np.zeros(len(pdf), dtype=np.int32), 0.0
        for i in range(len(pdf)):
            owed += r[i] * t[i]
            k = min(cap[i], max(0, int(np.floor(owed / t[i] + 0.5))))
            k = min(max(k, int(np.floor(r[i]))), int(np.ceil(r[i])))
            out[i] = k
            owed -= k * t[i]
        return pdf.assign(copies=out)[["mix_id", "doc_id", "source", "n_tokens", "copies"]]

    return dealt.groupBy("mix_id", "source", "block").applyInPandas(spread, "mix_id int, doc_id bigint, source string, n_tokens bigint, copies int")


def mixed(documents: DataFrame, mixes: DataFrame, ws: Workspace, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(copies, targets, members): copies is (mix_id, doc_id, source, n_tokens, copies) with copies > 0.

    source is the one a document names, or the likeliest where it names none.  targets is (mix_id, source, target_share,
    max_repeats, target_tokens), members (doc_id, source, p): each document's shares of all sources that it has any of.
    """
    docs = ws.save(sized(documents, source_name(F.col("source")).alias("named"), vocabulary=vocabulary).where("n_tokens > 0"), "docs")
    asked = mixes.where("mix_id is not null and target_share > 0 and total_share_of_corpus > 0").groupBy("mix_id", source_name(F.col("source")).alias("source")).agg(
        F.max("target_share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("cap"), F.max("total_share_of_corpus").alias("total")).where("source is not null").collect()  # a table of a few rows
    spark = documents.sparkSession
    corpus = docs.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    goal = spark.createDataFrame([(r["mix_id"], r["source"], float(r["share"]), int(r["cap"]), float(r["share"] * r["total"] * corpus)) for r in asked], "mix_id int, source string, target_share double, max_repeats int, target_tokens double")
    none = spark.createDataFrame([], "mix_id int, doc_id bigint, source string, n_tokens bigint, copies int"), goal, spark.createDataFrame([], "doc_id bigint, source string, p array<struct<source:string,share:double>>")
    sources, ids = sorted({r["source"] for r in asked}), sorted({r["mix_id"] for r in asked})
    if not sources or not corpus:
        return none
    by = {(r["mix_id"], r["source"]): r for r in asked}
    texts = documents.where("doc_id is not null and text is not null").select("doc_id", "text", source_name(F.col("source")).alias("source"))
    soft = posteriors(texts, texts, sources)
    at = F.array_position(F.lit(sources), F.col("named")).cast("int") - 1
    code = F.when(F.col("named").isNull(), -1).when(at < 0, -2).otherwise(at)
    member = docs.join(soft, "doc_id").select("doc_id", "n_tokens", "named", code.alias("code"), with_name(F.col("p"), F.col("named"), sources).alias("p"))
    member = member.select("doc_id", "n_tokens", "p", two_likeliest(F.col("p")).alias("q"), "code", "named")
    member = member.select("doc_id", "n_tokens", "p", "q.*", "code", F.coalesce("named", F.get(F.lit(sources), F.col("q.first"))).alias("source"))
    members = ws.save(member, "members")
    key = ["first", "second", "part", "code"]
    every = range(len(sources) + 1)
    sums = F.array(*[F.sum(F.col("n_tokens") * F.get("p", F.lit(i))) for i in every])
    units = members.groupBy(*key).agg(F.sum("n_tokens").alias("tokens"), sums.alias("by")).orderBy(*key).collect()  # bounded by the number of sources, see above
    tokens = np.array([r["tokens"] for r in units], dtype=float)
    u = memberships([{"named": r["code"], "p": np.array(r["by"]) / r["tokens"]} for r in units], len(sources))
    rates = []
    for m in ids:
        caps = np.array([int(by[m, s]["cap"]) if (m, s) in by else 0 for s in sources])
        want = np.array([float(by[m, s]["share"] * by[m, s]["total"] * corpus) if (m, s) in by else 0.0 for s in sources])
        cap = np.array([[*caps, max(caps)][r["code"] if r["code"] >= 0 else r["first"]] for r in units])
        rates += [(m, *[r[k] for k in key], float(x), int(c)) for r, x, c in zip(units, fit_rates(u, tokens, cap, np.r_[want, 0.0, want, 0.0], len(sources) + 1), cap, strict=True) if x > 0]
    table = F.broadcast(spark.createDataFrame(rates, "mix_id int, first int, second int, part int, code int, rate double, cap int"))
    rated = ws.save(members.join(table, key).select("mix_id", "doc_id", "source", "n_tokens", "rate", "cap"), "rated")
    shares = F.filter(F.transform("p", lambda x, i: F.struct(F.get(F.lit([*sources, "-"]), i).alias("source"), x.alias("share"))), lambda e: e["share"] > 0)
    return whole_copies(rated).where("copies > 0"), goal, members.select("doc_id", "source", shares.alias("p"))


def p7_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"), Workspace(spark, "p7"))[0]


def share_report(copies: DataFrame, targets: DataFrame, members: DataFrame) -> DataFrame:
    """For each mix and source: target and actual tokens and shares (of the mix as planned and as it came out), repeats, shortfall.

    ``expected_share`` is the mix's share of the source by the documents' posteriors, whatever they name themselves.
    """
    tokens = F.col("n_tokens") * F.col("copies")
    got = copies.groupBy("mix_id", "source").agg(F.sum(tokens).alias("actual_tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("copies").alias("most_repeats"))
    soft = copies.drop("source").join(members.select("doc_id", "p"), "doc_id").select("mix_id", tokens.alias("t"), F.explode("p").alias("e")).groupBy("mix_id", F.col("e.source").alias("source")).agg(F.sum(F.col("t") * F.col("e.share")).alias("expected"))
    total = got.groupBy("mix_id").agg(F.sum("actual_tokens").alias("mix_tokens"))
    plan = targets.groupBy("mix_id").agg((F.sum("target_tokens") / F.sum("target_share")).alias("plan_tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    share = lambda c, of: F.coalesce(F.try_divide(zero(c), F.col(of)), F.lit(0.0))
    out = targets.join(got, ["mix_id", "source"], "left").join(soft, ["mix_id", "source"], "left").join(total, "mix_id", "left").join(plan, "mix_id")
    return out.select("mix_id", "source", "target_share", "max_repeats", "target_tokens", zero("actual_tokens").alias("actual_tokens"), share("actual_tokens", "mix_tokens").alias("actual_share"), share("actual_tokens", "plan_tokens").alias("share_of_plan"),
                      share("expected", "mix_tokens").alias("expected_share"), zero("n_docs").alias("n_docs"), zero("most_repeats").alias("most_repeats"), F.greatest(F.lit(0.0), F.col("target_tokens") - zero("actual_tokens")).alias("missing_tokens"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return share_report(*mixed(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"), Workspace(spark, "p7")))


def held_out(documents: DataFrame, sources: list[str], folds: int = 5) -> DataFrame:
    """(source, n, likeliest, mean_share): how the classifier, fitted on four fifths of the labelled documents, reads the rest.

    ``likeliest``: share of a source's documents whose likeliest source it is; ``mean_share``: mean posterior share of it.
    """
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text", source_name(F.col("source")).alias("source")).where(F.col("source").isin(sources))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(folds))
    rest = docs.where(fold == 0)
    got = posteriors(docs.where(fold != 0), rest, sources).join(rest.select("doc_id", "source"), "doc_id")
    at = F.array_position(F.lit(sources), F.col("source")).cast("int")
    return got.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg((F.array_position("p", F.array_max("p")) == at).cast("double")).alias("likeliest"), F.avg(F.element_at("p", at)).alias("mean_share"))


def p7_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = sorted({r["s"] for r in read(spark, sf_dir, "mix_targets").select(source_name(F.col("source")).alias("s")).distinct().collect() if r["s"]})  # a table of a few rows
    return held_out(read(spark, sf_dir, "documents"), sources)
