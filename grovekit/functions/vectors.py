"""Small fixed-length vectors (class probabilities, embeddings) as array<double> expressions (PRJ-05..13, 22, 24, 25)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def normalise(p: Column, eps: float = 1e-9) -> Column:
    """Nonnegative parts scaled to sum 1; equal shares where there is no evidence."""
    pos = F.transform(p, lambda x: F.greatest(x, F.lit(0.0)))
    s = total(pos)
    return F.when(s > eps, F.transform(pos, lambda x: x / F.greatest(s, F.lit(eps)))).otherwise(F.transform(p, lambda x: F.lit(1.0) / F.size(p)))


def argmax(p: Column) -> Column:
    """Index of the largest entry, the first of equal ones."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def entropy(p: Column) -> Column:
    return -total(F.transform(p, lambda x: F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0))))


def margin(p: Column) -> Column:
    s = F.array_sort(p)
    return F.element_at(s, -1) - F.element_at(s, -2)


def bhattacharyya(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.sqrt(x * y)))


def l1(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def cosine(a: Column, b: Column, eps: float = 1e-12) -> Column:
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(eps))


def chi_square(a: Column, b: Column) -> Column:
    return 0.5 * total(F.zip_with(a, b, lambda x, y: F.when(x + y > 0, (x - y) * (x - y) / (x + y)).otherwise(F.lit(0.0))))


def common_mass(a: Column, b: Column) -> Column:
    """Histogram intersection."""
    return total(F.zip_with(a, b, lambda x, y: F.least(x, y)))


def jensen_shannon(a: Column, b: Column) -> Column:
    def kl(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.ln(x / m)).otherwise(F.lit(0.0))

    return 0.5 * total(F.zip_with(a, b, lambda x, y: kl(x, (x + y) / 2) + kl(y, (x + y) / 2)))


def expectation(p: Column) -> Column:
    """Ordinal expectation: the sum of k times p_k."""
    return F.aggregate(F.transform(p, lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)


def ordinal_class(g: Column, cuts: list[float]) -> Column:
    """Number of cuts below g; a value at a cut stays below it."""
    out = F.lit(0)
    for c in cuts:
        out = out + (g > c).cast("int")
    return out


def power(p: Column, gamma: float) -> Column:
    return normalise(F.transform(p, lambda x: F.pow(x, F.lit(gamma))))


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    z = F.transform(logits, lambda x: F.exp((x - F.array_max(logits)) / temperature))
    return F.transform(z, lambda x: x / total(z))


def blend(a: Column, b: Column, w: float) -> Column:
    return F.zip_with(a, b, lambda x, y: (1 - w) * x + w * y)


def reweight(p: Column, prior: list[float], exponent: float) -> Column:
    return F.zip_with(p, F.lit([float(v) ** exponent for v in prior]), lambda x, y: x * y)


def fuse_opinions(a: Column, s: Column, prior: list[float], w: float, eps: float = 1e-9) -> Column:
    """softmax(log a + w (log s - log prior)): two opinions without counting the prior twice."""
    la = F.transform(a, lambda x: F.ln(F.greatest(x, F.lit(eps))))
    ls = F.zip_with(s, F.lit(prior), lambda x, q: F.ln(F.greatest(x, F.lit(eps))) - F.ln(q))
    return softmax(F.zip_with(la, ls, lambda x, y: x + w * y))


def blur(p: Column, matrix: list[list[float]]) -> Column:
    """p times a square matrix (row k says where class k's mass goes)."""
    out = [F.lit(0.0)] * len(matrix)
    for k, row in enumerate(matrix):
        out = [o + F.get(p, k) * F.lit(float(v)) for o, v in zip(out, row, strict=True)]
    return F.array(*out)


def one_hot(cls: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: (k == cls).cast("double"))


def soft_one_hot(cls: Column, score: Column, classes: int) -> Column:
    """The score on its class, the rest spread evenly over the others."""
    rest = (1 - score) / (classes - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.when(k == cls, score).otherwise(rest))


def from_cumulative(c: Column) -> Column:
    """Class probabilities from P(y > 0), P(y > 1) …, made falling, differences clipped at 0 and normalised."""
    run = F.transform(F.sequence(F.lit(1), F.size(c)), lambda i: F.array_min(F.slice(c, F.lit(1), i)))
    ext = F.concat(F.array(F.lit(1.0)), run, F.array(F.lit(0.0)))
    return normalise(F.transform(F.sequence(F.lit(0), F.size(c)), lambda i: F.get(ext, i) - F.get(ext, i + 1)))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return F.ln(q / (1 - q))
