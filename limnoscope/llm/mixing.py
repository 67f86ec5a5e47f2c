"""Soft-membership mixing of documents to target weights, with DataFrame functions only.

Labelled rows say which domain some documents belong to. A linear classifier on
counts of characters (discriminant analysis: means of each domain, one variance
for each feature) is fitted from one aggregation over them and gives every
document, labelled or not, posteriors p of all domains. The rates r of documents
are then fitted so that the expected tokens of each domain, the sum of r * n * p,
meet the targets: projected gradient steps on the squared misses, each divided by
the domain's own tokens. A step is one aggregation to one number per domain.
Steps are summed before they are projected (the lazy form of the method):
``r = min(most, max(least, 1 - sum of p * move))``, which needs no exchange and
no state per document. Nothing but those numbers reaches the driver.

The moves are the same for every document, so a fitted mix is one number per
domain and can be applied to any table as a column expression.

Cases: null and empty texts have no tokens and average features; domains that are
null, and labels of unknown or null ids, are left out; a document with several
domains counts in each; repeated rows get equal rates; without any label all
documents are one domain ``""``; targets are normalised, unknown names among them
are refused; a domain without a target gets what its name says in ``targets`` as
0; more than ``MOST_DOMAINS`` domains: the smallest that no target names are one
domain ``OTHER``; an empty table gives an empty result. Columns of the input stay untouched.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnoscope.llm.common import free_names, materialise

#: Strings that are counted, and the pattern of a token.
COUNTED = (" ", "\n", ".", ",", "|", "#", "$", "%", "*", "e", "a", "o", "t", "é", "ó", "ä", "ch", "th")
TOKEN = r"[^\x20\x09-\x0D]+"
#: Domains that are told apart by themselves, and the name of all others together.
MOST_DOMAINS = 64
OTHER = "(other)"


def features(text: Column) -> list[Column]:
    """Logarithms of counts per thousand bytes, and of the number of bytes."""
    size = F.octet_length(text)
    out = [F.log1p(1000.0 * (size - F.octet_length(F.replace(text, F.lit(s), F.lit("")))) / (len(s.encode()) * F.greatest(size, F.lit(1))))
           for s in COUNTED]
    return [*out, F.log1p(size.cast("double"))]


@dataclass
class Classifier:
    domains: list[str]
    bias: list[float]
    weights: list[list[float]]

    def posteriors(self, x: list[Column]) -> list[Column]:
        """Posterior of each domain from feature columns."""
        logits = [sum((F.lit(w) * c for w, c in zip(row, x, strict=True)), F.lit(b)) for row, b in zip(self.weights, self.bias, strict=True)]
        if len(logits) == 1:
            return [F.lit(1.0)]
        top = F.greatest(*logits)
        parts = [F.exp(z - top) for z in logits]
        return [p / sum(parts[1:], parts[0]) for p in parts]


def fit_classifier(docs: DataFrame, domains: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   domain_col: str = "domain", named: Sequence[str] = ()) -> Classifier:
    """Fits on every document that ``domains`` (``id_col``, ``domain_col``) names.

    Beyond ``MOST_DOMAINS`` domains, those ``named`` and the largest ones stay and all others are one domain, ``OTHER``.
    """
    marked = (domains.select(F.col(id_col).alias("_id"), F.col(domain_col).cast("string").alias("_domain"))
              .where("_id is not null and _domain is not null").dropDuplicates())
    x = features(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    names = [f"_x{i}" for i in range(len(x))]
    # features before the join: numbers move, texts do not
    rows = docs.select(F.col(id_col).alias("_id"), *[c.alias(n) for c, n in zip(x, names, strict=True)]).join(marked, "_id")
    largest = (rows.groupBy("_domain").agg(F.count("*").alias("n"))
               .orderBy(F.desc(F.col("_domain").isin(list(named))), F.desc("n"), "_domain")
               .limit(max(MOST_DOMAINS, len(named)) + 1).collect())
    if len(largest) > max(MOST_DOMAINS, len(named)):
        own = [r._domain for r in largest[:-2]] if len(named) < MOST_DOMAINS else list(named)
        rows = rows.withColumn("_domain", F.when(F.col("_domain").isin(own), F.col("_domain")).otherwise(F.lit(OTHER)))
    sums = (rows.groupBy("_domain").agg(F.count("*").alias("n"), *[F.sum(n).alias(n) for n in names],
                                        *[F.sum(F.col(n) * F.col(n)).alias("s" + n) for n in names])
            .orderBy("_domain").collect())  # one short row a domain
    if not sums:
        return Classifier([""], [0.0], [[0.0] * len(names)])
    total = sum(r.n for r in sums)
    mean = [[r[n] / r.n for n in names] for r in sums]
    spread = [max(sum(r["s" + n] - r.n * m[i] ** 2 for r, m in zip(sums, mean, strict=True)) / total, 1e-3) for i, n in enumerate(names)]
    weights = [[m[i] / spread[i] for i in range(len(names))] for m in mean]
    bias = [math.log(r.n / total) - sum(m[i] ** 2 / spread[i] for i in range(len(names))) / 2 for r, m in zip(sums, mean, strict=True)]
    return Classifier([r._domain for r in sums], bias, weights)


def _rate(moves: list[float] | list[Column], posteriors: list[str], least: float, most: float) -> Column:
    """The rate 1, moved against the misses and projected, from the names of the posterior columns."""
    move = sum((F.lit(m) * F.col(p) for m, p in zip(moves, posteriors, strict=True)), F.lit(0.0))
    return F.least(F.lit(float(most)), F.greatest(F.lit(float(least)), F.lit(1.0) - move))


@dataclass
class Mix:
    """A fitted mix: the classifier, the summed moves along each posterior, bounds of a rate, targets and totals reached."""

    classifier: Classifier
    moves: list[float]
    least: float
    most: float
    targets: dict[str, float]
    reached: dict[str, float]

    def apply(self, docs: DataFrame, text_col: str = "text", rate_col: str = "_rate") -> DataFrame:
        """``docs`` with ``rate_col``, the fitted rate of each row."""
        x = features(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
        names = free_names(docs, *[f"_x{i}" for i in range(len(x))])
        rows = docs.select("*", *[c.alias(n) for c, n in zip(x, names, strict=True)])
        posteriors = self.classifier.posteriors([F.col(n) for n in names])
        shares = free_names(docs, *[f"_p{k}" for k in range(len(posteriors))])
        rows = rows.select(*docs.columns, *[c.alias(n) for c, n in zip(posteriors, shares, strict=True)])
        return rows.select(*docs.columns, _rate(self.moves, shares, self.least, self.most).alias(rate_col))

    def repeat(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``docs`` with every row as often as its rate says; the fraction is decided by a hash of id and text."""
        chance = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 20)) / float(1 << 20)
        rate, each, time = free_names(docs, "_rate", "_times", "_time")
        times = F.floor(F.col(rate) + chance).cast("int")
        return (self.apply(docs, text_col, rate).withColumn(each, F.array_repeat(F.lit(0), times))
                # explode would first filter on the whole rate, written out over the features: more code than Java compiles
                .select(*docs.columns, F.explode_outer(each).alias(time)).where(F.col(time).isNotNull()).drop(time))


def measured(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens and the posteriors p0, p1, ..."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    x = features(text)
    names = [f"_x{i}" for i in range(len(x))]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.regexp_count(text, F.lit(TOKEN)).cast("long").alias("n_tokens"),
                       *[c.alias(n) for c, n in zip(x, names, strict=True)])
    p = classifier.posteriors([F.col(n) for n in names])
    return rows.select("doc_id", "n_tokens", *[c.alias(f"p{k}") for k, c in enumerate(p)])


def fit_mix(docs: DataFrame, domains: DataFrame, targets: dict[str, float] | None = None, budget: float = 1.0,
            least: float = 0.0, most: float = 16.0, rounds: int = 40, tolerance: float = 1e-4, id_col: str = "doc_id",
            text_col: str = "text") -> tuple[Mix, DataFrame]:
    """The mix, and one row per document with n_tokens, posteriors and ``rate``.

    ``targets`` are weights of domains; without them a domain's weight is the
    square root of its expected tokens. The targets' tokens add up to ``budget``
    times the documents' tokens. It ends when no domain misses its target by more
    than ``tolerance`` of all tokens, when a step moves none by more than a fifth
    of that (bounds on rates can put targets out of reach), or after ``rounds`` steps.
    """
    classifier = fit_classifier(docs, domains, id_col, text_col, named=tuple(targets or ()))
    k = len(classifier.domains)
    if targets is not None and set(targets) - set(classifier.domains):
        raise ValueError(f"no such domains: {sorted(set(targets) - set(classifier.domains))}")
    rows = materialise(measured(docs, classifier, id_col, text_col))
    shares = [f"p{i}" for i in range(k)]

    def totals(moves: list[float] | None) -> list[float]:
        rate, given = F.lit(1.0), rows
        if moves is not None:
            # moves come as a row, not as literals: all steps share one compiled plan, and the driver's memory does not grow with them
            names = [f"_m{i}" for i in range(k)]
            row = docs.sparkSession.sql(f"VALUES ({', '.join(f'{m!r}D' for m in moves)})").toDF(*names)
            rate, given = _rate([F.col(n) for n in names], shares, least, most), rows.crossJoin(F.broadcast(row))
        r = given.agg(*[F.coalesce(F.sum(rate * F.col("n_tokens") * F.col(f"p{i}")), F.lit(0.0)).alias(f"t{i}") for i in range(k)]).first()
        return [float(v) for v in r]

    own = totals(None)
    everything = max(sum(own), 1e-9)
    weights = [math.sqrt(t) for t in own] if targets is None else [float(targets.get(d, 0.0)) for d in classifier.domains]
    wanted = [budget * everything * w / max(sum(weights), 1e-9) for w in weights]
    moves = [0.0] * k
    reached = totals(moves)
    for _ in range(rounds):
        if max(abs(a - b) for a, b in zip(reached, wanted, strict=True)) <= tolerance * everything:
            break
        miss = [(a - b) / max(t, 1e-9 * everything) for a, b, t in zip(reached, wanted, own, strict=True)]
        moves = [v + max(-1e6, min(1e6, m)) for v, m in zip(moves, miss, strict=True)]
        before, reached = reached, totals(moves)
        if max(abs(a - b) for a, b in zip(before, reached, strict=True)) <= tolerance * everything / 5:
            break
    names = classifier.domains
    mix = Mix(classifier, moves, float(least), float(most), dict(zip(names, wanted, strict=True)), dict(zip(names, reached, strict=True)))
    return mix, rows.withColumn("rate", _rate(moves, shares, least, most))
