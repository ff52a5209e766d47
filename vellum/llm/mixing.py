"""Mixing to target weights: soft domain membership by a classifier, document rates by projected gradients.

Native throughout: joins, aggregates and higher-order functions only; the driver holds K numbers a step.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontaminate import words
from .shared import Scratch


def solve(m: list[list[float]], b: list[float]) -> list[float]:
    """x with m x = b, by elimination with pivots (K by K, K the number of domains)."""
    k = len(b)
    a = [[*row, y] for row, y in zip(m, b, strict=True)]
    for i in range(k):
        p = max(range(i, k), key=lambda r: abs(a[r][i]))
        a[i], a[p] = a[p], a[i]
        for r in range(i + 1, k):
            by = a[r][i] / a[i][i]
            a[r] = [x - by * y for x, y in zip(a[r], a[i], strict=True)]
    x = [0.0] * k
    for i in reversed(range(k)):
        x[i] = (a[i][k] - sum(a[i][j] * x[j] for j in range(i + 1, k))) / a[i][i]
    return x


def domain_posteriors(
    docs: DataFrame, labelled: DataFrame, domains: list[str], scratch: Scratch, id_col: str, text_col: str, buckets: int, most_labelled: int, evidence: int
) -> DataFrame:
    """(id, n_tokens, p: array of posteriors in the order of domains) for each row of docs.

    Naive Bayes over words hashed to a fixed number of buckets, fitted on at most most_labelled rows of labelled
    (id, domain), by the hash of the id. A text's evidence counts as that of at most so many words, so that
    memberships stay soft. Without labelled rows all posteriors are equal.
    """
    one = labelled.where(F.col(id_col).isNotNull() & F.col("domain").isin(domains)).groupBy(id_col).agg(F.min("domain").alias("domain"))
    sample = one.orderBy(F.xxhash64(id_col), id_col).limit(most_labelled)
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")
    seen = docs.select(F.col(id_col), words(F.col(text_col)).alias("w")).join(F.broadcast(sample), id_col)
    counts = seen.select("domain", F.explode("w").alias("word")).groupBy("domain", bucket("word").alias("bucket")).agg(F.count("*").alias("n"))
    counts = scratch.put(counts, "counts")
    totals = {r["domain"]: r["n"] for r in counts.groupBy("domain").agg(F.sum("n").alias("n")).collect()}
    priors = {r["domain"]: r["n"] for r in seen.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    rows = sum(priors.values())
    wide = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts.groupBy("bucket").pivot("domain", domains).agg(F.sum("n")), "bucket", "left")
    weight = lambda d: F.log((F.coalesce(F.col(f"`{d}`"), F.lit(0)) + 1) / (totals.get(d, 0) + buckets))
    weights = wide.select("bucket", *(weight(d).alias(f"w{k}") for k, d in enumerate(domains)))
    base = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("rid"), words(F.col(text_col)).alias("w"))
    each = base.select("id", "rid", F.explode_outer("w").alias("word")).withColumn("bucket", bucket("word"))
    summed = each.join(F.broadcast(scratch.put(weights, "weights")), "bucket", "left").groupBy("rid", "id").agg(
        F.count("word").alias("n_tokens"), *(F.coalesce(F.sum(f"w{k}"), F.lit(0.0)).alias(f"s{k}") for k in range(len(domains)))
    )
    share = F.least(F.lit(1.0), F.lit(float(evidence)) / F.greatest("n_tokens", F.lit(1)))
    logs = [F.log(F.lit((priors.get(d, 0) + 1) / (rows + len(domains)))) + share * F.col(f"s{k}") for k, d in enumerate(domains)]
    raised = summed.select("id", "n_tokens", F.array(*logs).alias("l"))
    exps = F.transform("l", lambda x: F.exp(x - F.array_max("l")))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    posterior = raised.select("id", "n_tokens", exps.alias("e")).select("id", "n_tokens", F.transform("e", lambda x: x / total).alias("p"))
    return scratch.put(posterior, "posteriors")


def stepped(rate: Column, before: Column, p: Column, history: list[tuple[float, list[float]]]) -> Column:
    """(now, before): the rate and the one before it, after the steps in history.

    A step (push, g) leaves y = now + push * (now - before) for max(0, y - p . g).
    """
    start = F.struct(rate.alias("now"), before.alias("before"))
    if not history:
        return start
    steps = F.array(*(F.struct(F.lit(push).alias("push"), F.array(*(F.lit(x) for x in g)).alias("g")) for push, g in history))
    dot = lambda g: F.aggregate(F.zip_with(p, g, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    ahead = lambda r, s: r["now"] + s["push"] * (r["now"] - r["before"])
    return F.aggregate(steps, start, lambda r, s: F.struct(F.greatest(F.lit(0.0), ahead(r, s) - dot(s["g"])).alias("now"), r["now"].alias("before")))


def expected(mixed: DataFrame, targets: dict[str, float], tokens: float = 0.5) -> DataFrame:
    """(domain, target, expected) tokens of the rates that mix() gave: how far from its targets it ended."""
    domains, whole = sorted(targets), sum(targets.values())
    t = F.col("n_tokens").cast("double")
    sums = mixed.agg(F.sum(t).alias("t"), *(F.sum(t * F.element_at("p", i + 1) * F.col("rate")).alias(f"x{i}") for i in range(len(domains))))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    each = [F.struct(F.lit(d).alias("domain"), zero(F.col("t") * (tokens * targets[d] / whole)).alias("target"), zero(F.col(f"x{i}")).alias("expected")) for i, d in enumerate(domains)]
    return sums.select(F.inline(F.array(*each)))


def mix(
    docs: DataFrame,
    labelled: DataFrame,
    targets: dict[str, float],
    tokens: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = 4096,
    most_labelled: int = 20_000,
    evidence: int = 40,
    steps: int = 200,
    tolerance: float = 1e-6,
    every: int = 8,
) -> DataFrame:
    """One row for each row of docs: id, n_tokens (words), p (posteriors, in the order of sorted(targets)), rate >= 0.

    The rates make the expected tokens of each domain, sum(rate * n_tokens * p), meet its target: its share of
    targets (weights, scaled to 1) of tokens times the corpus. They minimise the squared residuals, weighted by
    the inverse of M = sum(n_tokens * p p'), over rates >= 0: in the metric of n_tokens the gradient is p . M^-1
    residual and the step length is 1. Steps are accelerated: each starts beyond the last rates, in the direction
    they took, and this begins anew when the residuals grow. Each step is one sum over the table of posteriors; a
    document's rate is a fold over the directions so far, written to the shared folder every few steps. It ends
    when no residual exceeds tolerance times the total, when twenty steps gain less than a thousandth, or after so
    many steps; in the last two cases it warns of the largest residual, and expected() gives them all.

    Null and wordless texts have no tokens and posteriors of the priors. labelled has id_col and domain: null
    ids and other domains are not used, of several domains of an id the first by name counts. Repeated rows
    and ids each get a rate. Extra columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    domains = sorted(targets)
    k = len(domains)
    table = domain_posteriors(docs, labelled, domains, scratch, id_col, text_col, buckets, most_labelled, evidence)
    p = [F.element_at("p", i + 1) for i in range(k)]
    t = F.col("n_tokens").cast("double")
    got = table.agg(F.coalesce(F.sum(t), F.lit(0.0)).alias("t"), *(F.coalesce(F.sum(t * p[i] * p[j]), F.lit(0.0)).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k))).collect()[0]
    corpus = got["t"]
    start = float(tokens)
    out = table.withColumn("rate", F.lit(start))
    if corpus > 0:
        gram = [[got[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]
        ridge = 1e-9 * sum(gram[i][i] for i in range(k)) / k
        gram = [[x + (ridge if i == j else 0) for j, x in enumerate(row)] for i, row in enumerate(gram)]
        whole = sum(targets.values())
        want = [corpus * start * targets[d] / whole for d in domains]
        state, history = out.withColumn("before", F.col("rate")), []
        written, errors, pace, old = None, [], 1.0, None
        for step in range(steps + 1):
            rate = stepped(F.col("rate"), F.col("before"), F.col("p"), history)["now"]
            now = state.select("n_tokens", "p", rate.alias("rate"))
            sums = now.agg(*(F.sum(t * p[i] * F.col("rate")).alias(f"x{i}") for i in range(k))).collect()[0]
            residual = [sums[f"x{i}"] - want[i] for i in range(k)]
            worst = max(map(abs, residual))
            direction = solve(gram, residual)
            errors.append(sum(x * y for x, y in zip(direction, residual, strict=True)))
            met = worst <= tolerance * corpus * start
            if met or step == steps or (step >= 20 and errors[-1] > errors[-21] * (1 - 1e-3)):
                if not met:
                    warnings.warn(f"mixing ended after {step} steps with targets missed by up to {worst / (corpus * start):.2g} of all tokens", stacklevel=2)
                break
            if step and errors[-1] > errors[-2]:
                pace = 1.0
            faster = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
            push, pace = (pace - 1) / faster, faster
            # Sums are linear in the rates, so those of the starting point need no pass of their own.
            ahead = [x + push * (x - y) for x, y in zip(residual, old or residual, strict=True)]
            history.append((push, solve(gram, ahead)))
            old = residual
            if len(history) == every:
                both = stepped(F.col("rate"), F.col("before"), F.col("p"), history)
                new = scratch.put(state.withColumn("both", both).select("id", "n_tokens", "p", F.col("both.now").alias("rate"), F.col("both.before").alias("before")), "rates")
                if written is not None:
                    scratch.drop(written)
                state, written, history = new, new, []
        out = state.withColumn("rate", stepped(F.col("rate"), F.col("before"), F.col("p"), history)["now"])
    return out.select(F.col("id").alias(id_col), "n_tokens", "p", "rate")


def label_domains(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The domains of the labelled table: toxic, low (quality 0) or good."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")
    return labels.select(F.col(id_col), domain.alias("domain"))
