"""Quality and toxicity by hierarchical empirical Bayes.

A logistic regression over hashed words and shapes gives each document's own
evidence for quality and for toxicity.  Host (source) and path (source and language)
rates are posteriors: a path's expected positives are shrunk toward its host's
rate and a host's toward the global rate, with prior strengths estimated from
how rates vary (method of moments).  The document's log odds are its evidence
plus those of its path without the document itself, so that nothing counts
twice.  Sites are summed by grouped aggregation, so a host
with a third of all rows is one row before it is shuffled; their table is
joined back.

The classifier is fitted on at most ``LABELLED_ROWS`` labelled documents, drawn
by a hash; its table has ``BUCKETS`` counts for each class, which bounds what is
broadcast.  Site statistics cover all documents.

Edge cases: a null text counts as empty and gives evidence 0; null hosts and
languages are sites of their own; labels that repeat or are null count once or
not at all; repeated rows are scored one by one; without any label all
probabilities come from a prior of one half; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import cut, documents, lower_ascii, slices, words

LABELLED_ROWS = 20_000
BUCKETS = 1 << 16
LEAST_ROWS = 5
#: Evidence is limited to this many nats, so that sites still count.
MOST_EVIDENCE = 12.0
TARGETS = ("quality", "toxic")
SEED = 23


def features(text: str) -> np.ndarray:
    """Buckets of a text's distinct words, and of shapes that occur in it: marks within words, capitals, repeats."""
    tokens = words(text)
    if not tokens:
        return np.zeros(0, np.int64)
    n = len(tokens)
    marks = sum(not c.isalnum() and not c.isspace() for c in text)
    same = sum(a == b for a, b in zip(tokens, tokens[1:]))
    upper = sum(w.isupper() and len(w) > 1 for w in tokens)
    shapes = [f"\n{name}{min(9, 10 * value // n)}" for name, value in (("marks", marks), ("same", same), ("upper", upper), ("distinct", len(set(tokens))))]
    shapes.append(f"\nlength{int(np.log2(n))}")
    found = {xxhash.xxh64_intdigest(w.strip(".,!?;:#*$%&|")) % BUCKETS for w in set(lower_ascii(text).split())}
    return np.fromiter(found | {xxhash.xxh64_intdigest(s) % BUCKETS for s in shapes}, np.int64)


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> np.ndarray:
    """Weights (target, bucket) of a logistic regression on the drawn labelled rows, then the bias and the log odds of the sample."""
    known = labels.groupBy("doc_id").agg(*[F.max(t).alias(t) for t in TARGETS]).where(F.col("doc_id").isNotNull())
    total = known.count()
    share = min(1.0, rows / total) if total else 1.0
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_000)) < int(share * 1_000_000))
    joined = docs.select("doc_id", "text").join(drawn, "doc_id").select("doc_id", "text", *TARGETS)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = [features(t or "").astype(np.int32) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int32())), *(batch.column(c) for c in ("doc_id", *TARGETS))], names=["at", "doc_id", *TARGETS])

    schema = f"at array<int>, doc_id {joined.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{t} {joined.schema[t].dataType.simpleString()}" for t in TARGETS)
    sample = sorted(((r.doc_id, np.array(r.at, np.int64), *(r[t] for t in TARGETS)) for r in joined.mapInArrow(found, schema).toLocalIterator()), key=lambda r: (r[0], len(r[1])))
    return np.stack([_logistic([(r[1], r[2 + k]) for r in sample if r[2 + k] is not None]) for k in range(len(TARGETS))])


def _logistic(sample: list[tuple[np.ndarray, int]], epochs: int = 6, rate: float = 0.2, penalty: float = 1e-4) -> np.ndarray:
    """AdaGrad over the rows in an order that a fixed seed shuffles; words of fewer than LEAST_ROWS rows are left out."""
    weights = np.zeros(BUCKETS + 2)
    if not sample:
        return weights
    rows = np.bincount(np.concatenate([at for at, _ in sample] or [[0]]).astype(np.int64), minlength=BUCKETS)
    kept = [(np.append(at[rows[at] >= LEAST_ROWS], BUCKETS), float(y > 0)) for at, y in sample]
    mean = (sum(y for _, y in kept) + 0.5) / (len(kept) + 1)
    weights[BUCKETS:] = np.log(mean / (1 - mean))
    power = np.full(BUCKETS + 1, 1e-3)
    rng = np.random.default_rng(SEED)
    for _ in range(epochs):
        for k in rng.permutation(len(kept)):
            at, y = kept[k]
            step = y - 1 / (1 + np.exp(-np.clip(weights[at].sum(), -30, 30)))
            change = step - penalty * weights[at]
            power[at] += change**2
            weights[at] += rate * change / np.sqrt(power[at])
    return weights


def evidence(docs: DataFrame, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep`` columns and the evidence (log odds ratio, limited) of every document for each target."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value[:, :BUCKETS]
        # The regression's bias less the log odds of its sample: with rates of sites added, scores stay calibrated.
        lift = shared.value[:, BUCKETS] - shared.value[:, BUCKETS + 1]
        for batch in slices(batches):
            out = np.zeros((len(TARGETS), batch.num_rows))
            for row, text in enumerate(batch.column("text").to_pylist()):
                out[:, row] = table[:, features(text or "")].sum(axis=1) + lift
            out = np.clip(out, -MOST_EVIDENCE, MOST_EVIDENCE)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *map(pa.array, out)], names=[*keep, *(f"{t}_evidence" for t in TARGETS)])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(weighed, kinds + "".join(f", {t}_evidence double" for t in TARGETS))


def strength(rates: DataFrame, rate: str, n: str, prior: str) -> float:
    """Prior strength by the method of moments: how much rates vary beyond what their sizes explain."""
    p, m = F.col(prior), F.col(n)
    row = rates.where(m > 1).agg(F.sum(m * F.pow(F.col(rate) - p, 2)), F.sum(p * (1 - p)), F.sum(m), F.count("*"), F.sum(m * p * (1 - p))).first()
    if not row[3] or not row[2] or not row[4]:
        return 10.0
    within = row[4] / row[2]
    between = (row[0] - row[1]) / row[2]
    return float(min(1e6, max(1.0, within / between - 1))) if between > 0 else 1e6


def expected_positives(weighed: DataFrame, labels: DataFrame) -> DataFrame:
    """``weighed`` with a column for each target: the document's label, or else the probability that its own evidence gives at the global rate."""
    known = labels.groupBy("doc_id").agg(*[F.max(t).alias(f"_{t}") for t in TARGETS])
    joined = weighed.join(known, "doc_id", "left")
    base = known.agg(*[((F.sum(f"_{t}") + 0.5) / (F.count(f"_{t}") + 1)).alias(t) for t in TARGETS]).first()
    prior = {t: base[t] if base[t] is not None else 0.5 for t in TARGETS}
    expected = [F.coalesce(F.col(f"_{t}").cast("double"), 1 / (1 + F.exp(-(F.col(f"{t}_evidence") + F.log(F.lit(prior[t] / (1 - prior[t]))))))).alias(f"{t}_expected") for t in TARGETS]
    return joined.select(weighed["*"], *expected)


def posteriors(expected: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """(host, path, and for each target host_rate and path_rate) of every site, and the sums and strengths that they come from."""
    sites = cut(expected.groupBy(host, path).agg(F.count("*").alias("n"), *[F.sum(f"{t}_expected").alias(t) for t in TARGETS]), "sites")
    whole = sites.agg(F.sum("n").alias("n"), *[F.sum(t).alias(t) for t in TARGETS]).first()
    hosts = sites.groupBy(host).agg(F.sum("n").alias("host_n"), *[F.sum(t).alias(f"host_{t}") for t in TARGETS])
    for t in TARGETS:
        world = (whole[t] or 0.0) / whole["n"] if whole["n"] else 0.5
        world = min(max(world, 1e-6), 1 - 1e-6)
        hosts = hosts.withColumn("_world", F.lit(world))
        k = strength(hosts.withColumn("_rate", F.col(f"host_{t}") / F.col("host_n")), "_rate", "host_n", "_world")
        hosts = hosts.withColumn(f"{t}_host_rate", (F.col(f"host_{t}") + k * world) / (F.col("host_n") + k))
        hosts = hosts.withColumn(f"{t}_host_prior", F.lit(k * world)).withColumn(f"{t}_host_strength", F.lit(k))
    joined_sites = sites.alias("s").join(hosts.alias("h"), F.col(f"s.{host}").eqNullSafe(F.col(f"h.{host}"))).select("s.*", "h.host_n", *[f"h.{c}" for t in TARGETS for c in (f"host_{t}", f"{t}_host_rate", f"{t}_host_prior", f"{t}_host_strength")])
    for t in TARGETS:
        k = strength(joined_sites.withColumn("_rate", F.col(t) / F.col("n")), "_rate", "n", f"{t}_host_rate")
        joined_sites = joined_sites.withColumn(f"{t}_path_rate", (F.col(t) + k * F.col(f"{t}_host_rate")) / (F.col("n") + k)).withColumn(f"{t}_path_strength", F.lit(k))
    return joined_sites


def rate_without(target: str) -> Column:
    """The path's rate for a document of ``expected_positives`` joined with its site, the document itself left out of path and host."""
    own = F.col(f"{target}_expected")
    host = (F.col(f"host_{target}") - own + F.col(f"{target}_host_prior")) / (F.col("host_n") - 1 + F.col(f"{target}_host_strength"))
    strength_ = F.col(f"{target}_path_strength")
    return (F.col(target) - own + strength_ * host) / (F.col("n") - 1 + strength_)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weighed = cut(evidence(docs, fit(docs, labels), ["doc_id", "source", "lang"]), "evidence")
    weighed = cut(expected_positives(weighed, labels), "expected")
    sites = posteriors(weighed)
    same = weighed["source"].eqNullSafe(sites["source"]) & weighed["lang"].eqNullSafe(sites["lang"])
    joined = weighed.join(sites, same).select(weighed["*"], *[sites[c] for c in sites.columns if c not in ("source", "lang")])
    for t in TARGETS:
        rate = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), rate_without(t)))
        joined = joined.withColumn(f"{t}_probability", 1 / (1 + F.exp(-(F.col(f"{t}_evidence") + F.log(rate / (1 - rate))))))
    kept = (F.col("quality_probability") >= 0.5) & (F.col("toxic_probability") < 0.5)
    return joined.select("doc_id", "source", "lang", *[f"{t}_{part}" for t in TARGETS for part in ("evidence", "host_rate", "path_rate", "probability")], kept.alias("kept"))
