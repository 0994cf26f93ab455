import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from gristmill.llm import bpe, mixing, quality_model, quality_rules, simhash
from tests.llm import cases


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Share by weight, stop at the cap, share the excess again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, target, open_ = float(sum(sizes.values())), dict.fromkeys(sizes, 0.0), set(sizes)
    while open_:
        rest = total - sum(target[s] for s in sizes if s not in open_)
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s] + 1e-9}
        for s in over or open_:
            target[s] = most * sizes[s] if over else share[s]
        open_ = open_ - over if over else set()
    return target


def test_mix_meets_its_targets(spark, tmp_path):
    folder = cases.save(spark, tmp_path, 120)
    rows = [tuple(r[:5]) for r in mixing.op1_mixing(spark, folder).collect()]
    assert Counter(rows) == Counter(tuple(r[:5]) for r in mixing.op1_mixing(spark, folder).collect())
    source, size = {}, {}
    for r in cases.rows(120):
        source[r[0]], size[r[0]] = r[3], len(re.findall(r"[^\x20\x09-\x0d]+", r[1] or ""))
    wholes, taken, target = Counter(), Counter(), {}
    for doc, n, _, goal, took in rows:
        assert n == size[doc] and took <= 3 * n and (n == 0) <= (took == 0)
        wholes[source[doc]] += n
        taken[source[doc]] += took
        target[source[doc]] = goal
    assert all(r[2] == wholes[source[r[0]]] for r in rows)
    expected = brute_targets(wholes)
    for s in wholes:
        assert target[s] == pytest.approx(expected[s])
        assert abs(taken[s] - target[s]) <= 5
    assert mixing.op1_mixing(spark, cases.save(spark, tmp_path / "none", empty=True)).count() == 0


def test_knapsack_is_nearest_from_below():
    rng = random.Random(4)
    for _ in range(60):
        lengths = rng.sample(range(1, 40), 4)
        counts = [rng.randint(0, 3) for _ in lengths]
        budget = rng.randint(0, 150)
        found = mixing.knapsack(lengths, counts, budget)
        assert all(found.get(i, 0) <= counts[i] for i in range(4))
        sums = (sum(n * k for n, k in zip(lengths, ks)) for ks in itertools.product(*[range(c + 1) for c in counts]))
        assert sum(lengths[i] * k for i, k in found.items()) == max(s for s in sums if s <= budget)


def test_fit_of_a_large_budget_stays_near():
    rng = random.Random(5)
    lengths = list(range(1, 3000))
    counts = [rng.randint(0, 50) for _ in lengths]
    budget = sum(n * c for n, c in zip(lengths, counts)) // 3
    got = mixing.fit(lengths, counts, budget)
    assert all(0 <= k <= c for k, c in zip(got, counts)) and budget - sum(n * k for n, k in zip(lengths, got)) in range(3)


def test_fit_of_very_long_documents():
    assert mixing.fit([3000001, 2999999, 5000003], [1, 1, 1], 5400000) == [0, 0, 1]
    rng = random.Random(6)
    lengths = [rng.randint(70_000, 400_000) for _ in range(12)]
    budget = sum(lengths) // 2
    got = mixing.fit(lengths, [1] * 12, budget)
    best = max(s for s in (sum(n for n, k in zip(lengths, ks) if k) for ks in itertools.product((0, 1), repeat=12)) if s <= budget)
    assert all(k in (0, 1) for k in got) and best - sum(n * k for n, k in zip(lengths, got)) <= 200


def test_mixed_documents_keep_columns_and_copies(spark):
    docs = cases.documents(spark, 80)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.where("target <> 0.5 OR copies <> 4 OR source_size <> 3 OR size <> 7").isEmpty()
    times = Counter((r.doc_id, r.text) for r in out.collect())
    assert max(times.values()) <= 6 and all(t for (_, t) in times)


def jaccard(a, b):
    return len(a & b) / len(a | b)


def near_copies(seed=2, groups=40):
    """Each group: a text of 150 to 400 words, an exact copy, one with a word changed and one with a tail added."""
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("river", "stone", "cloud", "paper", "glass", "metal", "field", "north") for b in range(400)]
    rows = []
    for g in range(groups):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(150, 400))]
        changed = [*words]
        changed[rng.randrange(len(words))] = "changed"
        for k, version in enumerate((words, words, changed, [*words, "added", "tail"])):
            rows.append((10 * g + k, " ".join(version), "en", "s", *cases.CLASHING, *cases.MORE))
    return rows


def test_one_document_of_each_near_group_stays(spark):
    rows = near_copies()
    out = simhash.drop_near_duplicates(spark.createDataFrame([*rows, rows[0]], cases.SCHEMA))
    assert sorted(r.doc_id for r in out.collect()) == [10 * g for g in range(40)]
    clean = [(k, r[1], *r[2:]) for k, r in enumerate(rows) if r[0] % 10 == 0]
    assert simhash.drop_near_duplicates(spark.createDataFrame(clean, cases.SCHEMA)).count() == len(clean)
    assert simhash.drop_near_duplicates(cases.none(spark)).count() == 0


def test_pipeline_equals_its_stages_and_handles_an_empty_table(spark, tmp_path):
    folder = cases.save(spark, tmp_path, 80)
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.keep_good_documents(spark, docs, folder)
    judged = quality_rules.op4_quality_rules(spark, folder).where("kept")
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in judged.collect())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == cases.documents(spark).columns
    expected = Counter(r.doc_id for r in docs.collect())
    out = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r.doc_id for r in out) == expected and expected
    model = bpe.Model.load(bpe.tokenizer_path())
    assert all(r.n_tokens == len(r.ids) and model.decode(r.ids) for r in out)
    nothing = cases.save(spark, tmp_path / "none", empty=True)
    assert corpus_pipeline.run(spark, nothing).count() == 0


def labelled(count, seed):
    """Good and bad documents of different words; hosts differ in how many are good, and some hosts are sparse."""
    rng = random.Random(seed)
    good, bad, both = [f"g{k}" for k in range(40)], [f"b{k}" for k in range(40)], [f"n{k}" for k in range(80)]
    docs, labels = [], []
    for k in range(count):
        host = rng.choice(["fine", "mixed", "poor", f"small{k % 30}"])
        quality = rng.random() < {"fine": 0.95, "mixed": 0.5, "poor": 0.05}.get(host, 0.5)
        words = [rng.choice(both) for _ in range(30)] + [rng.choice(good if quality else bad) for _ in range(rng.randint(0, 4))]
        rng.shuffle(words)
        docs.append((k, " ".join(words), "en" if k % 2 else None, None if host == "small0" else host, *cases.CLASHING, *cases.MORE))
        labels.append((k, int(quality), 0))
    return docs, labels


def test_quality_on_held_out_labels_and_shrinkage(spark, tmp_path):
    docs, labels = labelled(1500, 8)
    spark.createDataFrame([*docs, (None, None, None, None, *cases.CLASHING, *cases.MORE)], cases.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    known = [x for x in labels if x[0] % 3]
    spark.createDataFrame([*known, known[0], (None, 1, 0), (5_000, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = {r.doc_id: r for r in quality_model.op3_quality_classifier(spark, str(tmp_path)).collect()}
    assert len(out) == 1501
    right = [(out[k].quality_probability >= 0.5) == bool(y) for k, y, _ in labels if k % 3 == 0]
    assert sum(right) / len(right) > 0.9
    rates = defaultdict(set)
    for r in out.values():
        rates[r.source].add(round(r.quality_host_rate, 9))
    assert all(len(v) == 1 for v in rates.values())
    assert max(rates["poor"]) < max(rates["mixed"]) < max(rates["fine"])
    none = cases.save(spark, tmp_path / "none", empty=True)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{none}/labels.parquet")
    assert quality_model.op3_quality_classifier(spark, none).count() == 0
