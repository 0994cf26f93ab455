"""Queries over whole texts against brute force: rules, line dedup, fingerprints, personal data and BPE."""

import hashlib
import re
import zlib
from collections import Counter
from functools import cache
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import bpe, language_model, lexicon, line_dedup, pii, quality_rules, sketch
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def sha(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return cases.save(spark, tmp_path_factory.mktemp("tables"))


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return cases.save(spark, tmp_path_factory.mktemp("empty"), empty=True)


def test_rules_count_as_brute_force(spark, folder, empty):
    def brute(text):
        tokens = WORD.findall(text)
        windows = [tuple(tokens[i : i + 8]) for i in range(len(tokens) - 7)]
        often = {w for w, n in Counter(windows).items() if n > 1}
        covered = {i + k for i, w in enumerate(windows) if w in often for k in range(8)}
        lines = text.split("\n")
        repeats = sum(1 for i, line in enumerate(lines) if WORD.search(line) and line in lines[:i])
        failed = len(tokens) < 20 or 100 * len(covered) > 30 * len(tokens)
        return (len(tokens), sum(map(len, tokens)), sum(c in "#*$%&|<>" for c in text), repeats, len(covered), failed)

    rows = quality_rules.op4_quality_rules(spark, folder).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert got == Counter((r[0], *brute(r[1] or "")) for r in cases.rows())
    assert all(not r.kept for r in rows if r.base_failed)
    for r in rows:
        plain = [rule.name for rule in quality_rules.RULES if rule.rejects(dict(cases_by_id())[r.doc_id], WORD.findall(dict(cases_by_id())[r.doc_id]))] if r.doc_id is not None else None
        assert plain is None or (r.kept == (not plain) and (r.kept or r.rejected_by in plain))
    assert quality_rules.op4_quality_rules(spark, empty).count() == 0


def test_order_of_rules_never_changes_the_verdict(spark):
    docs = cases.documents(spark)
    measured = quality_rules.measure(docs)
    assert set(measured) == {r.name for r in quality_rules.RULES}
    forward, backward = quality_rules.plan(measured), tuple(reversed(quality_rules.plan(measured)))
    kept = [Counter((r.doc_id, r.kept) for r in quality_rules.judge(docs, order).collect()) for order in (forward, backward)]
    assert kept[0] == kept[1]
    filtered = quality_rules.filter_documents(docs, forward)
    assert filtered.columns == docs.columns and filtered.count() == sum(n for (_, keep), n in kept[0].items() if keep)


def test_plan_puts_rejections_for_the_least_time_first():
    rules = tuple(quality_rules.Rule(n, lambda text, tokens: False) for n in "abc")
    assert [r.name for r in quality_rules.plan({"a": (100, 0.5), "b": (10, 0.2), "c": (1, 0.0)}, rules)] == ["b", "a", "c"]


def cases_by_id():
    return [(r[0], r[1] or "") for r in cases.rows()]


def brute_lines(rows):
    def key(line):
        return low(line.strip(" \t\n\v\f\r"))

    holders, keeper = Counter(), {}
    for row in rows:
        for k in {key(line) for line in (row[1] or "").split("\n")}:
            holders[k] += 1
            if row[0] is not None:
                keeper[k] = max(keeper.get(k, row[0]), row[0])
    out = Counter()
    for row in rows:
        lines = (row[1] or "").split("\n")
        stay = [x for x in lines if len(key(x)) < 20 or holders[key(x)] < 3 or keeper.get(key(x), row[0]) == row[0]]
        out[row[0], len(lines), len(lines) - len(stay), sha("\n".join(stay))] += 1
    return out


def test_line_dedup_equals_brute_force_both_ways(spark, folder, empty):
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.op9_line_dedup(spark, folder).collect())
    assert got == brute_lines(cases.rows())
    joined = line_dedup.dedup(cases.documents(spark), most_keys=0, counts=("_n", "_gone"))
    assert Counter((r.doc_id, r._n, r._gone, sha(r.text)) for r in joined.collect()) == brute_lines(cases.rows())
    assert joined.columns == [*cases.documents(spark).columns, "_n", "_gone"] and {r.n_lines for r in joined.collect()} == {8}
    names = {f"_{n}": F.lit(n) for n in ("one", "two", "goes", "times", "lines_to_drop", "rank", "range")} | {n: F.lit(n) for n in ("next", "row", "drop", "before", "dropped", "high")}
    for most in (0, 1 << 20):
        clashing = line_dedup.dedup(cases.documents(spark).withColumns(names), most_keys=most, counts=("_n", "_gone"))
        rows = clashing.collect()
        assert Counter((r.doc_id, r._n, r._gone, sha(r.text)) for r in rows) == brute_lines(cases.rows())
        assert all(r[n] == n.removeprefix("_") for r in rows for n in names)
    with pytest.raises(ValueError, match="n_lines"):
        line_dedup.dedup(cases.documents(spark))
    assert line_dedup.op9_line_dedup(spark, empty).count() == 0


def test_fingerprints_and_next_documents(spark, tmp_path, empty):
    rows = [r for r in cases.rows() if r[0] is not None][:-1]
    spark.createDataFrame(rows, cases.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in sketch.op7_fingerprints(spark, str(tmp_path)).collect()}
    texts = [r[1] or "" for r in sorted(rows)]
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        after = texts[(k + 1) % len(texts)]
        edit = len(text) // 4
        assert got[k].edited_sha256 == sha(text[: len(text) - edit] + after[:edit]) and got[k].n_chars == len(text)
        assert 0 <= got[k].near_next <= 1 and 0 <= got[k].near_edited <= 1
        assert got[k].fingerprint == got[(k + 1) % len(texts)].fingerprint or got[k].near_next < 1
    assert sketch.op7_fingerprints(spark, empty).count() == 0
    plan = sketch.op7_fingerprints(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sketches_equal_plain_python(spark, tmp_path):
    """Nulls, ties and repeated rows as well; the hash is Spark's, all else plain."""
    rows = [r for r in cases.rows(30) if r[0] is not None]
    rows += [(None, t, *rows[0][2:]) for t in ("null id one two three four five six", None)]
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    runs = {}
    for r in rows:
        tokens = WORD.findall(low(r[1] or ""))
        runs[r[1] or ""] = [tokens[i : i + 5] for i in range(max(1, len(tokens) - 4))] if tokens else []
    flat = [(t, run) for t, x in runs.items() for run in x]
    hashed = spark.createDataFrame(flat, "t string, run array<string>").selectExpr("t", "xxhash64(run) AS h").collect()
    held = {t: set() for t in runs}
    for r in hashed:
        held[r.t].add(r.h)
    limit = int(sketch.FRACTION * 2**64) - 2**63
    plain = {t: sorted(h for h in x if h < limit) or sorted(x)[:1] for t, x in held.items()}
    order = sorted(((r[0] is not None, r[0] or 0, r[1] or "") for r in rows))
    got = Counter((r.doc_id, r.fingerprint, round(r.near_next, 9)) for r in sketch.op7_fingerprints(spark, str(tmp_path)).collect())
    expected = Counter()
    for k, (known, i, t) in enumerate(order):
        a, b = set(plain[t]), set(plain[order[(k + 1) % len(order)][2]])
        near = len(a & b) / len(a | b) if a | b else 1.0
        expected[i if known else None, "".join(f"{h % 2**64:016x}" for h in plain[t]), round(near, 9)] += 1
    assert got == expected


def test_merged_sketches_are_those_of_the_union(spark):
    from pyspark.sql import functions as F

    one, two = "a b c d e f g h", "p q r s t u v w x y z " * 3
    df = spark.createDataFrame([(one, two), (one, one), (two, two), ("", one)], "a string, b string").select(*[sketch.sketch(F.col(c)).alias(c) for c in "ab"])
    for r in df.select("a", "b", sketch.merged(F.col("a"), F.col("b")).alias("m")).collect():
        limit = int(sketch.FRACTION * 2**64) - 2**63
        union = set(r.a) | set(r.b)
        assert r.m == (sorted(h for h in union if h < limit) or [min(union)])


def test_containment_of_unequal_documents_and_merging(spark):
    words = [f"w{k}" for k in range(6000)]
    part, whole, other = " ".join(words[:900]), " ".join(words), " ".join(f"v{k}" for k in range(900))
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(part, whole, other)], "a string, b string, c string").select(*[sketch.sketch(F.col(c)).alias(c) for c in "abc"])
    row = df.select(sketch.containment(F.col("a"), F.col("b")).alias("ab"), sketch.containment(F.col("b"), F.col("a")).alias("ba"), sketch.containment(F.col("c"), F.col("b")).alias("cb"), F.size("b").alias("n"), sketch.merged(F.col("a"), F.col("b")).alias("m"), "b").first()
    assert row.ab == 1 and abs(row.ba - 0.15) < 0.06 and row.cb == 0 and row.m == row.b and abs(row.n - 750) < 120


def brute_personal(text):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            total = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits)))
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and total % 10 == 0, "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


PERSONAL = [
    "write to a.b+c@d-e.example.com, or x@y@z.com or @home.org; .@a.b", "host 10.0.0.256 and 010.1.2.3.4 and 1.2.3", "card 4111 1111 1111 1111 or 4111-1111-1111-1112",
    "call +1 (415) 555-0199 or +49 30 1234567890123456", "ssn 123-45-6789 and (415) 555-0199", 'token = "9f86d081884c7d659a2feaa0c55ad015"', "日本 4111111111111111 é a@b.cc", "1" * 4000, "5" * 30 + ".1.1.1", "0." * 3000,
]


def test_personal_data_base_equals_brute_force_and_the_field_adds(spark, tmp_path, empty):
    rows = [(k, t, None, None, *cases.CLASHING, *cases.MORE) for k, t in enumerate([*PERSONAL, None, ""])]
    spark.createDataFrame([*rows, rows[0]], cases.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in pii.op10_pii(spark, str(tmp_path)).collect()}
    for k, text, *_ in rows:
        base = brute_personal(text or "")
        assert got[k].base_sha256 == sha(base)
        assert set(filter(None, base.split(","))) <= set(got[k].spans.split(","))
        assert got[k].n_email == base.count("email:") and got[k].n_card == base.count("card:")
    assert "national_id:4:15" in got[4].spans and "phone:" in got[4].spans and "secret:9:41" in got[5].spans
    assert pii.op10_pii(spark, empty).count() == 0


def test_personal_data_in_hostile_texts_is_linear_and_equal():
    import random
    import time

    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice("0127.. -+()@ab_%é") for _ in range(rng.randint(0, 40)))
        assert ",".join(f"{k}:{a}:{b}" for k, a, b in pii.base_spans(text)) == brute_personal(text), text
    weights = pii.fitted()
    for text in ("1" * 1_000_000, "a@" + "dot" * 3000 + "x!", "a@" + " dot x" * 300 + "!", "+" * 300_000, "+1" + "(" * 300_000, "1." * 600, "a" * 300_000 + "@", "5 at" + " " * 300_000 + "dot 5"):
        began = time.process_time()
        base = pii.base_spans(text)
        pii.added_spans(text, base, weights)
        assert time.process_time() - began < 30
    assert len(pii.base_spans("1." * 400_000)) == 100_000
    assert ("email", 6, 30) in pii.added_spans("write jane [at] host [dot] com today", [], weights)


def test_field_decodes_the_best_segmentation():
    """The dynamic programme against all segmentations of small windows."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    n = 6
    where = [(i, size) for i in range(n) for size in range(1, n - i + 1)]
    scores = rng.normal(-0.5, 2, (len(where), 3))

    def value(chosen):
        return sum(scores[k].max() for k in chosen)

    legal = [c for r in range(5) for c in itertools.combinations(range(len(where)), r) if all(where[a][0] + where[a][1] <= where[b][0] or where[b][0] + where[b][1] <= where[a][0] for a, b in itertools.combinations(c, 2))]
    best = pii.best(scores, where, n)
    assert abs(sum(scores[where.index((i, size)), kind] for i, size, kind in best) - max(map(value, legal))) < 1e-9
    assert (pii.marginals(scores, where, n) <= 1 + 1e-9).all()


def test_bpe_equals_the_library(spark, folder, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.tokenizer_path())
    library.no_truncation(), library.no_padding()

    def brute(text):
        ids = library.encode(text, add_special_tokens=False).ids
        return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))

    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op6_bpe(spark, folder).collect())
    assert got == Counter((r[0], *brute(r[1] or "")) for r in cases.rows())
    rare = bpe.digests(cases.documents(spark), bpe.tokenizer_path(), limit=3)
    assert Counter(tuple(r) for r in rare.collect()) == got
    assert bpe.op6_bpe(spark, empty).count() == 0


def test_lexicon_shares_suffixes_and_knows_only_its_words():
    words = {f"{a}{b}ing": [k, j] for k, a in enumerate(("walk", "talk", "é", "")) for j, b in enumerate(("", "s", "en"))}
    found = lexicon.Lexicon(lexicon.compile_words(words))
    assert all(found.get(w) == ids for w, ids in words.items()) and found.words == len(words)
    assert found.get("walkin") is None and found.get("walkingx") is None and found.get("") is None
    assert found.states < sum(map(len, words))


def brute_base(rows):
    def held_out(i):
        return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1

    tokens = [[*WORD.findall(low(r[1] or "")), "\n"] for r in rows]
    counts = Counter(w for r, t in zip(rows, tokens) if not held_out(r[0]) for w in t)
    whole = sum(counts.values())
    out = Counter()
    for r, t in zip(rows, tokens):
        score = sum(log10((counts[w] + 0.5) / (whole + 0.5 * (len(counts) + 1))) for w in t)
        out[r[0], held_out(r[0]), len(t), sum(counts[w] > 0 for w in t), whole, round(score, 6)] += 1
    return out


def test_base_scores_equal_brute_force(spark, folder, empty):
    rows = language_model.op5_language_model(spark, folder).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == brute_base(cases.rows())
    assert all(r.score < 0 for r in rows)
    assert language_model.op5_language_model(spark, empty).count() == 0


def test_held_out_texts_change_no_training_score(spark, tmp_path, folder):
    """The smoothing comes from an inner fold of the training texts."""
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 1 for r in cases.rows()]
    rows = [(r[0], "entirely other words " * 50, *r[2:]) if h else r for r, h in zip(cases.rows(), held)]
    spark.createDataFrame(rows, cases.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    scores = [Counter((r.doc_id, r.score) for r in language_model.op5_language_model(spark, path).collect() if not r.held_out) for path in (folder, str(tmp_path))]
    assert any(held) and scores[0] == scores[1]


def test_own_text_is_taken_out_of_the_counts():
    texts = ["a b a b", "b", ""]
    tokens = language_model.Tokens(texts, language_model.Vocabulary())
    n = len(tokens.codes)
    plain = language_model.without_own(tokens, np.full(n, 10 / 100), np.full(n, 5.0), np.full(n, 9.0), 100.0)
    assert plain[0].round(6).tolist() == [0.08, 0.08, 0.08, 0.08, 0.09, 0.09, 0.09, 0.09]
    assert plain[1].tolist() == [4, 3, 4, 3, 4, 4, 4, 4]
    assert plain[2].tolist() == [8, 7, 7, 7, 7, 8, 8, 8]


@pytest.mark.parametrize(("part_bytes", "smoothing"), [(1 << 20, (10.0, 0.5)), (50, (1.0, 0.0))])
def test_scores_equal_brute_force(spark, monkeypatch, part_bytes, smoothing):
    """With many bits an entry no probe errs, and the score is the formula over exact counts; parts change nothing."""
    from dataclasses import replace

    texts = [*[t or "" for t in cases.texts(40)], "the end", "the end of the end"]
    tokens = [[*WORD.findall(low(t)), "\n"] for t in texts]
    single = Counter(w for t in tokens for w in t)
    pairs = Counter(p for t in tokens for p in zip(["<s>", *t], t))

    @cache
    def mean(n):
        level = next(q for q in range(200) if n < 1.5**q - 1e-6)
        members = [k for k in range(1, 20000) if 1.5 ** (level - 1) - 1e-6 <= k < 1.5**level - 1e-6] or [0]
        return (members[0] + members[-1]) / 2

    def upper(total):
        return 1.2 ** next(q for q in range(1, 500) if total < 1.2**q * (1 - 1e-9)) if total else 0.0

    read = {w: mean(n) for w, n in single.items()}
    follow = Counter()
    for (before, _), n in pairs.items():
        follow[before] += mean(n)
    whole = sum(read.values()) + 0.5 * (len(single) + 1)

    def brute(t):
        out = 0.0
        for p in zip(["<s>", *t], t):
            joint = mean(pairs[p]) if pairs[p] else 0.0
            total = max(upper(follow[p[0]]), joint)
            k = smoothing[0] + smoothing[1] * total
            out += log10((joint + k * (read.get(p[1], 0.0) + 0.5) / whole) / (total + k))
        return out

    monkeypatch.setattr(language_model, "PART_BYTES", part_bytes)
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string")
    model = replace(language_model.fit(frame.select("text"), per_entry=2000), smoothing=smoothing)
    asked = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, "unseen words the word1"])], "id long, text string")
    got = {r.id: r.score for r in language_model.scored(asked, model).collect()}
    for k, t in enumerate([*tokens, ["unseen", "words", "the", "word1", "\n"]]):
        assert got[k] == pytest.approx(brute(t), abs=1e-6)


def test_pairs_raise_held_out_probability(spark):
    """Text with an order of words: the fitted smoothing scores held-out text above the base score."""
    import random

    rng = random.Random(9)
    follow = {k: [(7 * k + j) % 50 for j in range(3)] for k in range(50)}

    def text():
        at, out = rng.randrange(50), []
        for _ in range(60):
            out.append(f"w{at}")
            at = rng.choice(follow[at])
        return " ".join(out)

    train, held = ([(text(),) for _ in range(n)] for n in (200, 40))
    model = language_model.smoothed(language_model.fit(spark.createDataFrame(train, "text string")), spark.createDataFrame(held, "text string"))
    row = language_model.scored(spark.createDataFrame(held, "text string"), model).selectExpr("sum(score) AS s", "sum(base_score) AS b").first()
    assert row.s > row.b + 1000


def test_filter_never_reads_a_count_too_small():
    import numpy as np

    keys = np.sort(language_model.word_hashes([f"w{k}" for k in range(3000)])[:, 0])
    true = language_model.level_of(np.arange(1, 3001), language_model.BASE)
    bits = language_model.filled(keys, true)
    held = language_model.LogFrequencyFilter("", False, [np.zeros(1, np.int64)], [np.array([8 * len(bits)])], (0, 0, 0, 0))
    held._file = np.frombuffer(bits, np.uint8)
    read = held.levels(0, keys)
    assert (read >= true).all() and (read == true).mean() > 0.95
    unknown = language_model.word_hashes([f"u{k}" for k in range(3000)])[:, 0]
    assert (held.levels(0, unknown) > 0).mean() < 0.05


def test_keys_spread_over_all_parts():
    import numpy as np

    hashes = language_model.word_hashes([f"w{k}" for k in range(20000)])[:, 0]
    for keys in (hashes, language_model.context_key(hashes), language_model.pair_key(hashes, hashes[:1]), language_model.pair_key(hashes[:1], hashes)):
        assert np.bincount(language_model.home_of(keys, 256), minlength=256).max() < 200
    assert (language_model.unmixed(language_model.mixed(hashes)) == hashes).all()


def test_long_words_and_odd_runs_equal_the_library():
    import random

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.tokenizer_path())
    library.no_truncation(), library.no_padding()
    model = bpe.Model.load(bpe.tokenizer_path())
    words = {w: model.merge(w) for w in ("the", "it", "éa", "'s", ".", "<|endoftext|>")}
    encoder = bpe.Encoder(model, lexicon.compile_words(words))
    assert encoder.lexicon.ranks([*words, "th", "thee", ""]).tolist()[:6] == [sorted(words, key=str.encode).index(w) for w in words]
    assert encoder.lexicon.ranks(["th", "thee", "", "x"]).tolist() == [-1] * 4
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdeéü") for _ in range(200_000)), "", "the"]
    texts += ["".join(rng.choice([*" ab'srEÉ1²½\x1c\x85　日ǅİΣς́.\n_-", "<|endoftext|>", "the "]) for _ in range(rng.randint(0, 30))) for _ in range(500)]
    import pyarrow as pa

    encoded = encoder.encode(pa.array(texts))
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoded.ids().to_pylist() == expected and encoded.counts().tolist() == list(map(len, expected))
    assert encoded.decoded().to_pylist() == [library.decode(i, skip_special_tokens=False) for i in expected]
