"""Fill-in-middle, periodic runs and decontamination against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import decontaminate, fim, tandem
from tests.llm import cases

SPACED = re.compile(r"[^\x20\x09-\x0d]+")
ALNUM = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def sha(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = cases.save(spark, tmp_path_factory.mktemp("tables"))
    items = [(k, t) for k, t in enumerate(texts_of_items())] + [(None, "Another passage"), (3, "no such words anywhere here at all today"), (99, texts_of_items()[0])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def texts_of_items():
    held = [t for t in cases.texts() if t and len(ALNUM.findall(t)) > 20]
    return [" ".join(ALNUM.findall(held[3])[2:17]).upper(), "ONE-TWO", "", None, " ".join(ALNUM.findall(held[7])[:10]), "same line, here", "a " * 12, "日本語"]


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = cases.save(spark, tmp_path_factory.mktemp("empty"), empty=True)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


# fill in middle


def brute_middle(number, text):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = [int(hashlib.sha256(f"7:{'' if number is None else number}".encode()).hexdigest()[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text):
        return text, "plain", len(units), None, None
    if h[3] % 100 < 50:
        return f"<S>{suffix}<P>{prefix}<M>{middle}", "spm", len(units), len(prefix), len(middle)
    return f"<P>{prefix}<S>{suffix}<M>{middle}", "psm", len(units), len(prefix), len(middle)


def test_ropes_split_and_join_as_strings_do():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["a", "é", "日\n", "\n", "<", "<P", "S>", "x" * 40, "\r"]) for _ in range(rng.randint(0, 120)))
        tree = fim.rope(text, rng.choice([1, 3, 50]))
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        assert (tree.units, tree.chars, fim.text_of(tree)) == (len(lines), len(text), text)
        cut = rng.randint(-1, len(lines) + 1)
        left, right = fim.split_units(tree, cut)
        assert (fim.text_of(left), fim.text_of(right)) == ("".join(lines[: max(cut, 0)]), "".join(lines[max(cut, 0) :]))
        assert (left.units + right.units, left.chars, right.chars) == (len(lines), len(fim.text_of(left)), len(fim.text_of(right)))
        at = rng.randint(0, len(text))
        assert tuple(map(fim.text_of, fim.split_chars(tree, at))) == (text[:at], text[at:])
        made = fim.transformed(text, fim.draws(rng.randint(0, 9**9)))
        assert fim.inverted(made[0], made[1]) == text


def test_fill_in_middle_equals_brute_force(spark, folder, empty):
    got = Counter(map(tuple, fim.op11_fill_in_middle(spark, folder).select("doc_id", "output_sha256", "form", "n", "prefix_chars", "middle_chars", "restored_sha256").collect()))
    want = Counter()
    for row in cases.rows():
        output, *rest = brute_middle(row[0], row[1] or "")
        want[(row[0], sha(output), *rest, sha(row[1] or ""))] += 1
    assert got == want
    assert fim.op11_fill_in_middle(spark, empty).count() == 0


def test_fill_in_middle_keeps_columns_and_rates(spark):
    docs = cases.documents(spark).withColumns({"form": F.lit("mine"), "row": F.lit(1), "output": F.lit(2), "fim": F.lit("old")})
    made = fim.restore(fim.fill_in_middle(docs))
    assert set(made.columns) == {*docs.columns, "restored"}
    assert all(r.restored == (r.text or "") and (r.form, r.row, r.output) == ("mine", 1, 2) for r in made.collect())
    none = fim.fill_in_middle(docs, rate=0).collect()
    assert {r.fim.form for r in none} == {"plain"} and all(r.fim.output == (r.text or "") for r in none)
    marked = spark.createDataFrame([(1, "a <S> b\nc"), (2, "x" * 300_000 + "\n" + "y\n" * 50_000)], "doc_id long, text string")
    forms = {r.doc_id: r for r in fim.restore(fim.fill_in_middle(marked)).collect()}
    assert forms[1].fim.form == "plain" and forms[2].restored == "x" * 300_000 + "\n" + "y\n" * 50_000 and forms[2].fim.n == 50_001


# periodic runs


def brute_runs(x, least):
    n, out = len(x), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and x[i] == x[i + q]:
                i += 1
            length = i - s + q
            if length >= max(least, 2 * q) and not any(all(x[k] == x[k + d] for k in range(s, s + length - d)) for d in range(1, q)):
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 4)):
            v = rng.choice([1, 2, 2, 3, 5])
            t = [rng.randrange(v) for _ in range(rng.randint(0, 60))]
            root = [rng.randrange(3) for _ in range(rng.randint(1, 9))]
            texts.append(t[:10] + root * rng.randint(0, 6) + root[: rng.randint(0, len(root))] + t[10:])
        least = rng.choice([2, 3, 12, 12])
        found = tandem.runs_of_texts(np.array([w for t in texts for w in t], np.int64), np.array([len(t) for t in texts]), least)
        got = {}
        for text, *run in zip(*(x.tolist() for x in found)):
            got.setdefault(text, []).append(tuple(run))
        for k, t in enumerate(texts):
            assert got.get(k, []) == brute_runs(t, least)


def test_runs_of_long_texts_and_words_of_fibonacci():
    one, two = [0], [0, 1]
    while len(two) < 3000:
        one, two = two, two + one
    start, length, period = tandem.runs(np.array([*two[:600], 9], np.int64))
    assert sorted(zip(start.tolist(), length.tolist(), period.tolist()), key=lambda r: (r[0], r[2])) == brute_runs(two[:600], 2)
    for period in (1, 7, 9999):
        symbols = np.resize(np.arange(period), 40_000)
        assert [x.tolist() for x in tandem.runs_of_texts(symbols, np.array([40_000]), 12)] == [[0], [0], [40_000], [period]]


def brute_document(number, text):
    words = SPACED.findall(text or "")
    h, n = zlib.crc32(str(number).encode()) if number is not None else 1, len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words, 12)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(((-length, s, q) for s, length, q in runs), default=None)
    first = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (number, len(runs), *first, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_periodic_runs_equal_brute_force(spark, folder, empty):
    rows = [r for r in cases.rows() if len(SPACED.findall(r[1] or "")) < 1000]
    got = Counter(tuple(r) for r in tandem.op12_periodic_runs(spark, folder).collect())
    want = Counter(brute_document(r[0], r[1]) for r in rows)
    assert not want - got and sum((got - want).values()) == len(cases.rows()) - len(rows)
    assert tandem.op12_periodic_runs(spark, empty).count() == 0


def test_runs_keep_columns(spark):
    docs = cases.documents(spark).withColumns({"runs": F.lit("mine"), "row": F.lit(1), "tandem": F.lit("old"), "n_words": F.lit(3)})
    found = tandem.tandem_runs(docs)
    assert set(found.columns) == set(docs.columns)
    for r in found.collect():
        words = SPACED.findall(r.text or "")
        assert (r.runs, r.row, r.n_words, r.tandem.n_words) == ("mine", 1, 3, len(words))
        if not r.tandem.runs:
            assert r.tandem.collapsed == " ".join(words)


# decontamination


def brute_hits(text, items, window=10):
    words, hit, found = ALNUM.findall(low(text or "")), set(), set()
    for number, item in items:
        test = ALNUM.findall(low(item or ""))
        size = min(len(test), window)
        for s in range(len(test) - size + 1 if test else 0):
            for p in range(len(words) - size + 1):
                if words[p : p + size] == test[s : s + size]:
                    hit |= set(range(p, p + size))
                    found |= {str(number)} - {"None"}
    return words, hit, sorted(found)


def test_search_equals_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        vocabulary = [f"w{k}" for k in range(rng.choice([2, 4, 30]))] + ["É", "日本"]
        window = rng.choice([2, 3, 10])
        items = {" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30))): [str(k)] for k in range(rng.randint(0, 6))}
        docs = []
        for _ in range(rng.randint(0, 6)):
            d = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
            if items:
                d[5:5] = rng.choice(list(items)).upper().split()
            docs.append(rng.choice([" ", ", ", "-"]).join(d))
        counts, spans, found, matches = decontaminate.searched([*docs, None], decontaminate.prepared(list(items), list(items.values()), window))
        for k, doc in enumerate([*docs, None]):
            words, hit, names = brute_hits(doc, [(i[0], t) for t, i in items.items()], window)
            assert counts[k] == len(words) and found[k] == names
            assert {x for s, n in spans[k] for x in range(s, s + n)} == hit == {x for s, n, *_ in matches[k] for x in range(s, s + n)}
            for start, n, item, at in matches[k]:
                item_words = {i[0]: ALNUM.findall(low(t)) for t, i in items.items()}
                assert words[start : start + n] == item_words[item][at : at + n]
                if n >= window:
                    assert not any(x[s : s + n + 1] == words[start : start + n + 1] for x in item_words.values() for s in range(len(x) - n))


def test_decontamination_equals_brute_force(spark, folder, empty):
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = Counter()
    for r in cases.rows():
        words, hit, names = brute_hits(r[1], items)
        want[(r[0], len(words), len(hit), len(names), sha(",".join(names)), bool(hit))] += 1
    assert Counter(map(tuple, decontaminate.op13_decontamination(spark, folder).collect())) == want
    assert any(k[2] for k in want) and any(k[3] > 1 for k in want)
    assert decontaminate.op13_decontamination(spark, empty).count() == 0


def test_blocks_of_the_benchmark_and_clashing_columns_change_nothing(spark, folder):
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    docs = cases.documents(spark).withColumns({"row": F.lit(1), "spans": F.lit("mine"), "contamination": F.lit("old")})
    whole = decontaminate.contamination(docs, benchmark)
    parts = decontaminate.contamination(docs, benchmark, block_bytes=1)
    slim = ["doc_id", "spans", "row", F.to_json(F.struct("contamination.n_words", "contamination.spans", "contamination.items")).alias("found")]
    assert Counter(map(tuple, whole.select(*slim).collect())) == Counter(map(tuple, parts.select(*slim).collect()))
    assert set(whole.columns) == set(docs.columns)
    kept = decontaminate.decontaminated(docs, benchmark)
    clean = [r for r in whole.collect() if not r.contamination.spans]
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in clean)
    assert decontaminate.decontaminated(docs, benchmark.limit(0)).count() == docs.count()
