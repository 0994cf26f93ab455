"""Small documents for the tests of the training-data operators: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

#: Names that the operators use inside, so that a clash shows.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, n_lines long, rank long, key long, id long, vertex long, segment int, target double, source_size long, copies int, n_dropped long, n int, one long"
CLASHING = (None, 7, 8, 9, 10, 11, 12)
MORE = (1, 0.5, 3, 4, 5, 6, 2)
VOCABULARY = [f"word{k}" for k in range(60)] + ["été", "Straße", "naïve", "ΣΑΣ", "x\xa0y", "日本語", "a\x1cb", "#*$", "it's", "10,000"]


def texts(count=60, seed=1):
    rng = random.Random(seed)
    out = [None, "", " \n\t ", "one", "ONE two", "same line here that is long\n" * 4, "a " * 3000, "\r\n\x0b\x0c", "x" * 5000]
    lines = ["This line is repeated across Documents", "  THIS line is repeated across documents\t", "short line", "another passage of more than twenty characters"]
    while len(out) < count:
        body = [" ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 6))]
        out.append("\n".join(body + rng.sample(lines, rng.randint(0, 3))))
    return out


def rows(count=60, seed=1):
    found = [(k, t, "en" if k % 3 else None, (None, "a", "b", "b", "b")[k % 5], *CLASHING, *MORE) for k, t in enumerate(texts(count, seed))]
    return [*found, found[-1], (None, found[-1][1], None, "b", *CLASHING, *MORE)]


def documents(spark, count=60, seed=1):
    return spark.createDataFrame(rows(count, seed), SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def save(spark, folder, count=60, seed=1, empty=False):
    """A folder with a documents table as the queries read it."""
    (none(spark) if empty else documents(spark, count, seed)).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return str(folder)
