"""Small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, k long, d long, spans string, component string, _b int, rep long, w string"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(n))


def odd_texts():
    base = words(120, 1)
    passage = words(90, 2)
    return [
        base,
        base,
        base + " and more",
        words(30, 3) + " " + passage + " " + words(20, 4),
        passage + "\n" + words(40, 5),
        None,
        "",
        "   \t\n",
        "ab " * 400,
        "é日本 ▁😀 " * 120 + "<0x41> |im_start|>",
        "x" * 3000,
        "the of and",
        words(3000, 6),
        "word",
        "!!! ??? ...",
    ]


def documents(spark):
    rows = [(i, t, None if i % 5 == 0 else "en", [None, "b", "a", ""][i % 4], None if t is None else len(t), 7, 8, "s", "c", 1, 2, "w") for i, t in enumerate(odd_texts())]
    rows.append(rows[3])  # a repeated row
    rows.append((4, "another text under the same id", *rows[4][2:]))
    return spark.createDataFrame(rows, DOCS)


def without_null_ids(spark):
    return documents(spark)


def with_null_id(spark):
    return documents(spark).unionByName(spark.createDataFrame([(None, words(50, 9), "en", "a", 1, 7, 8, "s", "c", 1, 2, "w")], DOCS))


def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return [r.asDict() for r in df.collect()]
