"""Small corpora for the text operators: a scale factor's documents, and rows that are odd in every way."""

import random

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name int, level string, list string, component_id string, n long, bucket string, length string, range string, block string"


def odd_rows(seed=3):
    """Nulls, empties, white space, ties, repeated rows, a very long text, copies of all kinds."""
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["été", "naïve", "дом", "😀", "A", "b"]
    base = [" ".join(draw.choices(words, k=draw.choice([1, 3, 4, 5, 30, 90, 200]))) for _ in range(40)]
    texts = base + [None, "", "", "   ", "\n\t", "a", "a", " a", " ", "x " * 30_000, "y" * 70_000, "\x00 \x85 \x1c"]
    for text in base[:30]:
        tokens = text.split(" ")
        for _ in range(draw.choice([0, 1, 2, 5])):
            changed = list(tokens)
            for _ in range(draw.choice([0, 1, 1, 4])):
                changed[draw.randrange(len(changed))] = draw.choice(words)
            texts.append(draw.choice(["", draw.choice(words) + " "]) + draw.choice([" ", "\n"]).join(changed))
    long = base[5] + " " + " ".join(draw.choices(words, k=600))
    texts += [long, "head " + long + " tail", long[100:1500] + "!", long[500:900]]
    draw.shuffle(texts)
    return [(k * 7 % 1009, t) for k, t in enumerate(texts)]


def frame(spark, rows):
    """Rows (doc_id, text) with the other columns of documents and columns of clashing names, some null."""
    return spark.createDataFrame([(i, t, None, "s" if i else None, None, 1, None, "x", None, None, None, None, None, None) for i, t in rows], SCHEMA).repartition(3)


def read(spark, table="documents", sf=SF):
    return spark.read.parquet(f"{sf}/{table}.parquet")


def pairs_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
