"""Small inputs with nulls, empty and long texts, ties, repeated rows and
columns whose names operators might use themselves."""

import random

COLUMNS = ("doc_id bigint, text string, lang string, source string, n_chars bigint, key string, fp string, n string, "
           "digest string, spans string, y string, word string, _key string, slot string, component_id string")

WORDS = "the of and river stone light paper garden window market engine forest silver letter morning question answer".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "ing"]) for _ in range(n))


def edge_texts(seed=0):
    rng = random.Random(seed)
    long_one = prose(rng, 30_000)
    passage = prose(rng, 60)
    base = [prose(rng, rng.randint(1, 80)) for _ in range(12)]
    return [
        None, "", None, " ", "\n\t ", "a", "A", "<|endoftext|>", "x <|endoftext|> y", "ééé ß 中文   z", "aaaa" * 200,
        "ab" * 400, long_one, long_one.upper(), base[0], base[0], base[0].upper(), *base,
        f"{base[1]} {passage} {base[2]}", f"{base[3]} {passage} {base[4]}", f"{passage}", f"{passage} {passage}",
        "É" + passage + "é" + base[5], "1234567890" * 30, "  double  spaces  ", "trailing \n", "\x00\x01 control",
    ]


def edge_rows(seed=0):
    texts = edge_texts(seed)
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(3, texts[3]), (15, texts[15]), (15, texts[15]), (None, "a"), (None, texts[14]), (None, None), (7, "another text for seven")]
    return [(i, t, "en" if t and len(t) % 2 else None, "s", len(t or ""), *["clash"] * 10) for i, t in rows]


def edge_docs(spark, seed=0):
    return spark.createDataFrame(edge_rows(seed), COLUMNS).repartition(3)


def empty_docs(spark):
    return spark.createDataFrame([], COLUMNS)
