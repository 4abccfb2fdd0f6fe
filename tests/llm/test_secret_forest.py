"""Recall and precision of the default forest on planted values that no format rule names, in a fold it has not seen."""

import random
import string

from pyspark.sql import functions as F

from lexloom.llm import queries, secrets
from lexloom.llm.shared import fold

KEYS = string.ascii_letters + string.digits


def planted(i: int, rng: random.Random) -> tuple[str, int]:
    word = rng.choice(["sommer", "winter", "garden", "maison"])
    return [
        (f'password = "{word}{rng.randint(10, 99)}{rng.choice("!$%&")}{"".join(rng.choices(KEYS, k=3))}"', 1),
        ('api_key: "sk_live_' + "".join(rng.choices(KEYS, k=24)) + '"', 1),
        ('secret="' + "".join(rng.choices(KEYS + "+/", k=43)) + '="', 1),
        ("pwd=" + "".join(rng.choices(KEYS, k=12)) + "7q", 1),
        (f"token=build{rng.randint(1, 99)}", 0),
        (f"order {rng.randint(10**9, 10**10)}", 0),
        (f"password: release{rng.randint(1, 99)}", 0),
        (f"on {rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", 0),
    ][i % 8]


def test_recall_and_precision_on_an_unseen_fold(spark):
    rng = random.Random(7)
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "source")
    rows = [(10_000 + i, *planted(i, rng)) for i in range(800)]
    texts = {r["doc_id"]: r["text"] for r in docs.limit(50).collect()}
    prose = list(texts.values())
    mixed = [(i, f"{prose[i % 50][:300]} build release\n{value}\nthe end", "src") for i, value, _ in rows]
    found = secrets.scan(docs.union(spark.createDataFrame(mixed, docs.schema)))
    unseen = found.where((fold(F.col("doc_id")) == 0) & (F.col("doc_id") >= 10_000)).groupBy("doc_id").agg(F.max("is_secret").alias("s"))
    flagged = {r["doc_id"] for r in unseen.where("s").collect()}
    import zlib

    held = {i: label for i, _, label in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert len(held) > 100
    # Secrets that the prose itself holds are in every kind of planted row alike.
    own = {i for i in held if any(w in prose[i % 50][:300].lower() for w in ("token", "password", "secret", "api", "akia"))}
    true = {i for i, label in held.items() if label and i not in own}
    false = {i for i, label in held.items() if not label and i not in own}
    recall, wrong = len(true & flagged) / len(true), len(false & flagged) / len(false)
    assert recall >= 0.95 and wrong <= 0.05, (recall, wrong)
