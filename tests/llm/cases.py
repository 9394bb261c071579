"""Documents with every odd case, and brute-force versions of the operators."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def odd_documents(seed=1, n=60):
    """(doc_id, text): random texts with copies, near copies and shared passages; null, empty, blank and very long texts; repeated rows."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("aeimnorst") for _ in range(r.randint(1, 9))) for _ in range(300)] + ["naïve", "धर्म", "12", "x=1;", "😀"]
    passage = " ".join(r.choice(vocab) for _ in range(70))
    texts = [" ".join(r.choice(vocab) for _ in range(r.randint(1, 200))) for _ in range(n)]
    for i in range(0, n - 10, 7):
        texts[i] = texts[i] + " " + passage + "\n" + texts[i + 1][:50]
    for i in range(3, n, 9):
        texts[i] = texts[i - 1]
    for i in range(4, n, 11):
        own = texts[i - 1].split(" ")
        own[len(own) // 2] = "changed"
        texts[i] = " ".join(own)
    rows = list(enumerate(texts))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "one"), (n + 4, "a " * 40), (n + 5, "b b b c " * 30), (n + 6, "\n".join(["same line here"] * 9)), (n + 7, " ".join(vocab * 12))]
    return rows


def frame(spark, rows, parts=3, extra=True):
    """With columns whose names clash with those that operators use."""
    d = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    if extra:
        d = d.withColumns({"lang": F.when(F.col("doc_id") % 3 == 0, "en").when(F.col("doc_id") % 3 == 1, "xx"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), "kept": F.lit(7), "fp": F.lit("fp"), "counts": F.lit(1), "spans": F.lit("s"), "n_words": F.lit(-1), "n_removed": F.lit(-2), "component_id": F.lit(-3), "block": F.lit(0)})
    return d.repartition(parts)
