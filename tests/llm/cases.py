"""Small tables with every awkward case."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tag string, key int, size double, score string, slot int, copies int, fp binary"


def awkward(seed=5, n=60):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 7))) for _ in range(400)]
    passage = " ".join(rnd.choice(words) for _ in range(120))
    make = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    line = lambda: make(9)
    block = "\n".join(line() for _ in range(5))
    texts = [None, "", "  \n\t ", "ß", "one", "x " * 3000, passage, passage, passage + " end", make(30) + " " + passage + " " + make(40), make(20) + " " + passage]
    edited = passage.split()
    edited[50] = "changed"
    texts += [make(25) + " " + " ".join(edited) + " " + make(25), block + "\n" + line(), line() + "\n" + block, line() + "\n\n" + block + "\n" + line(), "Élan ... çà ☃ 漢字", "a\u0000b  c", make(20000)]
    texts += [make(rnd.randrange(5, 200)) for _ in range(n - len(texts))]
    rows = [(i, t, rnd.choice(["en", "de", None]), rnd.choice(["s1", "s1", "s1", "s2", "", None]), len(t) if t else None) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], rows[30], (None, texts[9], None, None, None), (None, None, None, None, None), (31, "another text for an id", "en", "s1", 1)]
    return [(*r, "t", 1, 0.5, "x", 3, 4, b"f") for r in rows]


def table(spark, rows=None, parts=5):
    rows = awkward() if rows is None else rows
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)
