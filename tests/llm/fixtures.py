"""Small inputs with copies, near copies, shared passages, and odd rows."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(seed=3, n=60):
    r = random.Random(seed)
    vocab = ["".join(r.choice(["an", "er", "É", "tion", "X", "ß", "o"]) for _ in range(r.randint(1, 4))) for _ in range(300)]
    say = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passage, other = say(60), say(35)
    out = []
    for i in range(n):
        t = say(r.randint(0, 150))
        if i % 5 == 1:
            t = f"{say(10)} {passage}\t{say(8)}"
        if i % 7 == 2:
            t = f"{other}\n{t} {other}"
        if i % 6 == 3 and out:
            t = r.choice(out)
        if i % 6 == 4 and out:
            w = r.choice(out).split()
            if w:
                w[r.randrange(len(w))] = r.choice(vocab)
            t = " ".join(w)
        out.append(t)
    return [*out, "", "   \n\t ", "one", "One two", "a b c d e", "x " * 700, "ab" * 900, "no break \x0b\x0c mixed\x1c sep"]


def rows(seed=3, n=60):
    docs = list(enumerate(texts(seed, n)))
    docs += [(1000, None), (None, docs[4][1]), (None, None), (5, docs[5][1]), (5, docs[8][1]), (2, docs[2][1])]
    return docs


def frame(spark, docs):
    got = [(d, t, None if t is None or len(t) % 9 == 0 else "en", "s", len(t or "")) for d, t in docs]
    df = spark.createDataFrame(got, SCHEMA).selectExpr("*", "1 as _id", "2 as _h", "'x' as raw", "3 as anchor", "4 as n")
    return df.repartition(3)


def collected(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
