"""A small corpus with nulls, empty and very long texts, copies, near copies and shared passages."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, n_bytes string"
WORDS = "The river runs past old mills and quiet towns before it meets a wide grey sea where ships wait for wind or tide".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", "ed", ","]) for _ in range(n)) + "."


def rows(seed=1, n=60):
    rng = random.Random(seed)
    base = [sentence(rng, 120) for _ in range(6)]
    passage = sentence(rng, 60)
    out = []
    for i in range(n):
        kind = i % 10
        if kind == 0:
            text = base[i % 6]  # exact copies
        elif kind in (1, 2):
            words = base[i % 6].split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)  # near copies
        elif kind == 3:
            text = sentence(rng, 40) + "\n" + passage + "\n" + sentence(rng, 40)
        elif kind == 4:
            text = "\n".join("Home | News | Contact | About" for _ in range(30))
        elif kind == 5:
            text = "é日本語 " * 30 + passage
        else:
            text = "\n".join(sentence(rng, 30) for _ in range(4))
        out.append((i, text))
    out += [(1000, None), (1001, ""), (1002, " \t\n "), (1003, "one"), (1004, "two words"), (1005, sentence(rng, 60_000)), (None, base[0]), (None, None), (1006, base[1]), (1006, base[1]), (1007, "\x00nul <|endoftext|> it's a.b\r\n x")]
    return [(k, t, "en", f"s{(k or 0) % 4}" if k != 1001 else None, None if t is None else len(t), 7, "clash") for k, t in out]


def frame(spark, made=None):
    return spark.createDataFrame(rows() if made is None else made, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
