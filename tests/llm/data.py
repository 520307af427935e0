"""Small tables with odd rows, and plain models of the base results."""

import re
from collections import Counter

WORD = "[^\x20\x09-\x0d]+"
KIND = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows():
    base = " ".join(f"w{i}" for i in range(120))
    near = " ".join("edit" if i == 60 else f"w{i}" for i in range(120))
    lines = "\n".join(" ".join(f"l{k}x{i}" for i in range(20)) for k in range(4))
    return [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (3, near, "en", "b", 1),
        (4, None, "en", None, None),
        (5, "", None, "b", 0),
        (6, "  \t\n \x0b", "en", "b", 6),
        (7, "unrelated " * 3 + "mail bob@example.com +1 (415) 555-0136 4111 1111 1111 1111 10.0.0.1", "en", "é", 9),
        (8, "Released under the MIT License. CC BY-NC, gnu general public license", "en", "b", 9),
        (9, "head one\n" + lines + "\ntail", "en", "a", 9),
        (10, "other head\n\n" + lines + "\nmore", "en", "a", 9),
        (11, "x" * 60_000 + " " + "▁ é\U0001f600\x00\x01 end", "fr", "b", 9),
        (None, "no id " * 30, "en", "c", 9),
        (12, "repeated row with its id " * 8, "en", "c", 9),
        (12, "repeated row with its id " * 8, "en", "c", 9),
        (13, " ".join(f"long{i % 4000}" for i in range(9000)), "en", "a", 9),
    ]


def odd(spark, extra=True):
    df = spark.createDataFrame(odd_rows(), KIND)
    if extra:  # names that operators use themselves
        df = df.selectExpr("*", "'z' AS size", "1 AS score", "2 AS kept", "'q' AS tid", "0 AS rid", "array(1) AS ids", "'k' AS key", "9 AS rank", "'t' AS target", "'h' AS spans")
    return df


def empty(spark):
    return spark.createDataFrame([], KIND)


def words(t):
    return re.findall(WORD, t or "")


def quality(t):
    w = words(t)
    g = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if g[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def runs_to_delete(docs, least):
    """Lines of each text that lie in a run of ``least`` words or more with an earlier copy."""
    seqs = [[(i, x, len(words(x))) for i, x in enumerate((t or "").split("\n")) if words(x)] for t in docs]
    gone = [set() for _ in docs]
    for a, s in enumerate(seqs):
        for i in range(len(s)):
            for b in range(a + 1):
                for j in range(len(seqs[b]) if b < a else i):
                    n = 0
                    while i + n < len(s) and j + n < len(seqs[b]) and s[i + n][1] == seqs[b][j + n][1]:
                        n += 1
                    if sum(x[2] for x in s[i : i + n]) >= least:
                        gone[a] |= set(range(s[i][0], s[i + n - 1][0] + 1))
    return [sorted(g) for g in gone]
