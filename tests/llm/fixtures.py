"""Small tables with what the operators must stand: nulls, empties, ties, repeated rows, clashing columns; and plain references."""

import random
import re

WORDS = "the of and to in is was for on with by from that this are or as be at it".split()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def prose(r, n, alphabet="abcdefghijklmnop"):
    return " ".join("".join(r.choice(alphabet) for _ in range(r.randint(2, 6))) if r.random() < 0.7 else r.choice(WORDS) for _ in range(n))


def documents(seed=3, n=120):
    """Rows (doc_id, text, lang, source, n_chars) with near copies, exact copies and the odd ones."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        kind = r.random()
        if rows and kind < 0.35:
            words = (r.choice(rows)[1] or "a b c").split(" ")
            for _ in range(r.randint(0, max(1, len(words) // 18))):
                words[r.randrange(len(words))] = r.choice(("Xx", "yy", "zz", "qq"))
            text = " ".join(words)
        else:
            text = prose(r, r.choice((3, 8, 30, 80, 150)))
        rows.append((i, text, r.choice(("en", "de", None)), r.choice(("a", "b", "c", None)), len(text)))
    rows += [(n, None, "en", "a", None), (n + 1, "", "de", None, 0), (n + 2, " \t\n", None, "b", 3), (n + 3, "One", "en", "é", 3), (None, rows[0][1], "en", "a", 5), rows[1], rows[1], (n + 4, "9 % 8", "en", "b", 5)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)
