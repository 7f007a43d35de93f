"""Rows that every operator must bear: nulls, empty and long texts, ties, repeated rows, clashing columns."""

DOCS = "doc_id long, text string, lang string, key string, score double, language int, leaks string, secrets string, piece_ids string, runs string"


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, "k", 0.5, 7, "l", "s", "p", "r")


PROSE = "the quick brown fox jumps over the lazy dog while seven wizards mix potions in a quiet valley near the old stone bridge and nobody watches them"
GERMAN = "der schnelle braune Fuchs springt über den faulen Hund während sieben Zauberer in einem stillen Tal bei der alten Brücke Tränke mischen und niemand schaut zu"
ODD = [
    row(1, PROSE), row(2, PROSE), row(2, PROSE), row(3, None, None), row(4, ""), row(5, " \t\n "), row(6, PROSE + " again"), row(None, PROSE), row(7, "one two"), row(8, "one two"),
    row(9, (PROSE + "\n") * 400), row(10, GERMAN, "de"), row(11, "漢字 かな 🎉 é", None), row(12, "12 34 --- 56"), row(13, "x" * 5000), row(14, None, "de"),
]


def docs(spark, rows=ODD):
    return spark.createDataFrame(rows, DOCS)


def words(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
