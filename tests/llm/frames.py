"""Small tables with everything awkward in them."""

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# names that the operators use inside, as extra columns of the input
CLASHES = ("row", "k", "g", "size", "slot", "cls", "rank", "copies", "body", "key", "drop", "kept", "score", "words", "unit", "h1", "first",
           "bucket", "root", "n", "turns", "pieces", "sequence_id", "target", "held_out")

LONG = " ".join(f"word{i % 997} and more." for i in range(30_000))


def docs(spark, rows, clashes=True):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    return df.withColumns({c: F.lit(f"<{c}>") for c in CLASHES}) if clashes else df


LINE = "A line that is long enough to be a key of its own, Ends here."
EDGE = [
    (1, None, "a"), (2, "", "a"), (3, "one two", None), (None, "no key but a text of more than five words", "b"), (None, None, None),
    (5, LONG, "a"), (6, LONG + " tail", "a"), (7, "twice the same row of words", "b"), (7, "twice the same row of words", "b"),
    (8, "twice the same row of words", ""), (9, "\n\n", "b"), (10, "é ü – “quoted”   　 <|endoftext|> 'S ΣΑΣ ﬁ é", "b"),
    *[(20 + i, f"{LINE}\nown words {i}", "c") for i in range(6)], (30, f"  {LINE.upper()}\t", None),
]
