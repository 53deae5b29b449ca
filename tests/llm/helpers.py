"""Small awkward tables."""

LONG = " ".join(f"w{i}" for i in range(30_000))
TEXTS = [
    (5, "one two three four five six seven"),
    (3, "one two three four five six seven"),
    (9, "One two three four five six SEVEN"),
    (7, None),
    (1, ""),
    (2, " \n\t "),
    (4, "one two"),
    (8, LONG),
    (6, LONG + " tail"),
    (None, "one two three four five six seven"),
    (5, "one two three four five six seven"),
]


def documents(spark, rows=TEXTS):
    """Columns that clash with names the operators use, and nulls in all of them."""
    schema = "doc_id long, text string, key string, n long, sha string, component_id long, kept boolean, size int, score double"
    return spark.createDataFrame([(i, t, None, None, None, None, None, None, None) for i, t in rows], schema)
