"""Documents that operators must survive: nulls everywhere, empty and long texts, ties, repeats, extra columns that clash."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, id string, part string"
LONG = "thea onder erin " * 20_000

ROWS = [
    (1, "Plain words stand here for a while and then some more of them.", "en", "a", 10, 1.0, "x", "y", "z"),
    (2, None, None, None, None, None, None, None, None),
    (3, "", "en", "a", 0, 1.0, "x", "y", "z"),
    (4, LONG, "en", "a", len(LONG), 1.0, "x", "y", "z"),
    (5, LONG, "de", "b", len(LONG), 1.0, "x", "y", "z"),
    (6, "Plain words stand here for a while and then some more of them.", "en", "a", 10, 1.0, "x", "y", "z"),
    (6, "Plain words stand here for a while and then some more of them.", "en", "a", 10, 1.0, "x", "y", "z"),
    (None, "A row without an id, but with words of its own kind in it.", "en", None, 5, None, None, None, None),
    (8, "12345 !!! ---", None, "c", 13, 1.0, None, None, None),
    (9, "é日本語🙂 straße naïve", "fr", "c", 13, 1.0, None, None, None),
    (10, " \t\n ", "fr", "c", 3, 1.0, None, None, None),
]


def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
