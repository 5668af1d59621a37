"""Small tables with the awkward rows that every operator must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, fp string, name string, row long"


def awkward(spark, texts, extra_null_id=True):
    rows = [(i, t, "en", "s", None if t is None else len(t), 7, "x", "n", 1) for i, t in enumerate(texts)]
    if extra_null_id:
        rows.append((None, "a row that has no id at all", None, None, None, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
