"""Small tables with every odd case: nulls, empty and long texts, repeated rows,
columns whose names clash with those that operators make."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_ string, FP string, hits string, score string"


def docs(spark, rows):
    """rows: (doc_id, text[, lang])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), "x", "y", "z", "w") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


ODD = [(1, None), (2, ""), (3, "   \n\t "), (None, "no id here"), (4, "one"), (5, "same row"), (5, "same row"), (6, "long " * 30000), (7, "éü 中文 \U0001f600 \u0301x")]


def folder(tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)
