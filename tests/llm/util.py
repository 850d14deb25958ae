"""Small document tables with the awkward cases, and a folder of tables made of rows."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts):
    """texts: (doc_id, text) pairs; the other columns as in the given tables."""
    return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in texts], DOCS)


def folder(tmp_path, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]
