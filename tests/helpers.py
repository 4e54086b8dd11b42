"""Row comparison shared by the tests."""


def rows(df, *columns):
    """Sorted plain tuples of the chosen columns."""
    chosen = df.select(*columns) if columns else df
    return sorted((plain(tuple(r)) for r in chosen.collect()), key=repr)


def plain(value):
    if isinstance(value, (tuple, list)):
        return tuple(plain(v) for v in value)
    return value


def files(spark, *pairs, project="p"):
    return spark.createDataFrame([(project, path, text) for path, text in pairs], "project string, path string, content string")
