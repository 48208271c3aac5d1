def rows(df):
    """Rows as sorted tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)


def values(df, column=0):
    return [r[column] for r in df.collect()]
