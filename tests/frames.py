"""Helpers of the core tests."""


def rows(df, *cols):
    """Rows as sorted tuples (NULL first)."""
    cols = cols or df.columns
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda t: tuple((v is not None, v) for v in t))
