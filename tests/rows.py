"""Rows of a DataFrame for comparisons."""


def table(df, *columns):
    """Rows as tuples, dates as text, in sorted order."""
    columns = columns or df.columns
    rows = [tuple(str(v) if hasattr(v, "isoformat") else v for v in r) for r in df.select(*columns).collect()]
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))
