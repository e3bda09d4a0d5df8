def by_row(rows):
    """Rows in a fixed order, nulls allowed."""
    return sorted((tuple(r) for r in rows), key=repr)
