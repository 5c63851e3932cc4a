"""Helpers that tests import by name (a module of its own: every ``conftest`` shares one name)."""


def rows(df, *cols):
    cols = cols or df.columns
    return sorted([tuple(r[c] for c in cols) for r in df.collect()], key=repr)
