"""Rows of both engines in one comparable form."""

import datetime
import math


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.date().isoformat() if value.time() == datetime.time() else value.isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


def same(a, b) -> bool:
    """Equal rows; numbers of the two engines may differ in the last rounded digit."""
    close = lambda x, y: math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6) if isinstance(x, float) and isinstance(y, (int, float)) else x == y
    return len(a) == len(b) and all(all(map(close, x, y)) for x, y in zip(a, b, strict=True))
