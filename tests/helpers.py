import decimal
import math


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, decimal.Decimal):
        return v.normalize()
    return v


def _key(r):
    return tuple((0, "") if v is None else (1, f"{v:.9e}" if isinstance(v, float) else str(v)) for v in r)


def _close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= 1e-9 * max(1.0, abs(a), abs(b))
    return a == b


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=_key)
    return [cols[i] for i in order], out


def assert_same(cols_a, rows_a, cols_b, rows_b):
    ca, ra = table(cols_a, rows_a)
    cb, rb = table(cols_b, rows_b)
    assert ca == cb, (ca, cb)
    assert len(ra) == len(rb), (len(ra), len(rb))
    for x, y in zip(ra, rb):
        assert all(_close(u, v) for u, v in zip(x, y)), (x, y)


def assert_df_equal(a, b):
    assert_same(a.columns, [tuple(r) for r in a.collect()], b.columns, [tuple(r) for r in b.collect()])
