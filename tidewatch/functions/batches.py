"""Arrow batches of sorted rows by key."""

from __future__ import annotations


def by_key(batches, key: list[str], told):
    """What `told` yields of each key's rows, dicts without the key, which come together."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            own = tuple(row.pop(k) for k in key)
            if own != now:
                if rows:
                    yield from told(rows)
                now, rows = own, []
            rows.append(row)
    if rows:
        yield from told(rows)
