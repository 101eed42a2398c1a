"""What every source has to keep to, as a check that a new source's tests call."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

from .paginated import Descriptor, Item, problems


def _well_formed(item: Item) -> bool:
    named = isinstance(item.external_id, str) and item.external_id and isinstance(item.url, str) and item.url.startswith("https://")
    return bool(named) and item.payload is not None and (item.posted_at is None or isinstance(item.posted_at, datetime.datetime))


def violations(make: Callable[[], tuple[Descriptor, Callable[..., Iterator[Item]]]], least: int = 1) -> list[str]:
    """Names of the rules that a source breaks.

    make gives a descriptor and items(limit=, stop=), as walk() is with its
    first two arguments set; it is called anew for each rule.
    """
    descriptor, scan = make()
    out = [f"descriptor: {p}" for p in problems(descriptor)]
    if not (descriptor.compliance_note or "").strip():
        out.append("descriptor: compliance_note")
    stream = scan(limit=100)
    if not hasattr(stream, "__next__"):
        out.append("not a stream")
    items = list(stream)
    ids = [i.external_id for i in items]
    again = [i.external_id for i in make()[1](limit=100)]
    stopped: list[Item] = []
    for item in make()[1](limit=100, stop=lambda: bool(stopped)):
        stopped.append(item)
    rules = {
        "too few items": len(items) >= least,
        "malformed item": all(map(_well_formed, items)),
        "repeated id": len(set(ids)) == len(ids),
        "over the limit": len(list(make()[1](limit=2))) <= 2,
        "items at limit 0": not list(make()[1](limit=0)),
        "goes on after stop": len(stopped) <= 1,
        "not the same again": ids == again,
    }
    return out + [name for name, kept in rules.items() if not kept]
