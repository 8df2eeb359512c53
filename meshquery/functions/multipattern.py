"""Many fixed strings sought in a text at once: one automaton (Aho-Corasick) per Python worker, one pass per text, however many
strings there are."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_CHARACTERS = 16 << 20
_BUILT: dict[tuple, object] = {}


def _automaton(patterns: tuple[str, ...]):
    if patterns not in _BUILT:
        import ahocorasick

        machine, places = ahocorasick.Automaton(), {}
        for i, p in enumerate(patterns):
            places.setdefault(p, []).append(i)
        for p, where in places.items():
            machine.add_word(p, where)
        machine.make_automaton()
        _BUILT.clear()
        _BUILT[patterns] = (machine, len(places))
    return _BUILT[patterns]


def found_in(text: Column, patterns: list[str]) -> Column:
    """array<int> of the places in ``patterns`` of those that ``text`` contains, ascending; null for null. The strings travel to the
    workers by value, so they may have 16 million characters at most; none may be empty."""
    if not all(patterns):
        raise ValueError("an empty pattern is in every text")
    if sum(map(len, patterns)) > MOST_CHARACTERS:
        raise ValueError("too many patterns to send to every worker: join them in parts")
    sought = tuple(patterns)

    def search(texts: pa.Array) -> pa.Array:
        if not sought:
            return pa.array([None if t is None else [] for t in texts.to_pylist()], pa.list_(pa.int32()))
        machine, distinct = _automaton(sought)
        out = []
        for t in texts:
            said = t.as_py()
            if said is None:
                out.append(None)
                continue
            seen: dict[int, list[int]] = {}
            for _, where in machine.iter(said):
                if where[0] not in seen:
                    seen[where[0]] = where
                    if len(seen) == distinct:
                        break
            out.append(sorted(i for where in seen.values() for i in where))
        return pa.array(out, pa.list_(pa.int32()))

    search.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(search, "array<int>")(text)


def names_in(text: Column, patterns: list[str], names: list[str]) -> Column:
    """array<string>: the names of the patterns that ``text`` contains, each once, in the order of ``names``."""
    return F.array_distinct(F.transform(found_in(text, patterns), lambda i: F.element_at(F.array(*[F.lit(n) for n in names]), i + 1)))
