"""Exact, memoised encoding of whole Arrow columns with a ``tokenizers`` vocabulary.

Both public vocabularies split a text at white space before any merge is applied, so a text's ids are the
concatenation of the ids of its white-space separated units. A batch is cut into units by Arrow, each distinct
unit is encoded once by the ``tokenizers`` library and memoised per worker, and ids are gathered with NumPy.
Texts where a cut would not be exact are encoded whole.
"""

from __future__ import annotations

from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import quiet_threads

#: Memoised units per worker; beyond it the memo starts anew (memory bound, results unchanged).
MEMO_UNITS = 800_000

_SPACE = r"\pZ\s\x0b\x1c-\x1f\x{85}"
#: White space other than single blanks and line feeds between other characters, the cut mark itself, or what may be a special token.
_IRREGULAR = (
    rf"\A[{_SPACE}]|[{_SPACE}]\z|[{_SPACE}][{_SPACE}]|[\t\r\f\x0b\x1c-\x1f\x{{85}}\x00]"
    r"|[\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|<\|"
)

_LOADED: dict[str, "Encoder"] = {}


class Encoder:
    """``encode(strings) -> (flat ids, lengths)``; ids equal ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str):
        quiet_threads()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.lower = "Lowercase" in str(self.tokenizer.normalizer)
        words = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(words.values()) + 1, dtype=bool)
        self.edge[[i for w, i in words.items() if (w.endswith("</w>") if self.lower else w.startswith("\u0120"))]] = True
        self._clear()

    def _clear(self) -> None:
        self.memo: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 14, dtype=np.int32)
        self.size = np.zeros(1 << 14, dtype=np.int32)

    def _joined(self, units: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Units of letters only, encoded as one string: each has one id at its end (or start) that no other place has."""
        ids = np.array(self.tokenizer.encode_batch_fast([(" " if self.lower else "").join(units)], add_special_tokens=False)[0].ids, dtype=np.uint32)
        edges = np.flatnonzero(self.edge[ids])
        if len(edges) != len(units):
            return None
        bounds = np.concatenate([[0], edges + 1]) if self.lower else np.concatenate([edges, [len(ids)]])
        return (ids, np.diff(bounds)) if bounds[0] == 0 and bounds[-1] == len(ids) else None

    def _learn(self, units: list[str]) -> None:
        plain = [u.isalpha() if self.lower else u[:1] == " " and u[1:].isalpha() for u in units]
        for units, joined in (([u for u, p in zip(units, plain, strict=True) if p], True), ([u for u, p in zip(units, plain, strict=True) if not p], False)):
            for at in range(0, len(units), 2_000):
                self._keep(units[at : at + 2_000], joined)

    def _keep(self, part: list[str], joined: bool) -> None:
        if got := self._joined(part) if joined else None:
            flat, sizes = got
        else:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            flat = np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(sizes.sum()))
        self._put(part, flat, sizes)

    def _put(self, part: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        n, k = len(self.memo), len(part)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while n + k > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.pool[self.used : self.used + len(flat)] = flat
        self.size[n : n + k] = sizes
        self.start[n : n + k] = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        self.memo.update(zip(part, range(n, n + k), strict=True))

    def _units(self, texts: pa.Array) -> pa.ListArray:
        if self.lower:  # white space is dropped by this vocabulary: units are bare words
            texts = pc.ascii_lower(texts)
            texts = pc.replace_substring(texts, "\n", " ")
            texts = pc.replace_substring_regex(texts, r"(\p{L})([,.])(?:\x20|\z)", r"\1 \2 ")
            return pc.split_pattern(texts, " ")
        texts = pc.replace_substring(texts, " ", "\0 ")
        texts = pc.replace_substring(texts, "\n", "\0\n")
        texts = pc.replace_substring_regex(texts, r"(\p{L})([,.])(\x00|\z)", "\\1\0\\2\\3")
        return pc.split_pattern(texts, "\0")

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """``texts``: Arrow strings without nulls. With ``end_id``, that id follows each text's own."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        # Compacted first: Arrow's ascii_lower misreads slices.
        texts = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string())
        if len(self.memo) > MEMO_UNITS:
            self._clear()
        whole = np.flatnonzero(pc.match_substring_regex(texts, _IRREGULAR).to_numpy(zero_copy_only=False))
        cut = texts
        if len(whole):
            mask = np.zeros(len(texts), dtype=bool)
            mask[whole] = True
            cut = pc.if_else(pa.array(mask), pa.scalar("", pa.large_string()), texts)
        lists = self._units(cut)
        per_text = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        memo = self.memo
        at = np.fromiter(map(memo.get, names, repeat(-1)), dtype=np.int32, count=len(names))
        new = np.flatnonzero(at < 0)
        if len(new):
            new_names = [names[i] for i in new]
            self._learn(new_names)
            at[new] = np.fromiter(map(memo.get, new_names), dtype=np.int32, count=len(new))
        unit = at[coded.indices.to_numpy(zero_copy_only=False)] if len(names) else np.zeros(0, dtype=np.int32)
        if end_id is not None:  # one more unit per text
            if (end_unit := memo.get(f"\0end {end_id}", -1)) < 0:
                self._put([f"\0end {end_id}"], np.array([end_id], dtype=np.uint32), np.ones(1, dtype=np.int64))
                end_unit = len(memo) - 1
            unit = np.insert(unit, np.cumsum(per_text), np.int32(end_unit))
            per_text = per_text + 1
        sizes = self.size[unit]
        ends = np.cumsum(sizes, dtype=np.int32)  # a slice's ids are few enough
        place = np.repeat(self.start[unit] - (ends - sizes), sizes)
        place += np.arange(len(place), dtype=np.int32)
        flat = self.pool[place]
        bounds = np.concatenate([[0], np.cumsum(per_text)])
        ends0 = np.concatenate([[0], ends]).astype(np.int64)
        lengths = ends0[bounds[1:]] - ends0[bounds[:-1]]
        if len(whole):
            own = [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(pc.take(texts, pa.array(whole)).to_pylist(), add_special_tokens=False)]
            parts, last = [], 0
            starts = np.concatenate([[0], np.cumsum(lengths)])
            for i, ids in zip(whole, own, strict=True):
                end = starts[i + 1] - (end_id is not None)  # its end id stays
                parts += [flat[last : starts[i]], ids]
                last = end
                lengths[i] = len(ids) + (end_id is not None)
            flat = np.concatenate([*parts, flat[last:]])
        return flat, lengths


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def slices(batch: pa.RecordBatch, text: str = "text", rows: int = 4000, chars: int = 8_000_000):
    """The batch in pieces of bounded text, so that one piece's arrays stay small."""
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(size):
        if i > start and (i - start >= rows or total + n > chars):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)
