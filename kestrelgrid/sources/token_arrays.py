"""Calls and definitions of Elixir files whose tokens lie in an array: sums and neighbours by numpy, inside the row of a file.

The rules are those of ``elixir``: a window over the tokens of a file, level or bracket
is a sorted array here. Tokens become no rows, so none is written, sorted or shuffled
by Spark; only what was found leaves the row.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Tokens that are looked at together; files stay whole.
MOST_TOKENS = 200_000
#: Where a block without an end ends.
LAST = 2**31 - 1


_LETTERED, _ATTRIBUTE, _WORD = re.compile("~[a-zA-Z]"), re.compile("@[a-z_]"), re.compile(r"\w*[?!]?", re.ASCII)
KINDS = ("line", "space", "comment", "alias", "key", "atom", "string", "attribute", "number", "reserved", "name", "open", "close", "sign")
_NUMBER = {k: n for n, k in enumerate(KINDS)}


@functools.lru_cache(1 << 16)
def _word_kind(t: str, operators: tuple[str, ...]) -> int:
    return _NUMBER[kind(t, operators)]


def kind(t: str, operators: tuple[str, ...]) -> str:
    """What a token is, see ``elixir._kind``."""
    a = t[:1]
    if t == "\n":
        return "line"
    if not t.strip(" \t\r\f"):
        return "space"
    if a == "#":
        return "comment"
    if "A" <= a <= "Z":
        return "alias"
    if t.endswith(":") and (a in '_"' or unicodedata.category(a)[0] == "L"):
        return "key"
    if a == ":" and len(t) > 1 and not t.startswith("::"):
        return "atom"
    if a in "\"'" or _LETTERED.match(t):
        return "string"
    if _ATTRIBUTE.match(t):
        return "attribute"
    if "0" <= a <= "9" or (a == "?" and len(t) > 1):
        return "number"
    if (a == "_" or unicodedata.category(a) == "Ll") and _WORD.fullmatch(t, 1):
        return "reserved" if t in operators else "name"
    return "open" if t in ("(", "[", "{", "<<") else "close" if t in (")", "]", "}", ">>") else "sign"


def _shifted(x: np.ndarray, by: int, none) -> np.ndarray:
    """What stands ``by`` places further on."""
    out = np.full(len(x), none, x.dtype)
    if by > 0:
        out[:-by] = x[by:]
    else:
        out[-by:] = x[:by]
    return out


def key_of(*parts: np.ndarray) -> np.ndarray:
    """One number for several, in their order."""
    key = np.zeros(len(parts[0]), np.int64)
    for p in parts:
        if len(p):
            low = int(p.min())
            key = key * (int(p.max()) - low + 1) + (p - low)
    return key


class Tokens:
    """Significant tokens of lists of tokens, all in one array each; a token's name in the arrays is its place."""

    def __init__(self, lists: pa.Array, operators: tuple[str, ...]):
        coded = lists.flatten().dictionary_encode()
        self.texts, words, code = coded.dictionary, coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        file, begin = np.repeat(np.arange(len(lists)), sizes), np.repeat(np.cumsum(sizes) - sizes, sizes)
        # long tokens are few and seldom alike
        kinds = np.array([_word_kind(w, operators) if len(w) < 32 else _NUMBER[kind(w, operators)] for w in words], np.int8)
        of = lambda values: np.array(values or [0], np.int64)[code]
        kind_of = kinds[code]
        blank = kind_of <= _NUMBER["comment"]
        same = np.append(file[1:] == file[:-1], False)[: len(file)]
        kept = np.flatnonzero(~blank | (kind_of == _NUMBER["line"]))
        self._index, self._kinds = {w: n for n, w in enumerate(words)}, np.append(kind_of[kept], -1)
        self.file, self.code, self.at = file[kept], code[kept], (np.arange(len(file)) - begin)[kept]
        self.line = 1 + self._sums(of([w.count("\n") for w in words]), begin)[kept]
        self.pos = self._sums(of([len(w) for w in words]), begin)[kept]
        self.touches = (same & ~_shifted(blank, 1, True))[kept]
        self._codes = np.append(self.code, -1)
        comes = np.where(begin < np.arange(len(file)), _shifted(code, -1, -1), -1)[kept]
        n = len(kept)
        self.n, self.places = n, np.arange(n)
        self.begin = np.searchsorted(self.file, self.file)  # where a token's file begins
        reserved = self.kind("reserved") & ~self._texts(comes, ".")
        self.step = np.where(reserved & self.text("do", "fn"), 1, 0) - np.where(reserved & self.text("end"), 1, 0)
        turn = np.where(self.kind("open"), 1, 0) - np.where(self.kind("close"), 1, 0)
        self.level, self.depth = self._sums(self.step, self.begin), self._sums(turn, self.begin)
        self.before, self.after = self.near(-1), self.near(1)

    @staticmethod
    def _sums(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Of what stands before in the file."""
        total = np.cumsum(x) - x
        return total - total[begin] if len(x) else total

    def near(self, by: int) -> np.ndarray:
        """The places ``by`` tokens further on in the file, -1 where there are none."""
        to = self.places + by
        inside = (to >= self.begin) & (to < self.n)
        return np.where(inside & (self.file[np.clip(to, 0, max(self.n - 1, 0))] == self.file), to, -1) if self.n else to

    def _texts(self, code: np.ndarray, *texts: str) -> np.ndarray:
        wanted = np.zeros(len(self._index) + 1, bool)
        wanted[[self._index[w] for w in texts if w in self._index]] = True
        return wanted[code]

    def text(self, *texts: str, at: np.ndarray | None = None) -> np.ndarray:
        """Whether the tokens, or those at the places, are one of the texts; false without a place."""
        return self._texts(self.code, *texts) if at is None else self._texts(self.codes(at), *texts)

    def kind(self, *kinds: str, at: np.ndarray | None = None) -> np.ndarray:
        wanted = np.zeros(len(KINDS) + 1, bool)
        wanted[[_NUMBER[k] for k in kinds]] = True
        return wanted[self._kinds[:-1] if at is None else self._kinds[at]]

    def codes(self, at: np.ndarray) -> np.ndarray:
        return self._codes[at]

    def strings(self, code: np.ndarray) -> pa.Array:
        return self.texts.take(pa.array(code, pa.int64(), mask=code < 0))

    def values(self, x: np.ndarray, at: np.ndarray) -> pa.Array:
        """x at the places, null without one."""
        return pa.array(np.append(x, 0)[at].astype(np.int64), mask=at < 0)

    # --- what `elixir` finds by windows

    def starts(self, definitions: tuple[str, ...]) -> np.ndarray:
        first = (self.before < 0) | self.kind("line", at=self.before) | self.text(";", "do", "->", at=self.before)
        defines = self.kind("name") & self.text(*definitions, "defmodule", "defprotocol", "defimpl") & (self.kind("name", "alias", "reserved", at=self.after) | self.text("(", at=self.after))
        return first & (defines | (self.kind("name") & self.text("test", "describe") & self.kind("string", at=self.after)))

    def following(self, rows: np.ndarray, *by: np.ndarray) -> np.ndarray:
        """For each of the rows (places in order) the next one with the same values, else -1."""
        key = key_of(self.file[rows], *by)
        order = np.argsort(key, kind="stable")
        nxt = np.full(len(rows), -1)
        same = key[order][1:] == key[order][:-1]
        nxt[order[:-1][same]] = rows[order[1:][same]]
        return nxt

    def ends(self) -> np.ndarray:
        """What closes each do, at its place."""
        rows = np.flatnonzero(self.step)
        out = np.full(self.n, -1)
        out[rows] = np.where(self.step[rows] > 0, self.following(rows, self.level[rows] - (self.step[rows] < 0)), -1)
        return out

    def heads(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of definitions, of the do or do: of each, and of its end; -1 for none."""
        rows = np.flatnonzero(starts | (self.text("do") & (self.step == 1)) | self.text("do:"))
        body = self.following(rows, self.level[rows], self.depth[rows])
        body = np.where((body >= 0) & ~np.append(starts, True)[body], body, -1)
        mine = starts[rows]
        rows, body = rows[mine], body[mine]
        return rows, body, np.where((body >= 0) & np.append(self.text("do"), False)[body], np.append(self.ends(), -1)[body], -1)

    def modules(self, heads: np.ndarray, body: np.ndarray) -> np.ndarray:
        """Which of the definitions are modules with a block."""
        return self.text("defmodule", "defprotocol", "defimpl", at=heads) & self.kind("alias", at=self.after[heads]) & self.text("do", at=body)

    def around(self, rows: np.ndarray, heads: np.ndarray, body: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place of the innermost module around each of the rows, -1 outside all."""
        is_module = self.modules(heads, body)
        m, stop = heads[is_module], end[is_module]
        place = np.concatenate([rows, m, np.where(stop < 0, LAST, stop)])
        file = np.concatenate([self.file[rows], self.file[m], self.file[m]])
        delta = np.repeat([0, 1, -1], [len(rows), len(m), len(m)])
        order = np.lexsort((np.abs(delta), place, file))
        file, delta = file[order], delta[order]
        nth = self._sums(delta, np.searchsorted(file, file)) + (delta == 1)
        by_nth = np.argsort(key_of(file, nth), kind="stable")
        key = key_of(file, nth)[by_nth]
        begun = np.maximum.accumulate(np.where(delta[by_nth] == 1, np.arange(len(key)), -1)) if len(key) else key
        found = (begun >= np.searchsorted(key, key)) & (nth[by_nth] > 0)
        out = np.full(len(place), -1)
        out[order[by_nth]] = np.where(found, place[order[by_nth]][begun], -1)
        return out[: len(rows)]

    def arity(self) -> np.ndarray:
        """Of every opening bracket, at its place: what is behind it or a comma of its depth and level, all keywords as one; -1 if nothing closes it."""
        some = np.flatnonzero(~self.kind("line"))
        first = np.append(True, self.file[some][1:] != self.file[some][:-1])[: len(some)]
        before = np.where(first, -1, _shifted(some, -1, -1))
        opens, closes = self.kind("open"), self.kind("close")
        a = some[self.text("(", "[", "{", "<<", ",", at=before) & ~closes[some]]
        b = np.flatnonzero(opens | closes)
        place, depth = np.concatenate([a, b]), np.concatenate([self.depth[a], self.depth[b] + opens[b]])
        is_argument = np.arange(len(place)) < len(a)
        key = key_of(self.file[place], depth, self.level[place])
        order = np.lexsort((place, key))
        place, key, is_argument = place[order], key[order], is_argument[order]
        keyed = self.kind("key")[place]
        plain, keys = np.cumsum(is_argument & ~keyed), np.cumsum(is_argument & keyed)
        place, key, plain, keys = (x[~is_argument] for x in (place, key, plain, keys))
        same = np.append(key[1:] == key[:-1], False)[: len(key)]
        count = np.where(same, _shifted(plain, 1, 0) - plain + (_shifted(keys, 1, 0) > keys), -1)
        out = np.full(self.n, -1)
        out[place[opens[place]]] = count[opens[place]]
        return out

    def bare_arity(self, bare: np.ndarray, keyed: np.ndarray) -> np.ndarray:
        """Arguments of calls without brackets at the places, keyed if the first is a keyword: up to the line's end (unless a comma stands there), a block, a closing bracket or a branch."""
        some = np.flatnonzero(~self.kind("line"))
        first = np.append(True, self.file[some][1:] != self.file[some][:-1])[: len(some)]
        more = some[self.text(",", at=np.where(first, -1, _shifted(some, -1, -1)))]
        line_end = self.kind("line") & ~(self.text(",", at=self.before) | self.kind("sign", at=self.before))
        stop = line_end | self.kind("close") | self.text(";", "->", "do:") | (self.kind("reserved") & self.text("do", "end", "else", "after", "rescue", "catch"))
        stops = np.flatnonzero(stop)
        place = np.concatenate([more, stops, bare])
        role = np.repeat([0, 1, 2], [len(more), len(stops), len(bare)])
        own = np.concatenate([self.kind("key")[more], np.zeros(len(stops), bool), keyed])
        key = key_of(self.file[place], self.level[place], self.depth[place])
        order = np.lexsort((role, place, key))
        key, role, own = key[order], role[order], own[order]
        plain, keys = np.cumsum((role == 0) & ~own), np.cumsum((role == 0) & own)
        # the next stop of the level and depth
        k = np.arange(len(key))
        end = np.minimum.accumulate(np.where(role == 1, k, len(k))[::-1])[::-1] if len(k) else k
        found = (end < len(k)) & (np.append(key, -1)[end] == key)
        more_plain = np.where(found, np.append(plain, 0)[end] - plain, 0)
        more_keys = np.where(found, np.append(keys, 0)[end] > keys, False)
        count = more_plain + np.where(own, 0, 1) + np.where(own | more_keys, 1, 0)
        out = np.zeros(len(place), np.int64)
        out[order] = count
        return out[len(more) + len(stops) :]


def in_parts(lists: pa.Array, of: Callable[[pa.Array], tuple[np.ndarray, pa.StructArray]], kind_of_rows: pa.DataType) -> pa.Array:
    """For each list of tokens the list of what ``of`` finds in it: ``of`` gives the number of the list and a struct for each, in order."""
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    counts, rows, low = [np.zeros(1, np.int64)], [pa.array([], kind_of_rows)], 0
    while low < len(lists):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + MOST_TOKENS, side="right")))
        file, found = of(lists.slice(low, high - low))
        counts.append(np.bincount(file, minlength=high - low))
        rows.append(found.cast(kind_of_rows))
        low = high
    return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)), pa.int32()), pa.concat_arrays(rows))
