"""Sequence measures and program parsers that no native expression gives, as Arrow-batched functions."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the extended edit distance (jump, coverage, deletion, insertion).
JUMP, COVERAGE, DELETION, INSERTION = 2.0, 0.3, 0.2, 1.0
_LEX = re.compile(r"\\[A-Za-z@]+|\\.|%[^\n]*|[^\W\d_]+|\d+(?:\.\d+)?|\S", re.S)


#: From this length on, difflib ignores signs of the second text that are more frequent than one in a hundred, and one more.
LONG, FREQUENT = 200, 100
#: Matches of single signs, and different signs times pairs, that pairs whose blocks are sought together have at most; pairs
#: of that kind; bits of a place in a text.
MATCHES, RATIOS, PLACE = 1 << 22, 1_000, 21


def sequence_ratio(a: str | None, b: str | None) -> float | None:
    """2M/T of difflib's matching blocks, frequent characters of long texts ignored as it does by default; null if a side is."""
    return sequence_ratios([a], [b])[0]


def sequence_ratios(a: Iterable[str | None], b: Iterable[str | None]) -> list[float | None]:
    """sequence_ratio of pairs, many at a time; those with more MATCHES than that alone by difflib itself."""
    pairs = list(zip(a, b, strict=True))
    out: list[float | None] = [None] * len(pairs)
    some, matches = [], 0
    for k, (p, q) in enumerate(pairs):
        if p is None or q is None:
            continue
        most = (len(p) + 1) * ((len(q) // FREQUENT if len(q) >= LONG else len(q)) + 1)
        if max(most, len(q)) >= MATCHES >> 1:
            out[k] = difflib.SequenceMatcher(None, p, q).ratio()
            continue
        if len(some) == RATIOS or matches + most > MATCHES:
            _fill(out, some, pairs)
            some, matches = [], 0
        some.append(k)
        matches += most
    _fill(out, some, pairs)
    return out


def _fill(out: list[float | None], some: list[int], pairs: list[tuple[str, str]]) -> None:
    """_ratios of some pairs, put into their places; in halves if these have too many different signs."""
    if len(some) > 1 and len(some) * len(set().union(*(pairs[k][0] + pairs[k][1] for k in some))) > MATCHES:
        for half in (some[: len(some) // 2], some[len(some) // 2 :]):
            _fill(out, half, pairs)
    elif some:
        for k, ratio in zip(some, _ratios([pairs[k] for k in some]), strict=True):
            out[k] = ratio


def _ratios(pairs: list[tuple[str, str]]) -> list[float]:
    """Matches start from signs that are not ignored. The runs of such on each diagonal are listed once, and each block that is
    taken (the longest, then the first in a, then in b) passes on only what lies before it or behind it in both texts; the parts
    of all pairs go one level down together."""
    count = len(pairs)
    lengths = [np.array([len(p[side]) for p in pairs]) for side in (0, 1)]
    texts = [_codes("".join(p[side] for p in pairs)) for side in (0, 1)]
    begin = [np.cumsum(n) - n for n in lengths]
    known = np.zeros(max(int(t.max(initial=0)) + 1 for t in texts), bool)
    known[texts[0]] = known[texts[1]] = True
    of, signs = [np.repeat(np.arange(count), n) for n in lengths], int(known.sum())
    key = [k * signs + (np.cumsum(known) - 1)[t] for k, t in zip(of, texts, strict=True)]
    a, b = (np.append(t, np.uint32(0)) for t in texts)
    often = np.where(lengths[1] >= LONG, lengths[1] // FREQUENT + 1, lengths[1])
    times = np.bincount(key[1], minlength=count * signs)
    times[times > np.repeat(often, signs)] = 0
    places = np.flatnonzero(times[key[1]])
    places = places[np.argsort(key[1][places], kind="stable")]
    n = times[key[0]]
    i = np.repeat(np.arange(len(n)), n)
    j = places[np.repeat((np.cumsum(times) - times)[key[0]] - (np.cumsum(n) - n), n) + np.arange(len(i))]
    starts = (i == begin[0][of[0][i]]) | (j == begin[1][of[1][j]]) | (a[i - 1] != b[j - 1]) | (n[i - 1] == 0)
    i, j = i[starts], j[starts]
    run = np.ones(len(i), np.int64)
    stops = [x + y for x, y in zip(begin, lengths, strict=True)]
    part = of[0][i]
    taken = np.append(n, 0)

    def grown(i: np.ndarray, j: np.ndarray, most: np.ndarray, step: int, only: np.ndarray | None = None) -> np.ndarray:
        """How many signs from i and j on, forwards or backwards, are equal, and in `only`."""
        out, left = np.zeros(len(i), np.int64), np.flatnonzero(most > 0)
        for k in range(int(most.max(initial=0))):
            p, q = i[left] + step * k, j[left] + step * k
            same = a[p] == b[q]
            left = left[same if only is None else same & (only[p] > 0)]
            out[left] += 1
            left = left[most[left] > k + 1]
            if not len(left):
                break
        return out

    run += grown(i + 1, j + 1, np.minimum(stops[0][part] - i, stops[1][part] - j) - 1, 1, taken)
    pair, low, high, left, right = np.arange(count), begin[0], stops[0], begin[1], stops[1]
    total, full = np.zeros(count, np.int64), (1 << PLACE) - 1
    while len(pair):
        x, y, size = low.copy(), left.copy(), np.zeros(len(pair), np.int64)
        if len(part):
            heads = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            best = np.maximum.reduceat((run << 2 * PLACE) | ((full - (i - begin[0][pair[part]])) << PLACE) | (full - (j - begin[1][pair[part]])), heads)
            k = part[heads]
            x[k], y[k] = full - ((best >> PLACE) & full) + begin[0][pair[k]], full - (best & full) + begin[1][pair[k]]
            size[k] = best >> 2 * PLACE
        back = grown(x - 1, y - 1, np.where(size > 0, np.minimum(x - low, y - left), 0), -1)
        x, y, size = x - back, y - back, size + back
        size += grown(x + size, y + size, np.minimum(high - x, right - y) - size, 1)
        np.add.at(total, pair, size)
        end, stop = x + size, y + size
        upper, lower = (np.flatnonzero((size > 0) & c) for c in ((low < x) & (left < y), (end < high) & (stop < right)))
        named = np.full((2, len(pair)), -1)
        named[0, upper], named[1, lower] = np.arange(len(upper)), len(upper) + np.arange(len(lower))
        before = np.minimum(run, np.minimum(x[part] - i, y[part] - j))
        cut = np.maximum(0, np.maximum(end[part] - i, stop[part] - j))
        first, second = (np.flatnonzero((named[side, part] >= 0) & c) for side, c in ((0, before > 0), (1, run > cut)))
        i, j, run, part = (np.concatenate(c) for c in ((i[first], (i + cut)[second]), (j[first], (j + cut)[second]), (before[first], (run - cut)[second]), (named[0, part[first]], named[1, part[second]])))
        pair, low, high, left, right = (np.concatenate(c) for c in ((pair[upper], pair[lower]), (low[upper], end[lower]), (x[upper], high[lower]), (left[upper], stop[lower]), (y[upper], right[lower])))
    both = lengths[0] + lengths[1]
    return np.where(both > 0, 2.0 * total / np.maximum(both, 1), 1.0).tolist()


def tex_tokens(code: str | None) -> list[str]:
    """Lexer tokens of TeX: commands, words of any script, numbers, signs. Blanks and comments are left out."""
    return [t for t in _LEX.findall(code or "") if t[0] != "%"]


def tex_normal(code: str | None, language: str = "en") -> str:
    """Tokens between single blanks, one blank at either end. Japanese texts ('ja') are put into compatibility form first."""
    if language not in ("en", "ja"):
        raise ValueError(f"no rules for language {language!r}; there are en, ja")
    text = unicodedata.normalize("NFKC", code) if code and language == "ja" else code
    return between_blanks(tex_tokens(text))


def between_blanks(tokens: list[str]) -> str:
    return f" {' '.join(tokens)} "


#: Cells of the table that are worked on at the same time, by pairs of like length: what stays in a core's cache.
CELLS, BYTE_CELLS = 1 << 16, 1 << 18
#: Longest run without a blank, and most different signs, of the references and pairs whose cells fit bytes; what is above all cells.
RUN, SIGNS, ABOVE = 22, 255, 190
#: Doublings of shifts that all rows of bytes go through together.
NEAR = 6
#: All costs are whole numbers of UNIT, so that equal ones are equal.
UNIT = 0.2
_JUMP, _DELETION, _INSERTION = (round(c / UNIT) for c in (JUMP, DELETION, INSERTION))


def edit_distance(hypothesis: str, reference: str) -> float:
    """Extended edit distance of two texts in [0, 1]: edits with jumps at blanks, plus a penalty for places visited often."""
    return float(edit_distance_many([(hypothesis, reference)])[0])


def edit_distance_many(pairs: list[tuple[str, str]]) -> np.ndarray:
    """edit_distance of (hypothesis, reference) pairs, some at a time: one step over the reference serves all that are not at
    their end. Those of like length go together, so that little is padded. An empty reference is at distance 1.
    """
    out = np.ones(len(pairs))
    run = {i: max(map(len, r.split(" "))) for i, (_, r) in enumerate(pairs) if r}
    order = sorted(run, key=lambda i: -len(pairs[i][0]))
    rest = [i for i in order if run[i] > RUN]
    for some in _alike(pairs, [i for i in order if run[i] <= RUN], BYTE_CELLS):
        if (found := _byte_distances([pairs[i] for i in some])) is None:
            rest += some
        else:
            out[some] = found
    for some in _alike(pairs, sorted(rest, key=lambda i: -len(pairs[i][0])), CELLS):
        out[some] = _wide_distances([pairs[i] for i in some])
    return out


def _alike(pairs: list[tuple[str, str]], order: list[int], cells: int) -> Iterator[list[int]]:
    """The pairs in parts of so many cells a row, each in the falling order of its references' lengths."""
    at = 0
    while at < len(order):
        some = order[at : at + max(1, cells // (len(pairs[order[at]][0]) + 1))]
        at += len(some)
        yield sorted(some, key=lambda i: -len(pairs[i][1]))


def _distances(last: np.ndarray, unseen: np.ndarray, visits: np.ndarray, long: np.ndarray) -> np.ndarray:
    """From the last cells; unseen: places never visited; visits: those after a place's first."""
    penalty = COVERAGE * (visits + unseen)
    return np.minimum(1.0, (last * UNIT + penalty) / (long + penalty))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _byte_distances(pairs: list[tuple[str, str]]) -> np.ndarray | None:
    """Of pairs whose references, in falling order of length, have no run over RUN; none if there are more than SIGNS signs.

    After a blank no cell is more than a jump above its row's least, and k steps before one none over a jump and k insertions
    matters. Cells are held to that, less an insertion a step and with the least brought back up now and then, so that they fit
    bytes. Deletions behind an equal sign gain something only while they stay below both what was held and what will be; a few
    doublings of shifts have such runs, and a few more in those pairs that are within a long run of signs. Rows lie behind each
    other with gaps that deletions don't get across.
    """
    wide, long = (np.array([len(p[side]) for p in pairs]) for side in (0, 1))
    texts = [_codes("".join(p[side] for p in pairs)) for side in (0, 1)]
    known = np.zeros(max(33, *(int(t.max(initial=0)) + 1 for t in texts)), bool)
    known[texts[0]] = known[texts[1]] = known[32] = True
    numbers = np.cumsum(known)
    if numbers[-1] > SIGNS:
        return None
    numbers, count, steps = numbers.astype(np.uint8), len(pairs), int(long.max())
    reference, place = np.zeros((count, steps), np.uint8), np.arange(steps)
    reference[place < long[:, None]] = numbers[texts[1]]
    blank = reference == numbers[32]
    past = place - np.maximum.accumulate(np.where(blank, place, -1), axis=1)
    ahead = np.minimum.accumulate(np.where(blank, place, 1 << 20)[:, ::-1], axis=1)[:, ::-1] - place
    spread = _JUMP + _INSERTION * np.where(place < long[:, None], np.minimum(past, ahead), 0).max(0)
    reach = np.minimum(_JUMP + _INSERTION * past, _JUMP + _INSERTION * ahead) - 1  # of deletions, by place: past counts the place itself
    reach = np.where(place < long[:, None], np.maximum(reach, 0), 0).T
    near = [min(int(most).bit_length(), NEAR) for most in reach.max(1)]
    far, gap = [np.flatnonzero(most >= 1 << NEAR) for most in reach], 1 << max(near)
    lift = _INSERTION * max(1, (ABOVE - int(spread.max()) - 2 * _INSERTION) // _INSERTION)
    held = np.minimum(_JUMP + _INSERTION * ahead.T, 255).astype(np.int16)
    blank, reference = None, np.ascontiguousarray(reference.T)

    width = gap + int(wide.max()) + 1
    signs, row, other, same = (np.zeros((count, width), np.uint8) for _ in range(4))
    signs[:, gap + 1 :][np.arange(width - gap - 1) < wide[:, None]] = numbers[texts[0]]
    row[:, :gap], row[:, gap], row[:, gap + 1 :] = ABOVE, lift, lift + _INSERTION
    seen, starts, base = np.zeros(count * width, bool), np.arange(count) * width, np.full(count, -lift)
    active = np.searchsorted(-long, -place, side="left")
    shifts, gain = [np.uint8(_DELETION << k) for k in range(8)], np.uint8(_INSERTION)
    for step in range(steps):
        n = int(active[step])
        old, new, equal = (x.reshape(-1)[: n * width] for x in (row, other, same))
        np.copyto(other[:n], reference[step, :n, None])
        np.equal(signs.reshape(-1)[: n * width], new, out=equal.view(bool))
        np.multiply(equal, gain, out=equal)
        np.subtract(old[:-1], equal[1:], out=new[1:])
        np.minimum(old[1:], new[1:], out=old[1:])
        for k in range(near[step]):
            np.add(old[: -1 << k], shifts[k], out=new[1 << k :])
            np.minimum(old[1 << k :], new[1 << k :], out=old[1 << k :])
        if len(far[step]):
            some = row[far[step]]
            some[:, :gap] = ABOVE
            for k in range(NEAR, int(reach[step].max()).bit_length()):
                if width > 1 << k:
                    some[:, 1 << k :] = np.minimum(some[:, 1 << k :], some[:, : -1 << k] + shifts[k])
            row[far[step]] = some
        row[:n, :gap] = ABOVE
        least = row[:n].argmin(1)
        least += starts[:n]
        seen[least] = True
        lowest = old[least].astype(np.int16)
        np.copyto(other[:n], np.minimum(lowest + held[step, :n], 255).astype(np.uint8)[:, None])
        np.minimum(old, new, out=old)
        base[:n] += _INSERTION
        if (step + 1) % (lift // _INSERTION) == 0:
            row[:n] += (lift - lowest).astype(np.uint8)[:, None]
            row[:n, :gap] = ABOVE
            base[:n] -= lift - lowest
    places = seen.reshape(count, width).sum(1)
    return _distances(row[np.arange(count), gap + wide] + base, wide + 1 - places, long - places, long)


def _wide_distances(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Of any pairs, in falling order of their references' lengths.

    Rows are held less what a run of deletions up to each place costs; such a run is then a running minimum.
    """
    wide, long = (np.array([len(p[side]) for p in pairs]) for side in (0, 1))
    signs, reference = np.zeros((len(pairs), wide.max()), np.uint32), np.zeros((len(pairs), long.max()), np.uint32)
    for k, (h, r) in enumerate(pairs):
        signs[k, : wide[k]], reference[k, : long[k]] = _codes(h), _codes(r)
    width = wide.max() + 1
    short = _INSERTION * (long.max() + 1) + width < 14_000
    kind, most = (np.int16, 16_000) if short else (np.int32, 1 << 29)
    slope = np.arange(width, dtype=kind) * kind(_DELETION)
    shown = slope + np.where(np.arange(width) > wide[:, None], kind(most), kind(0))  # places beyond a text are never least
    visits = np.full((len(pairs), width), -1)
    row = np.full((len(pairs), width), _INSERTION, kind) - slope
    row[:, 0] = 0
    other, less, more, whole = kind(_INSERTION), kind(_DELETION), kind(_INSERTION), np.empty_like(row)
    active = np.searchsorted(-long, -np.arange(long.max()), side="left")
    every = np.arange(len(pairs))
    for step in range(long.max()):
        n = active[step]
        sign, old, new = reference[:n, step], row[:n], whole[:n]
        np.multiply(signs[:n] != sign[:, None], other, out=new[:, 1:])
        new[:, 1:] += old[:, :-1]
        new[:, 1:] -= less
        old += more
        np.minimum(old[:, 1:], new[:, 1:], out=old[:, 1:])
        np.minimum.accumulate(old, axis=1, out=old)
        np.add(old, shown[:n], out=new)
        least = new.argmin(1)
        visits[every[:n], least] += 1
        jump = np.flatnonzero(sign == 32)
        if len(jump):
            old[jump] = np.minimum(old[jump], (new[jump, least[jump]] + kind(_JUMP))[:, None] - slope)
    inside = np.arange(width) <= wide[:, None]
    return _distances(row[every, wide].astype(np.int64) + slope[wide], (inside & (visits < 0)).sum(1), np.where(inside, np.maximum(visits, 0), 0).sum(1), long)


def option_block(tail: str | None) -> str:
    """The bracketed option block that a text starts with, blanks before it skipped, brackets nested; '' if there is none."""
    text = (tail or "").lstrip()
    depth = 0
    for i, sign in enumerate(text):
        depth += (sign == "[") - (sign == "]")
        if i == 0 and depth == 0:
            return ""
        if depth == 0:
            return text[: i + 1]
    return ""


def _reflected(steps: np.ndarray) -> np.ndarray:
    """Running sums that are held at zero instead of falling below it."""
    sums = np.cumsum(steps)
    return sums - np.minimum.accumulate(np.minimum(sums, 0))


def statements(body: str | None) -> list[str]:
    """Elements of a picture's body, one per drawing statement or environment.

    Three depths are running sums over the lines: braces, environments and loops, the latter two held at zero. An element ends
    where a semicolon ends a line at which all of them are zero, and where an environment's end leaves no brace or environment
    open. A loop ends with any line that ends in a brace. A line that is both kinds of end gives an empty element after its own;
    lines behind the last end are an element if they aren't blank.
    """
    lines = (body or "").split("\n")
    bare = [x.strip() for x in lines]
    flag = lambda test: np.array([bool(test(x)) for x in bare], int)
    closing = flag(lambda x: x.startswith((r"\end{", r"\endscope")))
    braces = np.cumsum([x.count("{") - x.count("}") for x in lines])
    inside = _reflected(flag(lambda x: x.startswith((r"\begin{", r"\scope"))) - closing)
    loops = _reflected(flag(lambda x: x.startswith(r"\foreach")) - flag(lambda x: x.endswith("}")))
    outside = (braces == 0) & (inside == 0)
    ends = np.stack([outside & (closing > 0), outside & (loops == 0) & (flag(lambda x: x.endswith(";")) > 0)]).sum(0)
    cuts = [0, *np.repeat(np.arange(1, len(lines) + 1), ends), len(lines)]
    out = ["\n".join(lines[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]
    return out if out[-1].strip() else out[:-1]


def decompose(code: str | None) -> dict:
    """preamble, options and elements of a program; all empty without a document that holds a picture."""
    none = {"preamble": "", "options": "", "elements": []}
    start = (code or "").find(r"\begin{document}")
    at = code.find(r"\begin{tikzpicture}", start) if start >= 0 else -1
    end = code.rfind(r"\end{tikzpicture}") if at >= 0 else -1
    if end < at or at < 0:
        return none
    tail = code[at + len(r"\begin{tikzpicture}") : end]
    options = option_block(tail)
    body = tail.lstrip()[len(options) :] if options else tail
    return {"preamble": code[:at], "options": options, "elements": statements(body.strip("\n"))}


def sequence_ratio_column(a: Column, b: Column) -> Column:
    def batches(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in pairs:
            yield pd.Series(sequence_ratios(x, y), dtype="float64")

    return F.pandas_udf(batches, "double")(a, b)


def edit_distance_column(hypothesis: Column, reference: Column) -> Column:
    def batches(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in pairs:
            yield pd.Series(edit_distance_many([(tex_normal(p), tex_normal(q)) for p, q in zip(x, y, strict=True)]))

    return F.pandas_udf(batches, "double")(hypothesis, reference)


def tex_tokens_column(code: Column) -> Column:
    def batches(codes: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for c in codes:
            yield pd.Series([tex_tokens(x) for x in c], dtype=object)

    return F.pandas_udf(batches, "array<string>")(code)


def decompose_column(code: Column) -> Column:
    def batches(codes: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for c in codes:
            yield pd.DataFrame([decompose(x) for x in c], columns=["preamble", "options", "elements"])

    return F.pandas_udf(batches, "preamble string, options string, elements array<string>")(code)
