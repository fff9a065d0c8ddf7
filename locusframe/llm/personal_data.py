"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns (``base_spans``) find what is written in the usual way. The random
field finds the rest: candidate segments of up to LENGTH tokens are scored as
wholes (shape, digit groups, checksum, separators, edges, words before), and a
dynamic program over at most that length chooses boundaries and types together.
It learns from windows of the documents whose pattern spans are the labels, and
from the same windows with values written in other ways.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, with_columns

KINDS = ("email", "ip", "card", "phone")
OUTSIDE = len(KINDS)
#: Bounds of an entity: tokens, and characters on either side of a digit or at sign.
LENGTH, REACH = 20, 64
#: Bounds of the training sample: documents that are looked at, windows of each kind, characters of context, tokens.
DOCUMENTS, WINDOWS, CONTEXT, TOKENS = 20_000, 250, 40, 64
SHAPES, WORDS = 4096, 256
#: Tokens whose candidates are scored at once.
BLOCK = 10_000
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANCHOR = re.compile(r"@|[0-9]++|[\[({<] ?[Aa][Tt] ?[\])}>]|\b[Aa][Tt]\b(?=[^\n]{1,60}?(?:\b[Dd][Oo][Tt]\b|\w\.[A-Za-z]{2}))")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")


def luhn(digits: str) -> bool:
    """Whether the weighted sum of the digits is a multiple of ten."""
    values = [ord(c) - 48 for c in reversed(digits)]
    return (sum(values[::2]) + sum(2 * v - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of what the fixed patterns find, kind by kind, leftmost first; linear in the text."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            out.append(("email", start, found.end()))
            free = found.end()
        at = text.find("@", max(at + 1, free))
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) < 4 and int(p or 0) < 256 for part in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return out


# --- tokens and candidates --------------------------------------------------

#: Classes of tokens that stand for themselves, beside words, digits, marks for at and dot, and the rest.
_SIGNS = {c: i for i, c in enumerate("+()-/:,_[]{}<>%#$=*&!?;'\"|")}
_WORD, _DIGITS, _AT, _DOT, _OTHER = 40, 41, 42, 43, 44


@dataclass
class Tokens:
    """Tokens of regions of some texts, in order; ``region`` and ``row`` number where they are from."""

    region: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    kind: np.ndarray
    value: list[str]

    def __len__(self) -> int:
        return len(self.start)


def regions(text: str) -> list[tuple[int, int]]:
    """Parts of lines around digits, at signs and words for them."""
    out: list[tuple[int, int]] = []
    for m in _ANCHOR.finditer(text):
        a, b = m.span()
        left = max(0, a - REACH, text.rfind("\n", max(0, a - REACH), a) + 1)
        right = text.find("\n", b, b + REACH)
        right = min(len(text), b + REACH) if right < 0 else right
        if out and left <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], right))
        else:
            out.append((left, right))
    return out


def _token_kind(word: str) -> int:
    c = word[0]
    if "0" <= c <= "9":
        return _DIGITS
    if c == "@" or word in ("at", "AT", "At"):
        return _AT
    if c == "." or word in ("dot", "DOT", "Dot"):
        return _DOT
    return _WORD if c.isalpha() else _SIGNS.get(c, _OTHER)


def tokens(texts: list[str]) -> Tokens:
    region, row, start, end, value, n = [], [], [], [], [], 0
    for i, text in enumerate(texts):
        for a, b in regions(text):
            for m in _TOKEN.finditer(text, a, b):
                region.append(n)
                row.append(i)
                start.append(m.start())
                end.append(m.end())
                value.append(m.group())
            n += 1
    ints = lambda x: np.array(x, np.int64)
    return Tokens(ints(region), ints(row), ints(start), ints(end), ints([_token_kind(w) for w in value]), value)


@dataclass
class Candidates:
    first: np.ndarray  # number of the first token
    size: np.ndarray  # tokens
    features: np.ndarray  # one active feature of each template, in columns


#: Sizes of the templates of a candidate; the last two are hashed.
_TEMPLATES = np.array([22, LENGTH + 1, 8, 8, 8, 6, 8, 8, 6, 4, 4, 3, 3, 2, 2, 2, 3, 2, 2, 2, SHAPES, WORDS])
_OFFSETS = np.concatenate([[0], np.cumsum(_TEMPLATES)])


def candidates(tok: Tokens) -> Candidates:
    """Segments that may be an entity: of one region, with an at mark between others or at least four digits, and edges that entities have."""
    n = len(tok)
    if not n:
        return Candidates(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(_TEMPLATES)), np.int64))
    kind, size = tok.kind, tok.end - tok.start
    same = np.append(tok.region[1:] == tok.region[:-1], False)
    gap = np.append(np.where(same[:-1], tok.start[1:] - tok.end[:-1], 1), 1)  # after each token; an end of a region counts as one
    is_digit, is_word, mark = kind == _DIGITS, kind == _WORD, (kind == _AT) | (kind == _DOT)
    alnum = is_digit | is_word | (mark & (size > 1))
    total = lambda x: np.concatenate([[0], np.cumsum(x)])
    c_digit, c_group, c_word, c_at, c_dot = total(is_digit * size), total(is_digit), total(is_word), total(kind == _AT), total(kind == _DOT)
    sign = lambda s: np.isin(kind, [_SIGNS[x] for x in s])
    c_dash, c_round, c_square, c_plus, c_colon, c_odd = total(sign("-/")), total(sign("()")), total(sign("[]{}<>")), total(sign("+")), total(sign(":")), total(sign(",_%#$=*&!?;'\"|") | (kind == _OTHER))
    big = np.array([is_digit[i] and (size[i] > 3 or int(tok.value[i]) > 255) for i in range(n)])
    c_big = total(big)
    beside = mark | np.append(mark[1:], False)  # a gap next to a mark
    brackets = sign("[](){}<>")
    beside |= brackets | np.append(brackets[1:], False)
    stops = np.append(False, (kind[1:] == _DOT) & (size[1:] == 1) & (gap[:-1] == 0)) & (gap > 0) & (np.array([v[0] for v in tok.value]) == ".")
    beside &= ~stops  # a full stop of a sentence
    c_gap, c_apart = total(gap > 0), total((gap > 0) & ~beside)
    last_at = np.maximum.accumulate(np.where(kind == _AT, np.arange(n), -1))
    # What touches a segment from outside: a letter or digit, or a sign with one behind it.
    touch_left = np.append(False, (gap[:-1] == 0) & same[:-1] & (alnum[:-1] | np.isin(kind[:-1], [_SIGNS["-"], _SIGNS["/"], _SIGNS[":"], _SIGNS["_"], _SIGNS["+"], _DOT, _AT])))
    onward = np.append((gap[:-1] == 0) & same[:-1] & alnum[1:], False)
    touch_right = np.append((gap[:-1] == 0) & same[:-1] & (alnum[1:] | (onward[1:] & ~np.isin(kind[1:], [_SIGNS["("], _SIGNS["["]]))), False)
    code = np.where(is_digit, 100 + np.minimum(size, 20), np.where(mark & (size > 1), kind + 60, kind)) * 4 + np.minimum(gap, 2)
    code = mix(code.astype(np.uint64) + np.uint64(1))
    words = np.array([hash_word(w) for w in tok.value], np.int64) * is_word
    word_before = np.zeros(n, np.int64)
    for back in (1, 2, 3):  # the nearest word within three tokens
        near = np.append(np.zeros(back, np.int64), words[:-back])[:n]
        near[:back] = 0
        near[np.arange(n) >= back] *= (tok.region[back:] == tok.region[:-back])[: max(0, n - back)] if n > back else 1
        word_before = np.where(word_before == 0, near, word_before)
    head = np.where(is_digit, 0, np.where(is_word, 1, np.where(kind == _SIGNS["+"], 2, np.where(kind == _SIGNS["("], 3, 4))))
    tail = np.where(is_digit, 0, np.where(is_word & (size <= 6), 1, np.where(is_word, 2, 3)))
    shape, most, least, first_group = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.full(n, 99), np.zeros(n, np.int64)
    firsts, sizes, rows = [], [], []
    for d in range(1, LENGTH + 1):
        if d > n:
            break
        i, j = np.arange(n - d + 1), np.arange(d - 1, n)
        shape[i] = (shape[i] ^ code[j]) * np.uint64(0x9E3779B97F4A7C55)
        group = np.where(is_digit[j], size[j], 0)
        first_group[i] = np.where(first_group[i] == 0, group, first_group[i])
        most[i] = np.maximum(most[i], group)
        least[i] = np.where(is_digit[j], np.minimum(least[i], size[j]), least[i])
        span = lambda c: c[j + 1] - c[i]  # noqa: B023, E731
        digits, ats = span(c_digit), span(c_at)
        inner_at = (ats >= 1) & ~((kind[i] == _AT) | (kind[j] == _AT)) & (span(c_dot) >= 1)
        enough = inner_at & (ats == 1) & (tail[j] == 1) & (span(c_apart) - ((gap[j] > 0) & ~beside[j]) == 0)
        numeric = (digits >= 4) & (digits <= 20) & (span(c_word) == 0) & (ats == 0) & (tail[j] == 0)
        ok = (tok.region[i] == tok.region[j]) & (head[i] < 4) & (enough | numeric)
        at = np.flatnonzero(ok)
        if not len(at):
            continue
        i, j, digits = i[at], j[at], digits[at]
        groups, dots = span(c_group), span(c_dot)
        after = np.where(last_at[j] >= i, c_dot[j + 1] - c_dot[np.maximum(last_at[j], 0) + 1], 0)
        last_group = np.where(is_digit[j], size[j], 0)
        checked = np.zeros(len(at), np.int64)
        for k in np.flatnonzero((digits >= 13) & (digits <= 19) & (groups == span(c_group)) & (span(c_at) == 0)):
            checked[k] = 1 + luhn("".join(v for v in tok.value[i[k] : j[k] + 1] if "0" <= v[0] <= "9"))
        octets = (groups == 4) & (span(c_big) == 0) & (dots == 3)
        gaps = span(c_gap) - (gap[j] > 0)
        apart = span(c_apart) - ((gap[j] > 0) & ~beside[j])
        cap = lambda x, m: np.minimum(x, m)
        inside = np.stack([
            cap(digits, 21), np.full(len(at), d), cap(groups, 7), cap(most[i], 7), cap(np.where(least[i] == 99, 0, least[i]), 7), head[i], cap(first_group[i], 7), cap(last_group, 7), cap(dots, 5), tail[j],
            cap(span(c_dash), 3), cap(span(c_round), 2), cap(span(c_square), 2), cap(span(c_plus), 1), cap(span(c_colon), 1), cap(span(c_odd), 1), checked, octets.astype(np.int64), touch_left[i].astype(np.int64), touch_right[j].astype(np.int64),
            (mix(shape[i]) % np.uint64(SHAPES)).astype(np.int64), word_before[i],
        ], axis=1)
        inside[:, 8] = np.where(span(c_at) == 1, cap(after, 2) + 3 * (apart > 0), inside[:, 8])
        inside[:, 10] = np.where(span(c_at) == 1, cap(gaps, 3), inside[:, 10])
        firsts.append(i)
        sizes.append(np.full(len(at), d))
        rows.append(inside)
    if not firsts:
        return Candidates(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(_TEMPLATES)), np.int64))
    return Candidates(np.concatenate(firsts), np.concatenate(sizes), np.concatenate(rows) + _OFFSETS[:-1])


def hash_word(word: str) -> int:
    """A number from 1 to WORDS - 1 for a word, whatever its case."""
    value = 7
    for c in word[:12].lower():
        value = (value * 31 + ord(c)) % 1_000_003
    return 1 + value % (WORDS - 1)


# --- the random field --------------------------------------------------------


@dataclass(frozen=True)
class SemiCrf:
    weights: np.ndarray  # (features, kinds)
    transitions: np.ndarray  # (labels, labels), the last label being outside; from outside to outside is 0

    def scores(self, found: Candidates) -> np.ndarray:
        """Score of each kind for each candidate, the rest of the text having 0."""
        out = np.zeros((len(found.first), len(KINDS)))
        for at in range(0, len(out), 1 << 14):
            out[at : at + (1 << 14)] = self.weights[found.features[at : at + (1 << 14)]].sum(axis=1)
        return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def forward_backward(scores: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log normaliser, probabilities of segments and expected transitions of sequences of equal length.

    ``scores[b, i, d - 1, k]`` is that of the segment of d tokens from i on as
    kind k, minus infinity where it is none. A sequence starts and ends outside.
    """
    b, n, most, k = scores.shape
    alpha = np.full((b, n + 1, k + 1), -np.inf)
    alpha[:, 0, k] = 0.0
    into = np.full((b, n + 1, k + 1), -np.inf)  # what comes before a label at a place
    for t in range(n + 1):
        if t:
            alpha[:, t, k] = into[:, t - 1, k]
            d = np.arange(1, min(most, t) + 1)
            alpha[:, t, :k] = _lse(into[:, t - d, :k] + scores[:, t - d, d - 1], 1)
        into[:, t] = _lse(alpha[:, t, :, None] + transitions, 1)
    log_z = into[:, n, k]
    beta, out_of = np.full((b, n + 1, k + 1), -np.inf), np.full((b, n + 1, k + 1), -np.inf)
    out_of[:, n, k] = 0.0
    for t in range(n, -1, -1):
        if t < n:
            d = np.arange(1, min(most, n - t) + 1)
            out_of[:, t, :k] = _lse(scores[:, t, d - 1] + beta[:, t + d, :k], 1)
            out_of[:, t, k] = beta[:, t + 1, k]
        beta[:, t] = _lse(transitions + out_of[:, t, None, :], 2)
    with np.errstate(invalid="ignore"):
        moves = np.exp(alpha[:, :, :, None] + transitions + out_of[:, :, None, :] - log_z[:, None, None, None]).sum(axis=(0, 1))
    ends = np.minimum(np.arange(n)[:, None] + np.arange(1, most + 1), n)
    segments = np.exp(into[:, :n, None, :k] + scores + beta[:, ends, :k] - log_z[:, None, None, None])
    return log_z, segments, moves


def best_path(first: np.ndarray, size: np.ndarray, scores: np.ndarray, transitions: np.ndarray) -> list[tuple[int, int]]:
    """(candidate, kind) of the best segmentation of the stretch of one region that the candidates cover."""
    k = OUTSIDE
    ends: dict[int, list[int]] = {}
    for c in range(len(first)):
        ends.setdefault(int(first[c] + size[c]), []).append(c)
    # Best value of each label at each place, and how it came about: (candidate, label before, place before).
    start = int(first.min())
    value, how = {start: np.where(np.arange(k + 1) == k, 0.0, -np.inf)}, {}
    place = start
    for end in range(start + 1, max(ends) + 1):
        now, back = np.full(k + 1, -np.inf), [None] * (k + 1)
        step = value[place] + transitions[:, k]
        now[k], back[k] = step.max(), (None, int(step.argmax()), place)
        for c in ends.get(end, ()):
            step = value[int(first[c])][:, None] + transitions[:, :k]
            before = step.argmax(axis=0)
            got = step[before, np.arange(k)] + scores[c]
            for y in np.flatnonzero(got > now[:k]):
                now[y], back[y] = got[y], (c, int(before[y]), int(first[c]))
        value[end], how[end], place = now, back, end
    out, y = [], int((value[place] + transitions[:, k]).argmax())
    while place > start:
        c, before, earlier = how[place][y]
        if c is not None:
            out.append((c, y))
        y, place = before, earlier
    return out[::-1]


def train(samples: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = 80, rate: float = 0.15, decay: float = 2e-3) -> SemiCrf:
    """Maximum-likelihood training (Adam, all samples at once) on short texts with their spans.

    Samples of more than TOKENS tokens are cut there; spans that are no
    candidate (longer than LENGTH tokens, say) can't be learned and are left out.
    """
    tok = tokens([t for t, _ in samples])
    weights, transitions = np.zeros((_OFFSETS[-1], len(KINDS))), np.zeros((OUTSIDE + 1, OUTSIDE + 1))
    found = candidates(tok)
    if not len(found.first):
        return SemiCrf(weights, transitions)
    begin = np.flatnonzero(np.append(True, tok.region[1:] != tok.region[:-1]))
    place = np.arange(len(tok)) - begin[tok.region]
    inside = place[found.first] + found.size < TOKENS
    first, size, features = found.first[inside], found.size[inside], found.features[inside]
    # All is outside before the first candidate and after the last one, so only what is between counts.
    sequences = np.unique(tok.region[first], return_inverse=True)[1]
    at = place[first]
    start = np.full(sequences.max() + 1, TOKENS)
    np.minimum.at(start, sequences, at)
    at = at - start[sequences]
    lengths = np.zeros(len(start), np.int64)
    np.maximum.at(lengths, sequences, at + size)
    golden = {(row, a, b): KINDS.index(kind) for row, (_, spans) in enumerate(samples) for kind, a, b in spans}
    label = np.array([golden.get((int(tok.row[i]), int(tok.start[i]), int(tok.end[i + d - 1])), -1) for i, d in zip(first, size, strict=True)])
    target = np.zeros((len(first), len(KINDS)))
    target[label >= 0, label[label >= 0]] = 1.0
    chain = np.zeros_like(transitions)  # transitions of the labels; other tokens are outside
    labelled: list[list[tuple[int, int, int]]] = [[] for _ in start]
    for c in np.flatnonzero(label >= 0):
        labelled[sequences[c]].append((int(at[c]), int(size[c]), int(label[c])))
    for here in map(sorted, labelled):
        before, free = OUTSIDE, 0
        for a, d, y in here:
            chain[before if a == free else OUTSIDE, y] += 1
            if a != free:
                chain[before, OUTSIDE] += 1
            before, free = y, a + d
        chain[before, OUTSIDE] += 1
    parts = []  # sequences of like lengths, the places of their candidates, and their numbers there
    for group in np.array_split(np.argsort(lengths, kind="stable"), 8):
        number = np.full(len(start), -1)
        number[group] = np.arange(len(group))
        here = np.flatnonzero(number[sequences] >= 0)
        if len(here):
            parts.append((here, number[sequences[here]], len(group), int(lengths[group].max())))
    model = SemiCrf(weights, transitions)
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (weights, transitions)]
    for t in range(1, epochs + 1):
        wrong, moves = -target, np.zeros_like(transitions)
        scores = model.scores(Candidates(first, size, features))
        for here, number, many, n in parts:
            dense = np.full((many, n, LENGTH, len(KINDS)), -np.inf)
            dense[number, at[here], size[here] - 1] = scores[here]
            _, segments, expected = forward_backward(dense, transitions)
            wrong[here] += segments[number, at[here], size[here] - 1]
            moves += expected
        g = np.stack([np.bincount(features.ravel(), np.repeat(wrong[:, y], features.shape[1]), len(weights)) for y in range(len(KINDS))], axis=1)
        h = moves - chain
        h[OUTSIDE, OUTSIDE] = 0.0
        for x, grad, (m, v) in zip((weights, transitions), (g, h), moments, strict=True):
            grad = grad / len(start) + decay * x
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    return model


# --- what it learns from -----------------------------------------------------

#: Other ways of writing an at sign and a dot, and separators of digit groups.
_AT_SIGNS = (" at ", " [at] ", "[at]", "(at)", " (at) ", " @ ", " AT ")
_DOTS = (" dot ", "[dot]", "(dot)", " (dot) ", " [dot] ", ".", " . ", " DOT ")
_IP_DOTS = ("[.]", " . ", "(.)", " dot ", "[dot]", " [.] ")
_CARD_GAPS = (".", "  ", "/", "_", " - ", ":")
#: Telephone numbers without a plus sign: # is any digit, A one from 2 to 9.
_PHONES = (
    "(A##) A##-####", "A##-A##-####", "A##.A##.####", "(A##)A##-####", "(A##) A## ####", "1-A##-A##-####", "1 (A##) A##-####", "00A# A## ######", "00A# A# ########", "00A# (0)## ########", "00A#-A##-#######",
    "001 A## A## ####", "(0A##) ######", "0A## ### ## ##", "0A #### ####", "0A#-########", "+A#/A##/######", "A## A## ####",
)
#: Numbers and phrases that are no personal data: # is any digit, A one from 2 to 9, x a hexadecimal digit.
_PLAIN = (
    "20##-0A-1#", "1#/0A/20##", "1#.0A.20##", "1#:4#:3#", "20##-0A-1# 1#:4#:3#", "A.####", "A,###,###.##", "$A,###.##", "A.#.#", "vA.1#.#", "pp. A##-A##", "1###-20##", "####", "#####", "######", "A### ####", "A#########", "A## ### ###",
    "A##.A##", "A # # # # # # #", "xxxxxxxxxxxx", "xxxxxxxx-xxxx-xxxx-xxxx-xxxxxxxxxxxx", "97#-A-##-######-#", "ISBN 97#A#########", "A#%", "A##.A##.A##", "9##.9##.A##.A##", "####-####-####-####", "#### #### #### ####", "################",
    "A#, A#, A#, A#, A#", "#0#0 1### 20##", "No. A##-####", "at A:3#. The dot", "at A##.", "@home", "look at the dot", "one @ A.50", "at last. A dot of", "A##-####", "A#.A#, A#.A#", "1#-A#-#####", "§ A#.#.#", "A## x A##",
)


def _filled(rng: np.random.Generator, pattern: str) -> str:
    put = {"#": "0123456789", "A": "23456789", "x": "0123456789abcdef"}
    return "".join(put[c][rng.integers(len(put[c]))] if c in put else c for c in pattern)


def made_up(rng: np.random.Generator, kind: str, words: list[str]) -> tuple[str, str]:
    """A value of a kind and the same in another way of writing; for no kind, the same number twice."""
    pick = lambda x: x[int(rng.integers(len(x)))]
    if kind == "email":
        at, dot = pick(_AT_SIGNS), pick(_DOTS)
        name = [re.sub("[^a-z]", "", pick(words).lower()) or "kim" for _ in range(rng.integers(1, 3))]
        name[-1] += pick(("", "", str(rng.integers(99))))
        host = [re.sub("[^a-z]", "", pick(words).lower()) or "mail", pick(("com", "org", "net", "de", "info"))]
        host = [pick(("mail", "web")) + pick(("", "7")), *host] if rng.random() < 0.4 else host
        return ".".join(name) + "@" + ".".join(host), (dot if rng.random() < 0.5 else ".").join(name) + at + dot.join(host)
    if kind == "ip":
        parts = [str(rng.integers(1, 256)) for _ in range(4)]
        return ".".join(parts), pick(_IP_DOTS).join(parts)
    if kind == "card":
        short = rng.random() < 0.25
        digits = ("37" if short else "4") + "".join(str(rng.integers(10)) for _ in range(12 if short else 14))
        digits += next(c for c in "0123456789" if luhn(digits + c))
        gap = pick((" ", "-")) if short else pick(_CARD_GAPS)
        groups = [digits[:4], digits[4:10], digits[10:]] if short else [digits[i : i + 4] for i in range(0, 16, 4)]
        return " ".join(digits[i : i + 4] for i in range(0, 16, 4)) if not short else digits, gap.join(groups)
    if kind == "phone":
        return _filled(rng, "+1 (A##) A##-####"), _filled(rng, pick(_PHONES))
    plain = _filled(rng, pick(_PLAIN))
    return plain, plain


def lessons(windows: list[tuple[str, str, str, str]], seed: int = 11, made: int = 200) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Training texts with their spans from ``windows`` (kind or empty, text before, value, text after).

    Each window is used as it is, and ``made`` times for every kind, and four
    times as often for none, one of them with a made-up value in place of its own.
    """
    rng = np.random.default_rng(seed)
    words = sorted({w for _, a, _, b in windows for w in re.findall(r"[^\W\d_]{2,12}", f"{a} {b}")}) or ["alpha", "river", "stone", "maple"]
    contexts = [(a, b) for _, a, _, b in windows if not re.search(r"[0-9@]", a + b)] or [("", "")]
    out = [(a + v + b, [(kind, len(a), len(a) + len(v))] if kind else []) for kind, a, v, b in windows]
    for kind in (*KINDS, "", "", "", ""):
        for _ in range(made):
            a, b = contexts[int(rng.integers(len(contexts)))]
            if rng.random() < 0.3 or not a:
                a, b = (" ".join(words[int(i)] for i in rng.integers(len(words), size=4)) + x for x in (" ", ""))
                b = " " + b
            value, other = made_up(rng, kind, words)
            value = value if rng.random() < 0.2 else other
            a, b = a.rstrip() + " " if kind or rng.random() < 0.8 else a, (" " if rng.random() < 0.6 else ". ") + b.lstrip() if kind else " " + b.lstrip()
            out.append((a + value + b, [(kind, len(a), len(a) + len(value))] if kind else []))
    return out


def _windows_of(text: str) -> list[tuple[str, str, str, str]]:
    """(kind or empty, text before, value, text after) of the base spans of a text and of other numbers in it."""
    spans = sorted((a, b, kind) for kind, a, b in base_spans(text))
    out, seen = [], 0
    for a, b, kind in spans:
        if a >= seen:
            out.append((kind, a, b))
            seen = b
    taken = [(a, b) for a, b, _ in spans]
    out += [("", *m.span()) for m in re.finditer(r"[0-9]+", text) if not any(a < m.end() + CONTEXT and m.start() - CONTEXT < b for a, b in taken)]
    line = lambda part, left: part.rsplit("\n", 1)[-1] if left else part.split("\n", 1)[0]
    near = lambda a, b: sum(x < b + CONTEXT and a - CONTEXT < y for x, y in taken)
    return [(kind, line(text[max(0, a - CONTEXT) : a], True), text[a:b], line(text[b : b + CONTEXT], False)) for kind, a, b in out if b - a <= REACH and (not kind or near(a, b) == 1)]


def fit(docs: DataFrame, documents: int = DOCUMENTS, windows: int = WINDOWS) -> SemiCrf:
    """Train on at most ``windows`` windows of each kind, and of none, from about ``documents`` documents.

    Both are those with the smallest hash of their text, so the sample does
    not depend on partitioning, and repeated texts count once. Null texts have
    no windows. A table without personal data leaves the made-up values to
    learn from.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [w for text in batch.column("text").to_pylist() for w in _windows_of(text)]
            yield pa.RecordBatch.from_arrays([pa.array([w[k] for w in found], pa.string()) for k in range(4)], ["kind", "before", "value", "after"])

    rows = docs.where("text is not null").count()
    share = min(1.0, documents / max(rows, 1))
    place = F.pmod(F.xxhash64(F.col("text").cast("string"), F.lit(11)), F.lit(1 << 40))
    seen = docs.where(F.col("text").isNotNull() & (place < int(share * (1 << 40)))).select(F.col("text").cast("string").alias("text"))
    found = seen.mapInArrow(run, "kind string, before string, value string, after string").distinct().withColumn("place", F.xxhash64("before", "value", "after"))
    chosen = found.selectExpr("*", "row_number() over (partition by kind order by place, before, value, after) as n").where(F.col("n") <= windows).drop("n", "place")
    return train(lessons(sorted(map(tuple, chosen.collect()))))


# --- documents -----------------------------------------------------------------


def worthy(model: SemiCrf, tok: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First token, size and scores of the candidates that transitions could lift above the outside; the others are in no best path.

    Goes by blocks of tokens, so memory follows the worthy ones.
    """
    least, found = -4 * np.abs(model.transitions).max(), []
    for at in range(0, len(tok), BLOCK):
        a, b = max(0, at - 4), at + BLOCK + LENGTH + 4
        near = candidates(Tokens(tok.region[a:b], tok.row[a:b], tok.start[a:b], tok.end[a:b], tok.kind[a:b], tok.value[a:b]))
        scores = model.scores(near)
        kept = (near.first >= at - a) & (near.first < at - a + BLOCK) & (scores > least).any(axis=1)
        found.append((near.first[kept] + a, near.size[kept], scores[kept]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(KINDS)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def found_spans(model: SemiCrf, texts: list[str]) -> list[list[tuple[str, int, int, bool]]]:
    """(kind, start, end, base) of each text: the base spans, and what the random field finds outside of them."""
    out = [[(kind, a, b, True) for kind, a, b in base_spans(t)] for t in texts]
    tok = tokens(texts)
    free = np.ones(len(tok), bool)
    first_of_row = np.searchsorted(tok.row, np.arange(len(texts) + 1))
    for row, spans in enumerate(out):
        lo, hi = first_of_row[row], first_of_row[row + 1]
        for _, a, b, _ in spans:
            free[lo + np.searchsorted(tok.end[lo:hi], a, "right") : lo + np.searchsorted(tok.start[lo:hi], b, "left")] = False
    first, size, scores = worthy(model, tok)
    used = np.concatenate([[0], np.cumsum(~free)])
    ok = used[first + size] == used[first]
    first, size, scores = first[ok], size[ok], scores[ok]
    if not len(first):
        return out
    order = np.lexsort((size, first))
    first, size, scores = first[order], size[order], scores[order]
    region = tok.region[first]
    cuts = np.flatnonzero(np.append(True, region[1:] != region[:-1]))
    for a, b in zip(cuts, [*cuts[1:], len(first)], strict=True):
        for c, y in best_path(first[a:b], size[a:b], scores[a:b], model.transitions):
            i, j = first[a + c], first[a + c] + size[a + c] - 1
            out[int(tok.row[i])].append((KINDS[y], int(tok.start[i]), int(tok.end[j]), False))
    return out


def find(docs: DataFrame, model: SemiCrf, spans: str = "spans", masked: str | None = None) -> DataFrame:
    """Rows of ``docs`` with a column of spans (kind, start, end in code points, base) by kind as in KINDS, then start.

    With ``masked`` also a column of the text with every span replaced by its
    kind in angle brackets. Null texts have no spans and stay null when masked.
    Columns of these names are replaced, others stay as they are, whatever
    their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(*(c for c in (spans, masked) if c))
    added = T.StructType([T.StructField(spans, T._parse_datatype_string(SPANS)), *([T.StructField(masked, T.StringType())] if masked else [])])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def work(part: pa.RecordBatch) -> list[pa.Array]:
        texts = part.column("text").to_pylist()
        found = [sorted(s, key=lambda x: (KINDS.index(x[0]), x[1])) for s in found_spans(shared.value, [t or "" for t in texts])]
        columns = [pa.array([[dict(zip(("kind", "start", "end", "base"), x, strict=True)) for x in s] for s in found], kind)]
        if masked:
            columns.append(pa.array([None if t is None else mask(t, s) for t, s in zip(texts, found, strict=True)], pa.string()))
        return columns

    return with_columns(kept, work, added, 4 << 20)


def mask(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """The text with every span replaced; of overlapping ones the whole stretch, by the kind of the first."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, kind) for kind, a, b, _ in spans):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def report(docs: DataFrame, model: SemiCrf) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, and all spans as text, of every document.

    Null and empty texts have no spans; very long texts are searched whole, in
    time and memory that follow their length; equal rows give equal rows; an
    empty table gives an empty one; extra columns, whatever their names, are
    ignored.
    """
    rows = find(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *map(count, KINDS), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
