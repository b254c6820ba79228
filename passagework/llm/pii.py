"""Personal data: exact detectors, and a character-level BiLSTM-CRF that adds spans.

The detectors find e-mail addresses, IPv4 addresses, card numbers and phone numbers. The
model is trained in numpy, in one task, from windows of a bounded sample of texts whose
spans the detectors label, and of made-up lines labelled by construction, so that small corpora train it too.

Every character of every text is read by overlapping windows; where windows overlap, their scores
are averaged with weights that fall towards a window's ends, and the CRF decodes the text as a
whole. Its best path is found without a step for each character: a bound on what leaving tag 0 can gain shows
where the path is surely outside, and only the rest is decoded, very long stretches block by block. Spans that overlap a detector's, or that
the CRF is not sure of, are dropped.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import sys
import unicodedata
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, small_batches, staged, tidy

KINDS = ("email", "ip", "card", "phone")
#: Training windows, and how far from a digit or @ they lie; windows in which texts are read, and how far they overlap.
REACH, TRAINED = 24, 64
WINDOW, OVERLAP = 512, 32
STRIDE = WINDOW - OVERLAP
#: Documented bounds of the training sample, and the network's size.
SAMPLE_WINDOWS, MADE_WINDOWS, EPOCHS, BATCH = 1_024, 512, 12, 32
#: Windows without a digit or @ from the corpus, and invented ones of spelled-out data.
PLAIN_WINDOWS, SPELLED_WINDOWS = 768, 2_048
#: Characters whose scores are held at once, and windows that go through the network together.
PIECE, TOGETHER = 1_024 * STRIDE, 512
#: Texts that are read at once.
TEXTS = 500
#: Characters of a region that are decoded at once, of a span that are held against their marginals at once, and text to the sides that these see.
BLOCK, SPAN_PART, AROUND = 256, 320, 64
EMBEDDED, HIDDEN, SYMBOLS = 8, 12, 130
#: Least marginal probability that each character of an added span must have.
SURE = 0.8

Span = tuple[int, int, int]  # kind, start, end

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")  # a match, and so the next try, ends with a run of digits
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARKS = re.compile(r"[0-9@]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """From each @ to the left over the local part, to the right over the domain; linear in the text."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            yield 0, start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def detected(text: str) -> list[Span]:
    """Spans of the four kinds, by kind, then place: leftmost matches without overlap in a kind, less those that fail its test."""
    found = list(emails(text)) if "@" in text else []
    if not MARKS.search(text):
        return found
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.groups()):
            found.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15:
            found.append((3, m.start(), m.end()))
    return found


def stretches(text: str) -> list[tuple[int, int]]:
    """The parts of a text within REACH of a digit or @, merged where they touch."""
    out: list[tuple[int, int]] = []
    for m in MARKS.finditer(text):
        start, end = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def ascii_of(c: str) -> str:
    """A decimal digit of any script as its ASCII digit, a full-width sign as the sign."""
    return str(unicodedata.decimal(c)) if c.isdecimal() else chr(ord(c) - 0xFEE0) if "\uff01" <= c <= "\uff5e" else c


SYMBOL = np.full(sys.maxunicode + 1, 129, np.uint8)
SYMBOL[:128] = np.arange(1, 129)
for _c in [chr(n) for n in range(128, sys.maxunicode + 1) if 0xFF01 <= n <= 0xFF5E or chr(n).isdecimal()]:
    SYMBOL[ord(_c)] = ord(ascii_of(_c)) + 1


def symbols(text: str) -> np.ndarray:
    """1 to 128 for ASCII, and for the digits and full-width signs that stand for it, 129 for all else; 0 fills windows up."""
    return SYMBOL[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]


def tags(n: int, spans: list[Span], offset: int) -> np.ndarray:
    """0 outside, 1 + 2 kind for the first character of a span, 2 + 2 kind for its others."""
    out = np.zeros(n, np.int64)
    for kind, start, end in spans:
        start, end = start - offset, end - offset
        if start < n and end > 0:
            out[max(0, start) : end] = 2 + 2 * kind
            if start >= 0:
                out[start] = 1 + 2 * kind
    return out


TAGS = 1 + 2 * len(KINDS)


def sensible() -> np.ndarray:
    """Which tags may follow each tag (the last row: the start): a span begins outside, and goes on in its own kind."""
    first = 1 + 2 * np.arange(len(KINDS))
    yes = np.zeros((TAGS + 1, TAGS), bool)
    yes[:, 0] = yes[0, first] = yes[-1, first] = True
    yes[first, first + 1] = yes[first + 1, first + 1] = True
    return yes


@dataclass
class Network:
    """Embedding, an LSTM in each direction, a linear layer, CRF transitions (the last row: from the start).

    Gates and states are piecewise linear, which numpy computes in a fraction of the time of exp and tanh."""

    embed: np.ndarray
    into: np.ndarray  # direction, embedded + hidden + 1, 4 hidden
    out: np.ndarray
    moves: np.ndarray

    @classmethod
    def new(cls, seed: int, kind: type = np.float32) -> Network:
        rng = np.random.default_rng(seed)
        into = rng.normal(0, 0.2, (2, EMBEDDED + HIDDEN + 1, 4 * HIDDEN))
        into[:, -1] = 0
        into[:, -1, HIDDEN : 2 * HIDDEN] = 1  # forget gates open
        made = rng.normal(0, 0.3, (SYMBOLS, EMBEDDED)), into, rng.normal(0, 0.2, (2 * HIDDEN + 1, TAGS)), np.where(sensible(), 0.0, -4.0)
        return cls(*(m.astype(kind) for m in made))

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.into, self.out, self.moves]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Scores (time, batch, tag) of symbols (batch, time), and what backward() needs."""
        (b, t), kind = x.shape, self.embed.dtype
        seen = np.ones((2, t, b, EMBEDDED + HIDDEN + 1), kind)
        seen[0, :, :, :EMBEDDED] = self.embed[x.T]
        seen[1, :, :, :EMBEDDED] = self.embed[x.T[::-1]]
        gates, cells, states = np.empty((t, 2, b, 4 * HIDDEN), kind), np.zeros((t + 1, 2, b, HIDDEN), kind), np.zeros((t + 1, 2, b, HIDDEN), kind)
        h = HIDDEN
        for n in range(t):
            seen[:, n, :, EMBEDDED:-1] = states[n]
            z = seen[:, n] @ self.into
            z[..., : 3 * h] = np.clip(z[..., : 3 * h] / 4 + 0.5, 0, 1)
            z[..., 3 * h :] = np.clip(z[..., 3 * h :], -1, 1)
            gates[n] = z
            cells[n + 1] = z[..., h : 2 * h] * cells[n] + z[..., :h] * z[..., 3 * h :]
            states[n + 1] = z[..., 2 * h : 3 * h] * np.clip(cells[n + 1], -1, 1)
        both = np.concatenate([states[1:, 0], states[:0:-1, 1], np.ones((t, b, 1), kind)], axis=2)
        return both @ self.out, (x, seen, gates, cells, both)

    def backward(self, d_scores: np.ndarray, kept: tuple) -> list[np.ndarray]:
        x, seen, gates, cells, both = kept
        t, h = len(gates), HIDDEN
        d_out = np.tensordot(both, d_scores, ([0, 1], [0, 1]))
        d_both = d_scores @ self.out.T
        d_in, d_seen = np.zeros_like(self.into), np.zeros_like(seen)
        d_state, d_cell = np.zeros_like(cells[0]), np.zeros_like(cells[0])
        for n in range(t - 1, -1, -1):
            d_state[0] += d_both[n, :, :h]
            d_state[1] += d_both[t - 1 - n, :, h : 2 * h]
            i, f, o, g = (gates[n][..., k * h : (k + 1) * h] for k in range(4))
            c = np.clip(cells[n + 1], -1, 1)
            d_cell = d_cell + d_state * o * (np.abs(c) < 1)
            slope = lambda gate: ((gate > 0) & (gate < 1)) * gate.dtype.type(0.25)
            d_z = np.concatenate([d_cell * g * slope(i), d_cell * cells[n] * slope(f), d_state * c * slope(o), d_cell * i * (np.abs(g) < 1)], axis=-1)
            d_in += seen[:, n].transpose(0, 2, 1) @ d_z
            d_seen[:, n] = d_z @ self.into.transpose(0, 2, 1)
            d_state, d_cell = d_seen[:, n, :, EMBEDDED:-1].copy(), d_cell * f
        d_embed = np.zeros_like(self.embed)
        np.add.at(d_embed, x.T, d_seen[0, :, :, :EMBEDDED] + d_seen[1, ::-1, :, :EMBEDDED])
        return [d_embed, d_in, d_out]

    def marginals(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log partition (batch), tag marginals (time, batch, tag), and expected transitions, by forward and backward sums scaled at each step."""
        t = len(scores)
        top = scores.max(axis=2, keepdims=True)
        here, step = np.exp(scores - top), np.exp(self.moves)
        ahead, back, scale = np.empty_like(here), np.ones_like(here), np.empty((t, scores.shape[1], 1))
        for n in range(t):
            ahead[n] = here[n] * (ahead[n - 1] @ step[:-1] if n else step[-1])
            scale[n] = ahead[n].sum(axis=1, keepdims=True)
            ahead[n] /= scale[n]
        for n in range(t - 2, -1, -1):
            back[n] = (here[n + 1] * back[n + 1]) @ step[:-1].T / scale[n + 1]
        chance = ahead * back
        expected = np.zeros_like(self.moves)
        expected[:-1] = step[:-1] * np.tensordot(ahead[:-1], here[1:] * back[1:] / scale[1:], ([0, 1], [0, 1]))
        expected[-1] = chance[0].sum(axis=0)
        return (np.log(scale) + top).sum(axis=(0, 2)), chance, expected

    def gradient(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean negative log-likelihood of the tags y (batch, time)."""
        scores, kept = self.forward(x)
        _, d_scores, d_moves = self.marginals(scores)
        b, t = y.shape
        d_scores[np.arange(t)[:, None], np.arange(b), y.T] -= 1
        np.add.at(d_moves, (y[:, :-1], y[:, 1:]), -1)
        np.add.at(d_moves, (TAGS, y[:, 0]), -1)
        return [g / b for g in (*self.backward(d_scores, kept), d_moves)]

    def train(self, x: np.ndarray, y: np.ndarray, seed: int) -> None:
        rng = np.random.default_rng(seed)
        first, second = ([np.zeros_like(p) for p in self.parameters()] for _ in range(2))
        step, steps = 0, EPOCHS * -(-len(x) // BATCH)
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                some = order[at : at + BATCH]
                step += 1
                rate = 0.02 * (1 - step / (steps + 1))
                for p, g, m, v in zip(self.parameters(), self.gradient(x[some], y[some]), first, second):
                    g = np.clip(g, -5, 5)
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def scores(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """Scores (time, tag) of each of the windows codes[start : start + size], longest first, in single precision.

        Windows lie innermost, and each step works, in both directions at once,
        on those that are still running, so no window is filled up; the backward direction reads each from its own end.
        What a step reads stays in the cache, as only its scores are kept. Those of windows of one length meet before they are turned."""
        h, most, n, even = HIDDEN, int(sizes[0]), len(sizes), sizes[0] == sizes[-1]
        into = np.ascontiguousarray(self.into.transpose(0, 2, 1), np.float32)
        into[:, : 3 * h] /= 4
        into[:, : 3 * h, -1] += 0.5
        out, embed = self.out.T.astype(np.float32), np.ascontiguousarray(self.embed.T, np.float32)
        away, bias = np.stack([out[:, :h], out[:, h : 2 * h]]), out[:, -1:]
        place = np.arange(most)
        running = np.searchsorted(-sizes, -place, "left").tolist()  # windows longer than each place
        at = [starts + place[:, None], starts + (sizes - 1 - place[:, None])]
        ahead, back = (codes[np.clip(a, 0, len(codes) - 1)].astype(np.intp) for a in at)
        seen = np.zeros((2, EMBEDDED + h + 1, n), np.float32)  # for each direction the step's symbol, the state before it, and a one
        seen[:, -1] = 1
        cell, numbers, made = np.zeros((2, h, n), np.float32), np.empty(8 * h * n, np.float32), (np.empty if even else np.zeros)((most, 2, TAGS, n), np.float32)
        ones, low = np.ones((4 * h, n), np.float32), np.zeros((4 * h, n), np.float32)  # numpy is several times as fast with bounds in arrays
        low[3 * h :] = -1
        m = -1
        for t, now in enumerate(running):
            if now != m:
                m = now
                z, c, x = numbers[: 8 * h * m].reshape(2, 4 * h, m), cell[:, :, :m], seen[:, :, :m]
                i, f, o, g = (z[:, k * h : (k + 1) * h] for k in range(4))
                floor, roof, state = low[:, :m], ones[:, :m], x[:, EMBEDDED:-1]
                least, greatest = floor[3 * h :], roof[:h]
            np.take(embed, ahead[t], axis=1, out=seen[0, :EMBEDDED], mode="clip")
            np.take(embed, back[t], axis=1, out=seen[1, :EMBEDDED], mode="clip")
            np.matmul(into, x, out=z)
            np.minimum(np.maximum(z, floor, out=z), roof, out=z)
            g *= i
            c *= f
            c += g
            np.minimum(np.maximum(c, least, out=g), greatest, out=g)
            np.multiply(g, o, out=state)
            np.matmul(away, state, out=made[t, :, :, :m])
        ways = [np.empty((n, most * TAGS), np.float32) for _ in range(1 if even else 2)]
        for t in range(0, most, 16):  # a few steps at a time, which stay in the cache
            end = min(t + 16, most)
            some = made[t:end, 0] + bias
            if even:
                some += made[most - end : most - t, 1][::-1]
            else:
                ways[1][:, t * TAGS : end * TAGS] = made[t:end, 1].reshape(-1, n).T
            ways[0][:, t * TAGS : end * TAGS] = some.reshape(-1, n).T
        ways = [way.reshape(n, most, TAGS) for way in ways]
        return list(ways[0]) if even else [x[:size] + y[:size][::-1] for x, y, size in zip(*ways, sizes.tolist())]

    def averaged(self, parts: list[np.ndarray]) -> list[np.ndarray]:
        """Scores (time, tag) of each part: of windows that start at every STRIDE, averaged where they overlap, nearer ends weighing less."""
        sizes = np.array([len(p) for p in parts])
        ends = np.cumsum(sizes)
        codes = np.concatenate(parts) if len(parts) else np.zeros(0, np.uint8)
        windows = np.maximum(1, -(-(sizes - OVERLAP) // STRIDE)) * (sizes > 0)
        owner = np.repeat(np.arange(len(parts)), windows)
        turn = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        start = (ends - sizes)[owner] + turn * STRIDE
        size = np.minimum(WINDOW, ends[owner] - start)
        follows, last = turn > 0, turn == windows[owner] - 1
        order = np.argsort(-size, kind="stable")
        sums = np.zeros((len(codes), TAGS), np.float32)
        ramp = (np.arange(1, OVERLAP + 1)[:, None] / (OVERLAP + 1)).astype(np.float32)
        full = int((size == WINDOW).sum())
        for at, to in ((at, min(at + TOGETHER, end)) for begin, end in ((0, full), (full, len(order))) for at in range(begin, end, TOGETHER)):
            some = order[at:to]
            for n, x in zip(some.tolist(), self.scores(codes, start[some], size[some])):
                if follows[n]:
                    x[:OVERLAP] *= ramp
                if not last[n]:  # and so is full
                    x[STRIDE:] *= ramp[::-1]
                sums[start[n] : start[n] + len(x)] += x
        return np.split(sums, ends[:-1])

    def parts(self, codes: list[np.ndarray], wanted: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int, np.ndarray]]]:
        """Lists of (text, start, end) of each wanted part, start in steps of STRIDE, with its scores within the whole text; at most about PIECE characters at once."""
        some: list[tuple[int, int, int]] = []
        held = 0
        for k, part in enumerate(wanted):
            some.append(part)
            held += part[2] - part[1]
            if k + 1 == len(wanted) or held + wanted[k + 1][2] - wanted[k + 1][1] > PIECE:
                # one stride more to each side, so that all windows over the part are there
                scores = self.averaged([codes[n][max(0, s - STRIDE) : -(-e // STRIDE) * STRIDE + STRIDE] for n, s, e in some])
                yield [(n, s, e, x[(at := min(s, STRIDE)) : at + e - s]) for (n, s, e), x in zip(some, scores)]
                some, held = [], 0

    def gains(self, x: np.ndarray, at_start: bool) -> tuple[np.ndarray, np.ndarray]:
        """For each place the most that its tag can add over tag 0, if it leaves tag 0 there and if it was left before."""
        moves, x = (self.moves - self.moves[0, 0]).astype(np.float32), np.ascontiguousarray(x.T)
        first = (x[1:] + moves[0, 1:, None]).max(axis=0) - x[0]
        if at_start and len(first):
            first[0] = (x[1:, 0] + self.moves[-1, 1:] - self.moves[-1, 0]).max() - x[0, 0]
        return first, (x[1:] + moves[1:-1, 1:].max(axis=0)[:, None]).max(axis=0) - x[0]

    def open_places(self, first: np.ndarray, further: np.ndarray) -> np.ndarray:
        """Where the best path can be off tag 0: places of some stretch whose gains, with the moves away and back, may add up to more than none."""
        sums = np.cumsum(further, dtype=np.float64)
        back = sums + float((self.moves[1:-1, 0] - self.moves[0, 0]).max())
        back[-1:] = sums[-1:]  # at the text's end there is no move back
        begun = np.maximum.accumulate(first - sums)
        return begun + np.maximum.accumulate(back[::-1])[::-1] > -1e-3

    def decode(self, parts: list[np.ndarray], entries: Sequence[int], exits: Sequence[np.ndarray]) -> list[np.ndarray]:
        """The best tags of each part, scores (time, tag), after the tag (or start) `entry` and with `exit` added at its end."""
        out: list[np.ndarray] = [np.empty(0, int)] * len(parts)
        some = sorted(range(len(parts)), key=lambda n: -len(parts[n]))
        moves = np.ascontiguousarray(self.moves[:-1].T)[:, :, None].astype(np.float32)
        if some:
            sizes = np.array([len(parts[n]) for n in some])
            best = np.zeros((sizes[0], TAGS, len(some)), np.float32)
            for k, n in enumerate(some):
                best[: sizes[k], :, k] = parts[n]
                best[0, :, k] += self.moves[entries[n]]
                best[sizes[k] - 1, :, k] += exits[n]
            left = np.searchsorted(-sizes, -np.arange(sizes[0] + 1), "left")  # parts longer than each place
            for t in range(1, sizes[0]):
                m = left[t]
                best[t, :, :m] += (best[t - 1, None, :, :m] + moves).max(axis=1)
                best[t, :, :m] -= best[t, :, :m].max(axis=0)
            path = np.zeros((sizes[0], len(some)), np.int64)
            for t in range(sizes[0] - 1, -1, -1):
                m, now = left[t + 1], best[t, :, : left[t]]
                now[:, :m] += moves[path[t + 1, :m], :, 0].T if m else 0
                path[t, : left[t]] = now.argmax(axis=0)
            for k, n in enumerate(some):
                out[n] = path[: sizes[k], k]
        return out

    def across(self, x: np.ndarray) -> np.ndarray:
        """(part, a, b): the best that a path adds over each part, scores (part, time, tag), from tag a before it to tag b at its end."""
        moves, x = self.moves[:-1], x.astype(np.float64)
        made = moves + x[:, 0, None, :]
        for t in range(1, x.shape[1]):
            made = (made[:, :, :, None] + moves).max(axis=2) + x[:, t, None, :]
        return made

    def long_path(self, codes: np.ndarray, held: np.ndarray | None, start: int, end: int, exit_: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The best tags of codes[start:end], block by block: what each block adds between all tags tells which tags the
        blocks begin and end with, and with these each is decoded on its own, so scores of a few blocks are held at once."""
        cuts = [*range(start, end, BLOCK), end]
        several = [[(0, s, e) for s, e in zip(cuts, cuts[1:])][n : n + PIECE // BLOCK] for n in range(0, len(cuts) - 1, PIECE // BLOCK)]
        read = lambda some: self.cut_out([codes], {0: held}, some)
        sums = np.where(np.arange(TAGS) == 0, 0.0, -np.inf)  # at tag 0 before the first block
        came: list[np.ndarray] = []
        for some in several:
            scores = read(some)
            if not start and not came:
                scores[0][0] += self.moves[-1] - self.moves[0]
            full = [x for x in scores if len(x) == BLOCK]
            added = [*(self.across(np.array(full)) if full else ()), *(self.across(x[None])[0] for x in scores if len(x) < BLOCK)]
            for more in added:
                ways = sums[:, None] + more
                came.append(ways.argmax(axis=0))
                sums = ways.max(axis=0)
        tags_ = [int((sums + exit_).argmax())]
        for before in reversed(came):
            tags_.append(int(before[tags_[-1]]))
        tags_.reverse()
        only = np.where(np.eye(TAGS) > 0, 0.0, -1e30)
        for n, some in enumerate(several):
            first = n * (PIECE // BLOCK)
            entries = [TAGS if s == 0 else tags_[first + k] for k, (_, s, _) in enumerate(some)]
            paths = self.decode(read(some), entries, [only[tags_[first + k + 1]] for k in range(len(some))])
            yield from zip((s for _, s, _ in some), paths)

    def paths(self, codes: list[np.ndarray], held: dict[int, np.ndarray | None], regions: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(text, start, tags) of each region, at tag 0 before and after, long ones in several pieces."""
        exit_ = lambda n, end: self.moves[:-1, 0] if end < len(codes[n]) else np.zeros(TAGS)
        short = sorted((r for r in regions if r[2] - r[1] <= 4 * BLOCK), key=lambda r: r[2] - r[1])
        while short:  # of about the same length, as they go step by step
            n = max(1, min(TOGETHER, 4 * TOGETHER * BLOCK // (short[-1][2] - short[-1][1])))
            some, short = short[-n:], short[:-n]
            found = self.decode(self.cut_out(codes, held, some), [0 if s else TAGS for _, s, _ in some], [exit_(n, e) for n, _, e in some])
            yield from ((n, s, path) for (n, s, _), path in zip(some, found))
        for n, start, end in (r for r in regions if r[2] - r[1] > 4 * BLOCK):
            yield from ((n, s, path) for s, path in self.long_path(codes[n], held[n], start, end, exit_(n, end)))

    def read(self, texts: list[str], taken: Sequence[Sequence[Span]] | None = None) -> list[list[Span]]:
        """Spans of each text that the model is sure of and that overlap none of those taken."""
        codes = [symbols(t) for t in texts]
        out: list[list[Span]] = [[] for _ in texts]
        busy: dict[int, bytearray] = {}  # characters of spans that are there already

        def free(n: int, start: int, end: int) -> bool:
            if n not in busy:
                busy[n] = bytearray(len(codes[n]))
                for _, s, e in taken[n] if taken else ():
                    busy[n][s:e] = b"\1" * (e - s)
            return busy[n].find(1, start, end) < 0

        first, further = ([np.empty(len(c), np.float32) for c in codes] for _ in range(2))
        whole = [(n, s, min(len(c), s + PIECE)) for n, c in enumerate(codes) for s in range(0, len(c), PIECE)]
        for some in self.parts(codes, whole):
            held = {}
            for n, start, end, x in some:
                first[n][start:end], further[n][start:end] = self.gains(x, not start)
                held[n] = x if end - start == len(codes[n]) else None
            regions: list[tuple[int, int, int]] = []
            for n in (n for n, _, end, _ in some if end == len(codes[n])):
                places = np.flatnonzero(self.open_places(first[n], further[n]))
                cuts = np.flatnonzero(np.diff(places) > 1)
                if len(places):
                    regions += [(n, int(a), int(b) + 1) for a, b in zip(places[[0, *(cuts + 1)]], places[[*cuts, -1]])]
            begun: dict[int, tuple[int, int, int]] = {}  # text: kind, start and end of a span that may go on in the next piece
            spans = []
            for n, start, path in self.paths(codes, held, regions):
                kind, s, e = begun.pop(n, (-1, -1, -1))
                turns = [0, *(np.flatnonzero(np.diff(path)) + 1), len(path)]
                for at, to in zip(turns, turns[1:]):
                    tag, here = int(path[at]), start + int(at)
                    if tag and tag % 2 == 0 and kind == tag // 2 - 1 and e == here:
                        e = start + int(to)
                        continue
                    if kind >= 0:
                        spans.append((n, kind, s, e))
                    # of a run of first characters, the last begins the span that goes on
                    kind, s, e = (tag // 2, start + int(to) - 1, start + int(to)) if tag % 2 else (-1, -1, -1)
                if kind >= 0:
                    begun[n] = (kind, s, e)
            spans += [(n, *span) for n, span in begun.items()]
            spans = [(n, k, s, e) for n, k, s, e in sorted(spans, key=lambda x: (x[0], x[2])) if free(n, s, e) and plausible(k, texts[n][s:e])]
            for at in range(0, len(spans), TOGETHER):
                for n, kind, s, e in self.sure(codes, held, spans[at : at + TOGETHER]):
                    s, e = widened(kind, texts[n], s, e)
                    if free(n, s, e):
                        out[n].append((kind, s, e))
                        busy[n][s:e] = b"\1" * (e - s)
        return out

    def sure(self, codes: list[np.ndarray], held: dict[int, np.ndarray | None], spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """The spans each of whose characters has a marginal of SURE, with AROUND characters of text to each side; long ones by parts."""
        parts = [(k, a, min(e, a + SPAN_PART)) for k, (_, _, s, e) in enumerate(spans) for a in range(s, e, SPAN_PART)]
        unsure = set()
        for first in range(0, len(parts), TOGETHER):
            some = parts[first : first + TOGETHER]
            around = self.cut_out(codes, held, [(n := spans[k][0], max(0, a - AROUND), min(len(codes[n]), b + AROUND)) for k, a, b in some])
            by_size: dict[int, list[int]] = {}
            for place, x in enumerate(around):
                by_size.setdefault(len(x), []).append(place)
            for places in by_size.values():
                chances = self.marginals(np.stack([around[p] for p in places], axis=1).astype(np.float64))[1]
                for column, (k, a, b) in enumerate(some[p] for p in places):
                    _, kind, s, _ = spans[k]
                    chance = chances[min(a, AROUND) :, column]
                    begins = int(a == s)
                    if min(chance[0, 2 + 2 * kind - begins], chance[1 : b - a, 2 + 2 * kind].min(initial=1)) < SURE:
                        unsure.add(k)
        return [span for k, span in enumerate(spans) if k not in unsure]

    def cut_out(self, codes: list[np.ndarray], held: dict[int, np.ndarray | None], wanted: list[tuple[int, int, int]]) -> list[np.ndarray]:
        """Scores of the wanted places: of those held, or, of texts longer than PIECE, read again."""
        again = [(n, s // STRIDE * STRIDE, e) for n, s, e in wanted if held[n] is None]
        read = iter([x for some in self.parts(codes, again) for *_, x in some])
        return [(next(read)[s % STRIDE :] if held[n] is None else held[n][s:e]).copy() for n, s, e in wanted]


def widened(kind: int, text: str, start: int, end: int) -> tuple[int, int]:
    """An address with an @, or a number, with all of the word that it stands in, so that no part of it is left over."""
    more = {0: lambda c: ascii_of(c) in LOCAL or c.isalnum()}.get(kind, str.isdecimal)
    if kind or "@" in map(ascii_of, text[start:end]):
        while start and more(text[start - 1]):
            start -= 1
        while end < len(text) and (more(text[end]) and (text[end].isalnum() or text[end + 1 : end + 2].isalnum())):
            end += 1
    return start, end


#: What a spelled-out address and a spelled-out number hold.
AT = re.compile(r"(?<![^\W_])at(?![^\W_])", re.I)
NUMBER = re.compile(r"\b(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)\b", re.I)


def plausible(kind: int, text: str) -> bool:
    """What no span of the kind can lack: an @ or the word at between others, or enough digits, of any script or in words."""
    if kind == 0:
        inner = text[1:-1]
        return len(text) >= 5 and ("@" in inner or "\uff20" in inner or bool(AT.search(inner)))
    digits = "".join(ascii_of(c) for c in text if c.isdecimal())
    n = len(digits) + len(NUMBER.findall(text))
    return (n >= 4, 16 <= n <= 19 and (n > len(digits) or luhn(digits)), 8 <= n <= 15)[kind - 1]


def made_windows(n: int, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Lines of invented words around invented personal data or around numbers that are none."""
    rng = np.random.default_rng(seed)
    some = lambda letters, low, high: "".join(rng.choice(list(letters), rng.integers(low, high)))
    word = lambda: some("abcdefghilmnoprstuv", 2, 9)
    makers = [
        lambda: f"{word()}.{some('0123456789', 1, 3)}@{word()}{some('0123456789', 0, 2)}.{word()}.com",
        lambda: ".".join(str(rng.integers(1, 256)) for _ in range(4)),
        lambda: next(c for c in iter(lambda: some("123456789", 1, 2) + some("0123456789", 15, 16), None) if luhn(c)),
        lambda: f"+{rng.integers(1, 99)} ({some('0123456789', 3, 4)}) {some('0123456789', 3, 4)}-{some('0123456789', 4, 5)}",
        lambda: f"version {rng.integers(0, 30)}.{rng.integers(0, 30)}",
        lambda: str(rng.integers(0, 10**6)),
        lambda: some("0123456789abcdef", 20, 40),
        lambda: f"@{word()}",
    ]
    out = []
    for k in range(n):
        before = " ".join(word() for _ in range(rng.integers(0, 5))) + rng.choice([" ", ": ", "\n"])
        text = before + makers[k % len(makers)]()
        spans = [(k % len(makers), len(before), len(text))] if k % len(makers) < len(KINDS) else []
        out.append(((text + rng.choice([" ", ". ", ", "]) + " ".join(word() for _ in range(rng.integers(0, 5))))[:TRAINED], spans))
    return out


def spelled_windows(n: int, seed: int = 12) -> list[tuple[str, list[Span]]]:
    """Windows of lines with personal data in words or at hosts without a dot, or with words alike that are none."""
    rng = np.random.default_rng(seed)
    some = lambda letters, low, high: "".join(rng.choice(list(letters), rng.integers(low, high)))
    word = lambda: some("abcdefghijklmnoprstuvwyz", 2, 9)
    digits = "zero one two three four five six seven eight nine".split()
    small = "at dot and the of in to on or is was for by a an point one two three plus we from".split()

    def email() -> str:
        at, dot = [(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", " (dot) "), (" AT ", " DOT "), (" at ", ".")][rng.integers(6)]
        return dot.join(word() for _ in range(rng.integers(1, 3))) + at + word() + dot + (word() + dot if rng.random() < 0.3 else "") + str(rng.choice(["com", "org", "net", "edu", "de", "fr", "info"]))

    def phone() -> str:
        return ("plus " if rng.random() < 0.5 else "") + str(rng.choice([" ", " ", "-"])).join(rng.choice(digits, rng.integers(8, 13)))

    makers = [
        (0, email),
        (3, phone),
        (0, email),
        (3, phone),
        (0, lambda: some("abcdefghijklmnopqrstuvwxyz0123456789._-", 6, 60).strip("._-") + "@" + word()),
        (None, lambda: f"{word()} at {word()}. {word()}"),
        (None, lambda: " ".join(rng.choice(digits, rng.integers(1, 4)))),
        (None, lambda: " ".join(rng.choice(small, rng.integers(2, 9)))),
    ]
    fill = lambda: " ".join(str(rng.choice(small)) if rng.random() < 0.4 else word() for _ in range(rng.integers(0, 12)))
    out = []
    for k in range(n):
        kind, make = makers[k % len(makers)]
        before, made = fill() + str(rng.choice([" ", ": ", "\n"])), make()
        text = before + made + str(rng.choice([" ", ". ", ", "])) + fill()
        start = int(rng.integers(0, max(1, len(text) - TRAINED + 1)))
        spans = [] if kind is None else [(kind, len(before) - start, len(before) + len(made) - start)]
        out.append((text[start : start + TRAINED], spans))
    return out


def trained(docs: DataFrame, seed: int = 5) -> Network:
    """Fitted on windows of the corpus with the smallest hashes, at most SAMPLE_WINDOWS near a digit or @ and
    PLAIN_WINDOWS of the texts at large, and MADE_WINDOWS and SPELLED_WINDOWS invented ones."""

    def places(text: str) -> list[tuple[int, int, bool]]:
        start = zlib.crc32(text.encode("utf-8", "replace")) % max(1, len(text) - TRAINED + 1)
        return [*((s, min(e, s + TRAINED), False) for s, e in stretches(text)), (start, min(len(text), start + TRAINED), True)]

    # the smallest of each task are enough for the smallest of all; windows that can't be among them aren't labelled
    def smallest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bool, dict[int, tuple[str, list[int]]]] = {False: {}, True: {}}
        below, most = {False: 1 << 62, True: 1 << 62}, {False: SAMPLE_WINDOWS, True: PLAIN_WINDOWS}
        for text in (t for part in parts for t in part.column("text").to_pylist() if t):
            spans = None
            for start, end, plain in places(text):
                piece = text[start:end]
                order = xxhash.xxh3_64_intdigest(piece.encode("utf-8", "replace")) >> 2
                if order < below[plain]:
                    spans = detected(text) if spans is None else spans
                    kept[plain].setdefault(order, (piece, tags(len(piece), spans, start).tolist()))
                    if len(kept[plain]) >= 2 * most[plain]:
                        kept[plain] = dict(sorted(kept[plain].items())[: most[plain]])
                        below[plain] = max(kept[plain])
        rows = [(order, piece, labels, plain) for plain in kept for order, (piece, labels) in sorted(kept[plain].items())[: most[plain]]]
        columns = zip(*rows) if rows else ([], [], [], [])
        types = (pa.int64(), pa.string(), pa.list_(pa.int8()), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["order", "piece", "labels", "plain"])

    def fitted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for part in parts for r in part.to_pylist()]
        network = fit([(r["piece"], np.array(r["labels"], np.int64)) for r in sorted(rows, key=lambda r: (r["plain"], r["order"]))], seed)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(network)], pa.binary())], names=["network"])

    sample = staged(small_batches(docs.select("text")).mapInArrow(tidy(smallest), "order long, piece string, labels array<tinyint>, plain boolean").dropDuplicates(["plain", "order"]))
    near, plain = (sample.where(of).orderBy("order").limit(most) for of, most in ((~F.col("plain"), SAMPLE_WINDOWS), (F.col("plain"), PLAIN_WINDOWS)))
    return pickle.loads(near.unionByName(plain).coalesce(1).mapInArrow(tidy(fitted), "network binary").first()["network"])  # one task for a bounded sample


def fit(lines: list[tuple[str, np.ndarray]], seed: int) -> Network:
    """A network fitted on lines of at most TRAINED characters with their tags, and on the invented ones."""
    lines = lines + [(t, tags(len(t), s, 0)) for t, s in (*made_windows(MADE_WINDOWS), *spelled_windows(SPELLED_WINDOWS))]
    x, y = np.zeros((len(lines), TRAINED), np.int64), np.zeros((len(lines), TRAINED), np.int64)
    for n, (text, label) in enumerate(lines):
        x[n, : len(text)] = symbols(text)
        y[n, : len(text)] = label
    network = Network.new(seed)
    network.train(x, y, seed)
    return network


def find(texts: list[str | None], network: Network) -> list[tuple[list[Span], list[Span]]]:
    """For each text the detectors' spans, and those together with the spans that the network adds."""
    bases = [detected(t or "") for t in texts]
    added = network.read([t or "" for t in texts], bases)
    return [(b, sorted([*b, *a])) for b, a in zip(bases, added)]


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _each(docs: DataFrame, keep: Sequence[str], of: Callable[[str | None, list[Span], list[Span]], tuple], made: str) -> DataFrame:
    """of(text, base, all) for every row, with a network trained on docs."""
    shipped = docs.sparkSession.sparkContext.broadcast(trained(docs))
    return beside(docs, keep, "text", made, lambda: lambda texts: [of(t, b, e) for t, (b, e) in zip(texts, find(texts, shipped.value))], rows=TEXTS)


def find_personal_data(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added of every row of docs.

    The counts and the digest are of the detectors' spans; spans holds these and the added
    ones as kind:start:end in code points, end exclusive, by kind, then
    start. Null and empty texts have none. Repeated rows and null ids are rows
    like others, an empty table gives an empty result, other columns are ignored."""

    def of(text: str | None, base: list[Span], all_: list[Span]) -> tuple:
        return (*(sum(k == n for k, _, _ in base) for n in range(4)), hashlib.sha256(written(base).encode()).hexdigest(), written(all_), len(all_) - len(base))

    return _each(docs, keep, of, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; overlapping spans of different kinds become one. Null texts stay null."""

    def of(text: str | None, _: list[Span], spans: list[Span]) -> tuple:
        out, done = [], 0
        for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
            if start >= done:
                out += [text[done:start], f"<{KINDS[kind].upper()}>"]
            done = max(done, end)
        return (text if not spans else "".join([*out, text[done:]]),)

    return _each(docs, [c for c in docs.columns if c != "text"], of, "text string").select(*docs.columns)


def op9_personal_data(spark, sf_dir: str) -> DataFrame:
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
