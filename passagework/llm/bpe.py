"""Byte-level BPE as finite-state machines: encoding, decoding, and token counts.

A text is cut into pieces by the vocabulary's pattern; merges never cross a
piece. Within a piece the merges are compiled, as far as the texts ask for it,
into a deterministic transducer over bytes. It rests on two facts about BPE:
a sequence of tokens is the encoding of its bytes exactly if each two
neighbours are the encoding of theirs, and so the last token of every prefix is
the only one that ends there and follows the last token of the prefix before it. A state
holds, for each place where a token may still begin, the trie node reached
from it and the tokens that end there but are not settled yet; tokens that all these have in
common can't change any more and are emitted on the transition. The longest
token bounds the lookahead and so the states.

States and encoded pieces are kept in each Python worker up to a fixed number,
then dropped and built anew, so memory does not grow with the corpus.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import chain

import regex
from pyspark.sql import DataFrame

from .common import KEPT, beside

MOST_STATES, MOST_PIECES = 200_000, 200_000
#: Longest piece that is kept, and bytes of a longer one between two looks at the number of states.
LONGEST_KEPT, RUN_BYTES = 256, 4_096
CHUNK_CHARS, BLOCK_IDS = 8_192, 8_192
NEVER = 1 << 60


def rank_vocabulary(content: bytes) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank in each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line.strip())}


def json_vocabulary(content: bytes) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ranks, which are the ids, and added tokens of a tokenizer's json file.

    Its tokens spell each byte as a character: printable bytes of Latin-1 as
    themselves, the rest as the characters from 256 on."""
    model = json.loads(content)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}
    added = {a["content"]: a["id"] for a in model["added_tokens"]}
    return {bytes(byte_of[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in added}, added


class Transducer:
    """Lazily determinised encoder of pieces."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.edges: dict[int, int] = {}
        self.token_at, self.grows = [-1], [False]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                at = node << 8 | byte
                if at not in self.edges:
                    self.grows[node] = True
                    self.edges[at] = len(self.token_at)
                    self.token_at.append(-1)
                    self.grows.append(False)
                node = self.edges[at]
            self.token_at[node] = rank
        self.whole_at: list[bool | None] = [None] * len(self.token_at)  # whether the token at a node is whole, once it was asked
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[int, tuple[int, tuple[int, ...], int]]] = []
        self.ends: list[tuple[int, ...]] = []
        self._number(((0, -1, ()),))

    def _number(self, state: tuple) -> int:
        found = self.numbers.get(state)
        if found is None:
            found = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            self.ends.append(state[-1][2])
        return found

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes `token`; None for a byte, and for a token that its bytes don't encode to."""
        if token not in self.halves:
            parts = [bytes([b]) for b in self.bytes_of[token]]
            while len(parts) > 1:
                rank, at = min((self.ranks.get(a + b, NEVER), n) for n, (a, b) in enumerate(zip(parts, parts[1:])))
                if rank >= token:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def whole(self, token: int) -> bool:
        return len(self.bytes_of[token]) == 1 or self.split(token) is not None

    def edge_of(self, token: int, side: int) -> list[int]:
        """The tokens that stand at one edge of `token` while it is made, from the byte on."""
        spine = [token]
        while (halves := self.split(spine[-1])) is not None:
            spine.append(halves[side])
        return spine[::-1]

    def follows(self, a: int, b: int) -> bool:
        """Whether b can stand after a: no merge across them comes before the merges that make them."""
        known = self.fits.get((a, b))
        if known is None:
            left, right = self.edge_of(a, 1), self.edge_of(b, 0)
            i = j = 0
            known = True
            while known:
                next_left = left[i + 1] if i + 1 < len(left) else NEVER
                next_right = right[j + 1] if j + 1 < len(right) else NEVER
                across = self.ranks.get(self.bytes_of[left[i]] + self.bytes_of[right[j]], NEVER)
                if across < next_left and across <= next_right and across < NEVER:  # of equal ranks, the one on the left is first
                    known = False
                elif next_left == next_right == NEVER:
                    break
                elif next_left <= next_right:
                    i += 1
                else:
                    j += 1
            if len(self.fits) > 4 * MOST_STATES:
                self.fits.clear()
            self.fits[a, b] = known
        return known

    def grow(self, number: int, byte: int) -> tuple[int, tuple[int, ...], int]:
        """Adds the transition of a state by a byte: next state, tokens emitted, and their count."""
        live, newest = [], None
        for node, last, pending in self.states[number]:
            child = self.edges.get(node << 8 | byte)
            if child is None:
                continue
            if newest is None and (token := self.token_at[child]) >= 0:
                if (whole := self.whole_at[child]) is None:
                    whole = self.whole_at[child] = self.whole(token)
                if whole and (last < 0 or self.follows(last, token)):
                    newest = (0, token, (*pending, token))
            if self.grows[child]:
                live.append((child, last, pending))
        live.append(newest)
        first = live[0][2]
        settled = len(first)
        if len(live) > 1:  # what all have in common is what the least and the greatest have in common
            waiting = [p for _, _, p in live]
            low, high = min(waiting), max(waiting)
            settled = next((n for n, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
        state = tuple((node, last, pending[settled:]) for node, last, pending in live) if settled else tuple(live)
        move = self.moves[number][byte] = (self._number(state), first[:settled], settled)
        return move

    def fresh(self, number: int) -> int:
        """The number of a state, after all others are forgotten if there are too many."""
        if len(self.states) > MOST_STATES:
            state = self.states[number]
            self.forget()
            number = self._number(state)
        return number

    def encode(self, piece: bytes) -> tuple[int, ...]:
        number, out = self.fresh(0), []
        for start in range(0, len(piece), RUN_BYTES):
            number = self.fresh(number)
            moves = self.moves
            for byte in piece[start : start + RUN_BYTES]:
                number, emitted, _ = moves[number].get(byte) or self.grow(number, byte)
                if emitted:
                    out += emitted
        return (*out, *self.ends[number])

    def run(self, number: int, data: bytes) -> tuple[int, int]:
        """The state after the bytes, and the count of the tokens emitted: only counts on the transitions, summed up."""
        n = 0
        for start in range(0, len(data), RUN_BYTES):
            number = self.fresh(number)
            moves = self.moves
            for byte in data[start : start + RUN_BYTES]:
                number, _, emitted = moves[number].get(byte) or self.grow(number, byte)
                n += emitted
        return number, n

    def count(self, piece: bytes) -> int:
        number, n = self.run(self.fresh(0), piece)
        return n + len(self.ends[number])


class Pieces(dict):
    """What `of` makes of each piece, kept for the last MOST_PIECES short ones and as many before."""

    def __init__(self, of: Callable[[bytes], object]) -> None:
        super().__init__()
        self.of, self.before = of, {}

    def __missing__(self, piece: str) -> object:
        if len(self) >= MOST_PIECES:
            self.before = dict(self)
            self.clear()
        made = self.before.get(piece)
        if made is None:
            made = self.of(piece.encode())
        if len(piece) <= LONGEST_KEPT:
            self[piece] = made
        return made


class Utf8Stream:
    """Incremental UTF-8 decoding: a character whose bytes have not all come yet is held back."""

    def __init__(self) -> None:
        self.held, self.valid = b"", True

    def feed(self, data: bytes, last: bool = False) -> str:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(3, cut) + 1):
            byte = data[-back]
            if byte >= 0xC0:
                if back < 2 + (byte >= 0xE0) + (byte >= 0xF0):
                    cut -= back
                break
            if byte < 0x80:
                break
        self.held = b"" if last else data[cut:]
        data = data if last else data[:cut]
        try:
            return data.decode()
        except UnicodeDecodeError:
            self.valid = False
            return data.decode(errors="replace")


BEYOND = re.compile("[\ud800-\udfff\U00010000-\U0010ffff]")


@cache
def ranges(of: str) -> str:
    """The characters below U+10000, without surrogates, that `regex` takes for the class, as what stands between brackets."""
    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 1 << 16)]))
    runs = ((part[0], part[-1]) for half in (plane[:0xD800], plane[0xD800:]) for part in regex.findall(of + "+", half))
    return "".join(f"\\u{ord(a):04x}-\\u{ord(b):04x}" for a, b in runs)


def cutter(pattern: str) -> Callable[[str], list[str]]:
    """The pieces of a text by the pattern.

    Texts below U+10000 are cut by the standard library's engine, in little more than half the time, with the classes of letters,
    numbers and space written out; that is done for the vocabularies' pattern, others go to `regex`."""
    full = regex.compile(pattern).findall
    if pattern != Counter.pattern:
        return full
    letters, numbers, space = map(ranges, (r"\p{L}", r"\p{N}", r"\s"))
    spelled = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]")
    for of, class_ in ((r"\p{L}", f"[{letters}]"), (r"\p{N}", f"[{numbers}]"), (r"\s", f"[{space}]"), (r"\S", f"[^{space}]")):
        spelled = spelled.replace(of, class_)
    low = re.compile(spelled).findall
    return lambda text: (full if BEYOND.search(text) else low)(text)


class Coder:
    """Encodes and decodes whole texts with one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.machine = Transducer(ranks)
        self.cut = cutter(pattern)
        self.pieces = Pieces(self.machine.encode)
        self.decimals = {i: str(i) for i in ranks.values()}

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.cut(text or ""))))

    def spelled(self, ids: list[int]) -> str:
        """The ids in decimal, joined by one space."""
        return " ".join(map(self.decimals.__getitem__, ids))

    def blocks(self, ids: list[int]) -> Iterator[bytes]:
        """The bytes of the ids, some thousand at a time."""
        for start in range(0, len(ids), BLOCK_IDS):
            yield b"".join(map(self.machine.bytes_of.__getitem__, ids[start : start + BLOCK_IDS]))

    def decode(self, ids: list[int]) -> str:
        stream = Utf8Stream()
        return "".join([*(stream.feed(b) for b in self.blocks(ids)), stream.feed(b"", last=True)])


#: Where the cutting of a text into pieces stands: what the open piece is (nothing, letters, numbers, signs, an apostrophe
#: that may begin an ending, space), the character that is held back until the next one shows where it belongs, and the transducer's state within the open piece.
State = tuple[str, str, tuple]
FIRST: tuple = ((0, -1, ()),)
START: State = ("", "", FIRST)
ENDINGS = {"s": "", "t": "", "m": "", "d": "", "r": "e", "v": "e", "l": "l"}  # of one letter, or with the letter that must follow


class ChunkMap:
    """What a chunk of text does to the count: from the state it is entered in to the state it is left in, and the tokens completed between.

    The states that it can be entered in are too many to list. Those asked for are worked out and kept;
    the one to be expected is asked for when the map is made."""

    def __init__(self, counter: Counter, text: str) -> None:
        self.counter, self.text = counter, text
        self.known: dict[State, tuple[State, int]] = {}

    def __call__(self, state: State) -> tuple[State, int]:
        if state not in self.known:
            self.known[state] = self.counter.through(state, self.text)
        return self.known[state]


class Composed:
    """Two maps, one after the other."""

    def __init__(self, first: Callable[[State], tuple[State, int]], second: Callable[[State], tuple[State, int]]) -> None:
        self.first, self.second = first, second
        self.known: dict[State, tuple[State, int]] = {}

    def __call__(self, state: State) -> tuple[State, int]:
        if state not in self.known:
            middle, n = self.first(state)
            end, more = self.second(middle)
            self.known[state] = end, n + more
        return self.known[state]


class Counter:
    """Counts tokens of whole texts with the transducer's counts; added tokens count as one.

    The cutting of texts into pieces is a machine of its own over characters, for the one pattern that the vocabularies
    here are used with; both together are in a State between two characters. Within a chunk, pieces that are closed
    for certain are counted by the cache of pieces."""

    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    seam = regex.compile(r"(?<=\S)(?=\s)")
    kinds = tuple((kind, regex.compile(of)) for kind, of in (("L", r"\p{L}"), ("N", r"\p{N}"), ("W", r"\s"), ("O", r"(?s).")))

    def __init__(self, ranks: dict[bytes, int], pattern: str, added: Iterable[str] = ()) -> None:
        if pattern != self.pattern:
            raise ValueError("tokens are counted for one pattern only")
        self.machine = Transducer(ranks)
        self.cut = cutter(pattern)
        self.pieces = Pieces(self.machine.count)
        self.kind_of: dict[str, str] = {}
        self.added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None

    def kind(self, char: str) -> str:
        found = self.kind_of.get(char)
        if found is None:
            found = self.kind_of[char] = next(kind for kind, of in self.kinds if of.match(char))
        return found

    def feed(self, inner: tuple, text: str) -> tuple[tuple, int]:
        number, n = self.machine.run(self.machine._number(inner), text.encode("utf-8", "surrogatepass"))
        return self.machine.states[number], n

    def step(self, state: State, char: str) -> tuple[State, int]:
        """The state after one more character, and the tokens that it completes."""
        mode, held, inner = state
        kind = self.kind(char)
        if mode == kind != "W" or mode == "A" and not held and kind == "O":  # the piece goes on; an apostrophe and other signs are a piece of signs
            inner, n = self.feed(inner, char)
            return (kind, "", inner), n
        if mode == "A" and held:
            if char == ENDINGS[held]:
                return START, self.close(*self.feed(inner, held + char))
            done = len(inner[-1][2])  # the apostrophe alone, and the letter begins a piece
            state, n = self.step(START, held)
            state, more = self.step(state, char)
            return state, done + n + more
        if mode == "A" and char in ENDINGS:
            return (START, self.close(*self.feed(inner, char))) if not ENDINGS[char] else (("A", char, inner), 0)
        if mode == "W" and kind == "W":
            inner, n = self.feed(inner, held)
            return ("W", char, inner), n
        if mode == "W":
            done = len(inner[-1][2])  # the space before the last one is a piece
            if held == " ":
                inner, n = self.feed(FIRST, " " + char)
                return (kind, "", inner), done + n
            state, n = self.step(START, char)
            return state, done + self.pieces[held] + n
        done = 0 if mode == "" else len(inner[-1][2])
        if kind == "W":
            return ("W", char, FIRST), done
        inner, n = self.feed(FIRST, char)
        return ("A" if char == "'" else kind, "", inner), done + n

    def close(self, inner: tuple, n: int) -> int:
        return n + len(inner[-1][2])

    def end(self, state: State) -> int:
        """Tokens that are completed by the text's end."""
        mode, held, inner = state
        if mode == "A" and held:
            return self.close(inner, 0) + self.pieces[held]
        return self.close(*self.feed(inner, held)) if mode else 0

    def steps(self, state: State, text: str) -> tuple[State, int]:
        total = 0
        for char in text:
            state, n = self.step(state, char)
            total += n
        return state, total

    def through(self, state: State, text: str) -> tuple[State, int]:
        """Step by step up to the first place where a piece begins for certain, piece by piece up to the last piece, and step by step through that."""
        if state == START:
            at, total = 0, 0
        else:
            first = self.seam.search(text)
            if first is None:
                return self.steps(state, text)
            at = first.start()
            state, total = self.steps(state, text[:at])
            # a piece of letters, numbers or signs ends here; the space that follows begins the next one
            total += self.end(state)
        pieces = self.cut(text[at:] if at else text)
        last = len(pieces) - (2 if len(pieces) > 1 and pieces[-2] == "'" and pieces[-1] in ENDINGS else 1)
        for piece in pieces[:last]:
            total += self.pieces[piece]
        state, n = self.steps(START, "".join(pieces[last:]))
        return state, total + n

    def expected(self, before: str) -> State | None:
        """The state at the end of a text, if a piece begins for certain within its last LONGEST_KEPT characters."""
        tail = before[-LONGEST_KEPT:]
        for at in range(len(tail) - 1, 0, -1):
            if self.kind(tail[at]) == "W" and self.kind(tail[at - 1]) != "W":
                return self.steps(START, tail[at:])[0]
        return None

    def maps(self, text: str) -> list[ChunkMap]:
        """The maps of a text's chunks, each worked out for the state that it will most likely be entered in, without the ones before."""
        made = []
        for at in range(0, len(text), CHUNK_CHARS):
            made.append(ChunkMap(self, text[at : at + CHUNK_CHARS]))
            state = self.expected(text[max(0, at - LONGEST_KEPT) : at]) if at else START
            if state is not None:
                made[-1](state)
        return made

    def scan(self, maps: list[Callable[[State], tuple[State, int]]]) -> list[Callable[[State], tuple[State, int]]]:
        """The composition of every prefix of maps, in as many rounds as the log of their number."""
        step = 1
        while step < len(maps):
            maps = [*maps[:step], *(Composed(a, b) for a, b in zip(maps, maps[step:]))]
            step *= 2
        return maps

    def count(self, text: str | None) -> int:
        total = 0
        parts = [text or ""] if self.added is None or not self.added.search(text or "") else self.added.split(text)
        for part in parts:
            if part:
                state, n = self.scan(self.maps(part))[-1](START)
                total += n + self.end(state)
        return total + len(parts) - 1


def once(kind: str, content: bytes, pattern: str) -> object:
    """One coder or counter for each vocabulary in a Python worker, as long as its tasks are of this module."""
    made, key = KEPT.setdefault(__name__, {}), (kind, hashlib.sha256(content).digest(), pattern)
    if key not in made:
        if kind == "count":
            ranks, added = json_vocabulary(content)
            made[key] = Counter(ranks, pattern, added)
        else:
            made[key] = Coder(rank_vocabulary(content), pattern)
    return made[key]


def shipped(spark, path: str):
    """The vocabulary file, read on the driver and broadcast: a file of fixed size, about 1 MB."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def each(of: Callable[[object, object], tuple], kind: str, content, pattern: str) -> Callable[[], Callable[[list], list[tuple]]]:
    """of(machine, value) for each value, with the worker's machine.

    Meanwhile Python doesn't look for cycles: none are made, and each look goes over the machine's hundreds of thousands of tuples."""

    def start() -> Callable[[list], list[tuple]]:
        machine = once(kind, content.value, pattern)

        def made(values: list) -> list[tuple]:
            looks = gc.isenabled()
            gc.disable()
            try:
                return [of(machine, v) for v in values]
            finally:
                if looks:
                    gc.enable()

        return made

    return start


def count_tokens(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), limit: int = 1_024) -> DataFrame:
    """The kept columns, n_bytes, n_tokens and over_limit of every text of docs, by a tokenizer's json file.

    Null and empty texts have 0 bytes and tokens. Texts are counted in chunks,
    whatever their length. Repeated rows and null ids are rows like others, an
    empty table gives an empty result, other columns are ignored."""
    content = shipped(docs.sparkSession, path)

    def of(counter: Counter, text: str | None) -> tuple:
        n = counter.count(text)
        return len((text or "").encode()), n, n > limit

    return beside(docs, keep, "text", "n_bytes long, n_tokens long, over_limit boolean", each(of, "count", content, pattern))


def encode_texts(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ids (array of int) of every text of docs, by a file of ranks; null and empty texts have none."""
    content = shipped(docs.sparkSession, path)
    return beside(docs, keep, "text", "ids array<int>", each(lambda coder, text: (coder.encode(text),), "code", content, pattern))


def decode_ids(encoded: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and the text of every row's ids; bytes that are no UTF-8 become U+FFFD, null ids the empty text."""
    content = shipped(encoded.sparkSession, path)
    return beside(encoded, keep, "ids", "text string", each(lambda coder, ids: (coder.decode(ids or []),), "code", content, pattern))


def encode_digests(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, n_tokens, ids_sha256, decoded_sha256 and valid_utf8 of every text of docs, encoded and decoded again.

    ids_sha256 is of the decimal ids joined by one space, decoded_sha256 of
    the decoded bytes, valid_utf8 whether the stream of these was whole UTF-8.
    Null texts are empty; both digests are then those of no bytes. Repeated
    rows and null ids are rows like others, an empty table gives an empty
    result, other columns are ignored."""
    content = shipped(docs.sparkSession, path)

    def of(coder: Coder, text: str | None) -> tuple:
        ids = coder.encode(text)
        decoded, stream = hashlib.sha256(), Utf8Stream()
        for block in coder.blocks(ids):
            decoded.update(block)
            stream.feed(block)
        stream.feed(b"", last=True)
        return len(ids), hashlib.sha256(coder.spelled(ids).encode()).hexdigest(), decoded.hexdigest(), stream.valid

    return beside(docs, keep, "text", "n_tokens long, ids_sha256 string, decoded_sha256 string, valid_utf8 boolean", each(of, "code", content, pattern))


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("byte_bpe_50k.json"), P.PATTERN)


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
