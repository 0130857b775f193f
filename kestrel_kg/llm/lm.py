"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is a sequence of units: its parts between single spaces, a line feed being a unit of its own, and an end (``laid``; nothing is
lost). A unit is coded by binary decisions. First come up to four: "is it the unit that this context expects?", for the most frequent
unit after the two units before, the unit that last followed the unit before in this text, and the two most frequent ones after the unit
before; one that was refused already isn't asked again. Then: is it a unit of the training texts? If so, order-0 decisions follow; their
probabilities multiply to the unit's share of all training units, so only the product is computed. If not, it is spelled: bits of its
bytes, from contexts of one and two bytes. A question asks for a class of units (those with the same 16 bits of hash). After a yes the unit
is coded among the class: a known one by its share of the class's training units and one more, an unknown one by the rest and its spelling. So
units of one class have scores of their own, and the probabilities of all units add up to at most 1.

Each decision has several predictors: what the hashed context of two units says of the asked unit, what the context of one unit says, and
what the text itself says. Their log odds are added with weights that a gate chooses (which question it is and how often both contexts
were seen), and the outcome is refined by an adaptive probability map. Weights and map are learnt online: every text begins with ``START``
and takes a step on what it has just coded after ``FIRST`` units, then after twice as many, up to ``CHUNK`` (diagonal Newton steps; nothing
is learnt from units to come), so a score depends on the text and the counts alone, not on its neighbours. Sums of log10 probabilities are the scores.

Training. All counts come from all training documents, with no fixed capacity: contexts, units and tokens are kept by range of hash, and
there is a range for each ``range_bytes`` of text. A context of two units is 32 bits of a hash in its range (so about one in 2,000 shares
its counts with another, at every size), a unit after a context 16 bits. The only tables of bounded size are the speller's (at most 257
cubed cells) and the classes' totals. Each block of documents sends each range its distinct contexts and what followed them how
often, which is at once the count and the question; a range adds up all blocks' counts and answers; the answers meet the block's units (not
its text) again. A context that holds so large a share of all units that it would outweigh a range is dealt by what follows it to as many
parts as it fills ranges, and a block asks all of them. Base counts go the same way, by exact words.

Cases: null texts are empty; null ids count as the empty text where their remainder is taken. Repeated rows are rows each. Empty tables
give no rows; without training documents counts are zero. Texts are scored whole; one text is held by one task, at about ten times its
size, and weights of ``SLICE`` texts at once. Extra columns aren't read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import texts, written

#: The end of a text, as a unit and as a token: no unit and no word is like it.
END = b"\n\n"
#: Units before a text's first step of learning, and between two steps at most; texts whose weights are held at once.
FIRST, CHUNK, SLICE = 8, 128, 4096
#: Bits of a context's key in its range, of the unit that follows, and of a unit as a context; up to ``FEW`` of a kind are in one row.
KEY_BITS, NEXT_BITS, WORD_BITS, FEW_BITS = 32, 16, 40, 16
FEW = (1 << FEW_BITS) - 1
U = np.uint64
LOW = U((1 << NEXT_BITS) - 1)
#: The first n bytes of eight.
MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], U)
PRIME, OTHER = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
#: Questions, the last of them "is it known?"; gates of a question; predictors with a constant; cells of the map for a question.
QUESTIONS, GATES, INPUTS, CELLS = 5, 16, 4, 25
#: Weights at a text's beginning by question: context of two units, of one, the text itself, constant.
START = np.array([[0.75, 0.25, 0.5, -0.3], [0.5, 0.45, 0.3, -0.7], [0.3, 0.7, 0.3, -0.3], [0.2, 0.5, 0.3, -0.7], [0, 0, 0, 3.0]])
#: What a weight's start and a cell's middle count as, in decisions; bound of log odds.
CURVATURE, CELL_WEIGHT, LIMIT = 6.0, 12.0, 12.0
#: Where the answers' totals go; scripts go to -1 - block.
TOTALS = 1 << 62
SPELL_END, SYMBOLS = 256, 257
#: Bytes as the speller's symbols.
SPELLED = np.array([SPELL_END if x in b" \t\n\r\x0b\x0c" else x for x in range(256)], np.uint32)
BLANK = np.array([9 <= x <= 13 for x in range(256)])
#: Kinds of a profile's rows; one of how many documents is read to plan how contexts are dealt.
TRIGRAM, HEAVY, COUNT, CLASS = 0, 1, 2, 3
PLANNING = 16


def remainder(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7


def laid(documents: list[bytes]) -> bytes:
    """The documents' units and ends with a space after each. ``text`` undoes it for one document."""
    return b"".join(x.replace(b"\n", b" \n ") + b" " + END + b" " for x in documents)


def text(found: list[bytes]) -> bytes:
    return b" ".join(found[:-1]).replace(b" \n ", b"\n")


def hashed(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the parts of ``data`` before spaces begin, their lengths, and hashes of 64 bits."""
    cuts = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    begins = np.concatenate([[0], cuts[:-1] + 1])
    size = cuts - begins
    eights = np.ndarray(len(data), "<u8", data + bytes(8), strides=(1,))
    out = size.astype(U) * OTHER
    some, at = np.arange(len(begins)), 0
    while len(some):
        value = eights[begins[some] + at] & MASKS[np.minimum(size[some] - at, 8)]
        h = (out[some] + value) * PRIME
        h = (h ^ (h >> U(31))) * OTHER
        out[some] = h ^ (h >> U(29))
        at += 8
        some = some[size[some] > at]
    return begins, size, out


def objects(data: bytes) -> np.ndarray:
    """The parts of ``data`` before spaces."""
    return np.array(data.split(b" ")[:-1], object)


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.flatnonzero(np.append(values[:1] == values[:1], values[1:] != values[:-1]))]


def ordered(keys: np.ndarray, bits: int) -> np.ndarray:
    """The places of the keys (of so many bits) in stable order."""
    own = max(1, int(len(keys)).bit_length())
    if bits + own > 64:
        return np.argsort(keys, kind="stable")
    return (np.sort(keys << U(own) | np.arange(len(keys), dtype=U)) & U((1 << own) - 1)).astype(np.int64)


def numbered(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, and each place's number among them."""
    order = ordered(keys, bits)
    values = keys[order]
    new = np.append(values[:1] == values[:1], values[1:] != values[:-1])
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return values[new], place


class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def pressed(arrays: list[np.ndarray], blob: bytes = b"") -> bytes:
    """Arrays, each as planes of its bytes, and a text, compressed together."""
    head = np.array([len(blob), *map(len, arrays), *(a.itemsize for a in arrays)], "<u8")
    body = b"".join([*map(planes, arrays), blob])
    return head.tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def unpressed(data: bytes, n: int) -> tuple[list[np.ndarray], bytes]:
    head = np.frombuffer(data[: 8 * (2 * n + 1)], "<u8").astype(int)
    blob, lengths, widths = head[0], head[1 : n + 1], head[n + 1 :]
    body = pa.decompress(data[8 * (2 * n + 1) :], int(blob + (lengths * widths).sum()), codec="zstd", asbytes=True)
    out, at = [], 0
    for length, width in zip(lengths, widths, strict=True):
        flat = np.frombuffer(body, np.uint8, length * width, at).reshape(width, length)
        out.append(np.ascontiguousarray(flat.T).view(f"<u{width}").ravel())
        at += length * width
    return out, body[at:]


@dataclass(frozen=True)
class Plan:
    """How contexts are dealt: the number of ranges, and hot contexts with the number of their parts."""

    ranges: int
    hot: dict[int, int] = field(default_factory=dict)

    def keys(self, values: np.ndarray) -> np.ndarray:
        """Hashes: a range, and ``KEY_BITS`` bits in it."""
        values = values * PRIME
        values = (values ^ (values >> U(29))) * OTHER
        values = (values ^ (values >> U(32))) * PRIME
        values ^= values >> U(31)
        return ((values >> U(32)) * U(self.ranges) >> U(32)) << U(KEY_BITS) | values & U((1 << KEY_BITS) - 1)

    def part(self, key: np.ndarray, number: np.ndarray) -> np.ndarray:
        return self.keys(key * OTHER + number + U(1))

    def parts(self) -> dict[int, np.ndarray]:
        return {k: self.part(np.full(n, k, U), np.arange(n, dtype=U)) for k, n in self.hot.items()}

    def parts_in(self, place: int) -> np.ndarray:
        """The keys of parts in a range, without the range."""
        keys = np.concatenate([np.zeros(0, U), *self.parts().values()])
        return (keys[keys >> U(KEY_BITS) == U(place)] & U((1 << KEY_BITS) - 1)).astype(np.uint32)

    def parted(self, key: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Keys that count what follows: those of hot contexts are dealt by it."""
        if self.hot:
            key = key.copy()
            for k, n in self.hot.items():
                pick = np.flatnonzero(key == U(k))
                key[pick] = self.part(key[pick], after[pick] % U(n))
        return key

    def asked(self, key: np.ndarray, warm: list[int]) -> np.ndarray:
        """The sorted keys to ask for, of sorted distinct ones and of the hot contexts ``warm``."""
        own = {k for k in self.hot if U(k) in key}
        if not own and not warm:
            return key
        parts = self.parts()
        return distinct(np.concatenate([key[~np.isin(key, np.array([*own], U))], *(parts[k] for k in own | {*warm})]))

    def of_word(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> U(WORD_BITS - 32)) * U(self.ranges) >> U(32)).astype(np.int64)


class Block:
    """Documents as numbers: a number for each distinct unit and token, by hash; contexts' keys of each place."""

    def __init__(self, ids: list, documents: list[bytes]):
        data = laid(documents)
        begins, size, hashes = hashed(data)
        end = hashed(END + b" ")[2][0]
        ends = np.flatnonzero(hashes == end)
        self.lengths = np.diff(ends, prepend=-1).astype(np.uint32)
        order = ordered(hashes, 64)
        hashes = hashes[order]
        new = np.append(hashes[:1] == hashes[:1], hashes[1:] != hashes[:-1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        first, hashes = order[new], hashes[new]
        words = [data[a : a + n] for a, n in zip(begins[first].tolist(), size[first].tolist(), strict=True)]
        # base tokens: the unit in lower case, but for units with white space, empty ones and ends
        blob = b" ".join([*words, b""]).lower()
        starts, size, tokens = hashed(blob)
        white = np.flatnonzero(BLANK.take(np.frombuffer(blob, np.uint8)))
        odd = np.unique(np.append(np.searchsorted(starts, white, "right") - 1, np.flatnonzero(size == 0)))
        odd = odd[hashes[odd] != end]
        plain = np.delete(np.arange(len(words)), odd)
        more = [(i, w) for i in odd.tolist() for w in words[i].lower().split()]
        of = np.append(plain, np.array([i for i, _ in more], np.int64))
        token = np.append(tokens[plain], hashed(b" ".join([*(w for _, w in more), b""]))[2] if more else np.zeros(0, U))
        every = distinct(np.concatenate([hashes, token]))
        rank, token = np.searchsorted(every, hashes).astype(np.uint32), np.searchsorted(every, token).astype(np.uint32)
        names = np.empty(len(every), object)
        names[token] = np.array([*(x for x in objects(blob)[plain]), *(w for _, w in more)], object)
        names[rank] = np.array(words, object)
        self.words = names.tolist()
        self.hashes = every >> U(64 - WORD_BITS)
        self.ids, self.sizes = ids, np.array([len(x) for x in documents], np.uint64)
        self.train = np.array([remainder(i) != 2 for i in ids], np.uint8)
        self.sequence = rank[number]
        self.of, self.token = rank[of], token
        order = np.argsort(self.of, kind="stable")
        self.of, self.token = self.of[order], self.token[order]
        self.trained = np.repeat(self.train, self.lengths) > 0
        self.n_unit = np.bincount(self.sequence[self.trained], minlength=len(self.words)).astype(U)
        self.n_token = np.bincount(self.token, self.n_unit[self.of].astype(float), len(self.words)).astype(U)

    def asks(self, plan: Plan) -> Iterator[tuple[int, bytes]]:
        one, two = tallies(self.hashes, self.sequence, self.lengths, self.trained, plan)
        bounds = np.arange(plan.ranges + 1)
        word = np.searchsorted(plan.of_word(self.hashes), bounds)
        key = np.searchsorted(two.keys >> U(KEY_BITS), bounds)
        for r in range(plan.ranges):
            w, k = slice(word[r], word[r + 1]), slice(key[r], key[r + 1])
            if k.stop > k.start or w.stop > w.start:
                own = (two.keys[k] & U((1 << KEY_BITS) - 1)).astype(np.uint32)
                yield r, pressed([self.n_unit[w], self.n_token[w], *one.part(w), steps(own), *two.part(k)], b" ".join(self.words[w]))

    def script(self) -> bytes:
        ids = np.array([i or 0 for i in self.ids], np.int64).view(np.uint64)
        known = np.array([i is not None for i in self.ids], np.uint8)
        # the units' bytes are needed only where no training document of the block has them
        rare = np.flatnonzero(self.n_unit == 0).astype(np.uint32)
        of, token = steps(self.of), (self.token.astype(np.int64) - self.of).astype(np.int32).view(np.uint32)
        return pressed([steps(self.hashes), self.sequence, self.lengths, ids, known, self.train, self.sizes, of, token, steps(rare)], b" ".join(self.words[i] for i in rare))


class Tally:
    """What follows each of the sorted ``keys`` how often: values and counts of key k from ``at[k]`` to ``at[k + 1]``."""

    def __init__(self, keys: np.ndarray, at: np.ndarray, after: np.ndarray, n: np.ndarray):
        self.keys, self.at, self.after, self.n = keys, at, after, n

    @classmethod
    def of(cls, keys: np.ndarray, key: np.ndarray, after: np.ndarray) -> Tally:
        """Of a row for each time."""
        key, after = in_order(key, after)
        first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (after[1:] != after[:-1]))) if len(key) else np.zeros(0, np.int64)
        return cls(keys, np.append(np.searchsorted(key[first], keys), len(first)), after[first], np.diff(np.append(first, len(key))))

    def part(self, keys: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pairs = slice(self.at[keys.start], self.at[keys.stop])
        return np.diff(self.at[keys.start : keys.stop + 1]).astype(np.uint32), steps(self.after[pairs]), narrow(self.n[pairs])

    def columns(self, both: bool) -> list[np.ndarray]:
        """Total, most frequent unit, how often (second, how often), of each key."""
        sums = np.concatenate([[0], np.cumsum(self.n)]).astype(np.int64)
        return [narrow(x) for x in (sums[self.at[1:]] - sums[self.at[:-1]], *best(self.after, self.n, self.at[:-1], both))]


def in_order(key: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(key) or int(key.max()) >> (64 - NEXT_BITS):
        order = np.lexsort((after, key))
        return key[order], after[order]
    both = np.sort(key << U(NEXT_BITS) | after)
    return both >> U(NEXT_BITS), (both & LOW).astype(np.uint16)


def tallies(hashes: np.ndarray, sequence: np.ndarray, lengths: np.ndarray, trained: np.ndarray, plan: Plan) -> tuple[Tally, Tally]:
    """What followed one unit (keys are numbers of units) and two units (keys are hashes) in the training documents.

    A hot context of one unit is among the others in parts."""
    before, two = contexts(hashes, sequence, lengths, plan)
    after = following(hashes)[sequence]
    keys = plan.keys(hashes)
    warm = [k for k in plan.hot if (keys == U(k)).any()]
    asked = plan.asked(distinct(two), warm)
    rows = [(plan.parted(two[trained], after[trained]), after[trained])]
    del two
    plain = trained
    for k in warm:
        here = (keys == U(k))[before]
        own = after[trained & here]
        rows.append((plan.parted(np.full(len(own), k, U), own), own))
        plain = plain & ~here
    one = Tally.of(np.arange(len(hashes), dtype=U), before[plain].astype(U), after[plain])
    return one, Tally.of(asked, *(np.concatenate(x) for x in zip(*rows, strict=True)))


def contexts(hashes: np.ndarray, sequence: np.ndarray, lengths: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """The number of the unit before and the key of the two units before, at each place; before a text are ends."""
    n = len(sequence)
    begins = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)[:-1]])
    one, two = np.empty(n, np.uint32), np.empty(n, np.uint32)
    one[1:], two[2:] = sequence[:-1], sequence[:-2]
    one[begins] = two[begins] = sequence[-1]
    second = begins + 1
    two[second[second < n]] = sequence[-1]
    return one, plan.keys(hashes[one] * PRIME + (hashes[two] << U(1)) + U(1))


def following(hashes: np.ndarray) -> np.ndarray:
    return hashes >> U(WORD_BITS - NEXT_BITS)


def best(values: np.ndarray, n: np.ndarray, at: np.ndarray, both: bool) -> list[np.ndarray]:
    """Of each stretch of ``values`` that begins at ``at``: the most frequent one, ties to the smaller, and how often; the second one."""
    size = np.diff(np.append(at, len(values)))
    score = n.astype(U) << U(NEXT_BITS) | (LOW - values.astype(U))
    filled = np.flatnonzero(size)
    out = []
    for _ in range(1 + both):
        top = np.zeros(len(at), U)
        if len(filled):
            top[filled] = np.maximum.reduceat(score, at[filled])
            score = np.where(score == np.repeat(top, size), U(0), score)
        out += [np.where(top > 0, LOW - (top & LOW), U(0)), top >> U(NEXT_BITS)]
    return out


def added(keys: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> Tally:
    """The sum of tallies: (keys, how many units follow each, these, how often). Keys have at most ``KEY_BITS`` bits."""
    pairs = []
    for key, several, after, n in rows:
        pair = np.repeat(key, several).astype(U) << U(NEXT_BITS) | after
        # more than FEW of a kind as several rows
        n, much = n.astype(np.int64), np.flatnonzero(n > FEW)
        full, rest = np.divmod(n[much] - 1, FEW)
        n[much] = rest + 1
        pairs += [pair << U(FEW_BITS) | n.astype(U), np.repeat(pair[much] << U(FEW_BITS) | U(FEW), full)]
    pair = np.sort(np.concatenate(pairs))
    n = (pair & U(FEW)).astype(np.int64)
    pair >>= U(FEW_BITS)
    first = np.flatnonzero(np.append(pair[:1] == pair[:1], pair[1:] != pair[:-1]))
    pair = pair[first]
    at = np.append(np.searchsorted(pair, keys.astype(U) << U(NEXT_BITS)), len(pair))
    return Tally(keys, at, (pair & LOW).astype(np.uint16), np.add.reduceat(n, first) if len(first) else n)


def told(columns: list[np.ndarray], own: list[np.ndarray]) -> list[np.ndarray]:
    """Columns of a tally as what a block doesn't know from its own; ``heard`` undoes it. Mostly there is little to tell."""
    total, top, n, *rest = columns
    return [total - own[0], top ^ own[1], np.where(top == own[1], n - own[2], n), *rest]


def heard(told: list[np.ndarray], own: list[np.ndarray]) -> list[np.ndarray]:
    total, top, n, *rest = told
    return [signed(x) for x in (total + own[0], top ^ own[1], np.where(top == 0, n + own[2], n), *rest)]


def answered(asked: list[bytes], parts: np.ndarray) -> tuple[list[bytes], bytes]:
    """The answers of a range to each block, and its totals. Of contexts of two units the second most frequent one is told only for
    ``parts``, the keys of hot contexts' parts in this range."""
    numbers, words, units, tokens, ones, twos = Numbers(), [], [], [], [], []
    for data in asked:
        (n_unit, n_token, several, after, n, delta, *more), blob = unpressed(data, 9)
        own = np.fromiter(map(numbers.__getitem__, blob.split(b" ")), np.uint32, len(n_unit)) if len(n_unit) else np.zeros(0, np.uint32)
        words.append(own)
        ones.append((own, several, np.cumsum(after, dtype=np.uint16), n))
        twos.append((np.cumsum(delta, dtype=np.uint32), more[0], np.cumsum(more[1], dtype=np.uint16), more[2]))
        units.append(n_unit)
        tokens.append(n_token)
    every = np.concatenate(words)
    n_unit, n_token = (np.bincount(every, np.concatenate(x).astype(float), len(numbers)).astype(np.int64) for x in (units, tokens))
    one = added(np.arange(len(numbers), dtype=np.uint32), ones).columns(True)
    found = distinct(np.concatenate([k for k, *_ in twos]))
    two = added(found, twos).columns(True)
    two[3:] = [np.where(np.isin(found, parts), x, x.dtype.type(0)) for x in two[3:]]
    out = []
    for a, b in zip(ones, twos, strict=True):
        i, k = a[0], np.searchsorted(found, b[0])
        more = n_token[i] - n_unit[i]
        out.append(pressed([narrow(n_unit[i]), narrow(more * 2 ^ more >> 63), *told([c[i] for c in one], own_columns(*a[1:])), *told([c[k] for c in two], own_columns(*b[1:]))]))
    return out, pressed([np.array([n_token.sum(), (n_token > 0).sum(), n_unit.sum()], U)])


def own_columns(several: np.ndarray, after: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    return Tally(several, np.concatenate([[0], np.cumsum(several, dtype=np.int64)]), after, n).columns(False)


def steps(values: np.ndarray) -> np.ndarray:
    """Differences of rising numbers."""
    return np.diff(values, prepend=values.dtype.type(0))


def narrow(values: np.ndarray) -> np.ndarray:
    """In four bytes each where that holds them."""
    return values.astype(U if len(values) and values.max() >= 1 << 31 else np.uint32)


def signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.int64 if values.itemsize > 4 else np.int32)


class Speller:
    """Bits of bytes from how often each byte follows one and two bytes in the training texts; a word begins and ends at white space."""

    def __init__(self, trigrams: np.ndarray, n: np.ndarray):
        two, symbol = np.divmod(trigrams.astype(np.int64), SYMBOLS)
        self.seen, row = np.unique(two, return_inverse=True)
        second = np.zeros((len(self.seen) + 1, SYMBOLS + 1), np.int64)
        np.add.at(second, (row, symbol + 1), n)
        first = np.zeros((SYMBOLS, SYMBOLS + 1), np.int64)
        np.add.at(first, (two % SYMBOLS, symbol + 1), n)
        self.first, self.second = np.cumsum(first, 1), np.cumsum(second, 1)

    def costs(self, words: list[bytes]) -> np.ndarray:
        """log10 of each word's probability, its end included."""
        if not words:
            return np.zeros(0)
        codes, begins = spelled(words)
        two, symbol = np.divmod(codes, SYMBOLS)
        row = np.searchsorted(self.seen, two)
        row = np.where((row < len(self.seen)) & (self.seen[np.minimum(row, len(self.seen) - 1)] == two), row, len(self.seen)) if len(self.seen) else np.zeros(len(two), int)
        cost = np.zeros(len(codes))
        low, high = np.zeros(len(codes), np.int64), np.full(len(codes), SYMBOLS)
        for bit in range(9):
            middle = np.full(len(codes), SPELL_END) if bit == 0 else (low + high) // 2
            one = symbol >= middle
            z = np.zeros(len(codes))
            sure = None
            for table, at in ((self.second, row), (self.first, two % SYMBOLS)):
                ones, both = table[at, high] - table[at, middle], table[at, high] - table[at, low]
                odds = np.log((ones + 0.05) / (both - ones + 0.05))
                weight = np.minimum(both, 20) / 20 * 0.8 if sure is None else 1 - sure
                sure = weight if sure is None else sure
                z += weight * np.clip(odds, -LIMIT, LIMIT)
            live = (high - low > 1) | (bit == 0)
            cost -= np.where(live, np.logaddexp(0, np.where(one, -z, z)), 0)
            low, high = np.where(one, middle, low), np.where(one, high, middle)
            if bit == 0:
                low, high = np.where(one, SPELL_END, 0), np.where(one, SYMBOLS, SPELL_END)
        return np.add.reduceat(cost, begins) / math.log(10)


def trigrams(documents: list[bytes]) -> np.ndarray:
    """Each byte with the two before it, as one number; white space and ends alike are ``SPELL_END``, as before the first byte."""
    x = SPELLED.take(np.frombuffer(b"  ".join([b"", *documents, b""]), np.uint8))
    return (x[:-2] * np.uint32(SYMBOLS) + x[1:-1]) * np.uint32(SYMBOLS) + x[2:]


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each byte and end of each word, with the two bytes before it (ends before a word), as one number; where words begin."""
    size = np.array([len(w) + 3 for w in words])
    begins = np.cumsum(size) - size
    x = np.full(size.sum(), SPELL_END, np.int64)
    inner = np.ones(len(x), bool)
    inner[begins] = inner[begins + 1] = inner[begins + size - 1] = False
    x[inner] = np.frombuffer(b"".join(words), np.uint8)
    inner[begins + size - 1] = True
    at = np.flatnonzero(inner)
    return (x[at - 2] * SYMBOLS + x[at - 1]) * SYMBOLS + x[at], begins - 2 * np.arange(len(words))


def odds(n: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return np.log((n + 0.4) / (rest + 0.4))


def sureness(n: np.ndarray) -> np.ndarray:
    return (n > 0).astype(np.int64) + (n >= 3) + (n >= 20)


def spans(longest: int) -> Iterator[tuple[int, int]]:
    """Where each stretch between two steps of learning begins, and its units."""
    a, span = 0, FIRST
    while a < longest:
        yield a, span
        a, span = a + span, min(2 * span, CHUNK)


def mix(after: np.ndarray, lengths: np.ndarray, last: np.ndarray, two: tuple[list[np.ndarray], np.ndarray], one: tuple[list[np.ndarray], np.ndarray], known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the decisions' log probabilities for each text, and which units no question found.

    ``after``: the units' hashes; ``last``: what last followed the unit before in the text, or -1; ``two``, ``one``: total, most frequent,
    how often (for one unit also second, how often) of each context, and each place's number among them; ``known``: is the unit in the training texts.
    """
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    out, missed = np.zeros(len(lengths)), np.zeros(len(after), bool)
    alive = np.flatnonzero(lengths > 0)
    size = QUESTIONS * GATES
    weights = [np.tile(np.repeat(START[:, k], GATES), (len(lengths), 1)) for k in range(INPUTS)]
    bend = [np.full((len(lengths), size), CURVATURE) for _ in range(INPUTS)]
    middle = 1 / (1 + np.exp(-np.linspace(-LIMIT, LIMIT, CELLS)))
    hits = np.tile(CELL_WEIGHT * middle, (len(lengths), QUESTIONS))
    tries = np.full((len(lengths), QUESTIONS * CELLS), CELL_WEIGHT)
    for a, span in spans(int(lengths.max(initial=0))):
        alive = alive[lengths[alive] > a]
        n = np.minimum(lengths[alive] - a, span)
        upto = np.cumsum(n)
        lane = np.repeat(np.arange(len(alive)), n)  # the text, among those that go on
        place = np.arange(upto[-1]) + np.repeat(begins[alive] + a - upto + n, n)
        w = [x[alive].ravel() for x in weights]
        cell_hits, cell_tries = hits[alive].ravel(), tries[alive].ravel()
        learnt, cells = [], []
        target, text = after[place], last[place]
        t2, t1 = ([x.take(number.take(place)) for x in found] for found, number in (two, one))
        gate = lane * size + sureness(t2[0]) * 4 + sureness(t1[0])
        left = [t2[0].copy(), t1[0].copy()]
        asked = [t2[1], text, t1[1], t1[3]]
        there = [t2[2] > 0, text >= 0, t1[2] > 0, t1[4] > 0]
        still = np.arange(len(place))
        for q in range(QUESTIONS):
            if q < QUESTIONS - 1:
                pick = still[there[q][still]]
                x = asked[q].take(pick)
                for e in range(q):
                    fresh = np.flatnonzero((asked[e].take(pick) != x) | ~there[e].take(pick))
                    if len(fresh) < len(pick):
                        pick, x = pick[fresh], x[fresh]
                y = x == target.take(pick)
                inputs = []
                for t, rest in ((t2, left[0]), (t1, left[1])):
                    count = (t[1].take(pick) == x) * t[2].take(pick)
                    if len(t) > 3:
                        count += (t[3].take(pick) == x) * t[4].take(pick)
                    others = np.maximum(rest.take(pick) - count, 0)
                    inputs.append(np.where(t[0].take(pick) > 0, odds(count, others), 0))
                    rest[pick] -= count
                own = text.take(pick)
                inputs.append(np.where(own < 0, 0.0, np.where(own == x, 1.0, -1.0)))
            else:
                pick, y, inputs = still, known[place[still]], []
                missed[place[pick]] = True
            g = gate.take(pick) + q * GATES
            z = w[INPUTS - 1].take(g)
            for k, value in enumerate(inputs):
                z += w[k].take(g) * value
            np.clip(z, -LIMIT, LIMIT, out=z)
            p = 1 / (1 + np.exp(-z))
            c = (lane.take(pick) * QUESTIONS + q) * CELLS + np.rint((z + LIMIT) * ((CELLS - 1) / (2 * LIMIT))).astype(np.int64)
            refined = (p + cell_hits.take(c) / cell_tries.take(c)) / 2
            out[alive] += np.bincount(lane.take(pick), np.log(np.where(y, refined, 1 - refined)), len(alive))
            learnt.append((g, [*inputs, *[np.zeros(len(g))] * (INPUTS - 1 - len(inputs)), np.ones(len(g))], y - p, p * (1 - p)))
            cells.append((c, y))
            if q < QUESTIONS - 1:
                found_ = np.zeros(len(place), bool)
                found_[pick[y]] = True
                still = still[~found_[still]]
        g, miss, bent = (np.concatenate([x[i] for x in learnt]) for i in (0, 2, 3))
        for k in range(INPUTS):
            value = np.concatenate([x[1][k] for x in learnt])
            slope = value * miss
            own = bend[k][alive].ravel() + 2 * np.bincount(g, value * value * bent, len(w[k]))
            bend[k][alive] = own.reshape(-1, size)
            weights[k][alive] = (w[k] + np.bincount(g, slope, len(w[k])) / own).reshape(-1, size)
        c, y = (np.concatenate([x[i] for x in cells]) for i in range(2))
        hits[alive] = (cell_hits + np.bincount(c, y, len(cell_hits))).reshape(len(alive), -1)
        tries[alive] = (cell_tries + np.bincount(c, minlength=len(cell_hits))).reshape(len(alive), -1)
    return out, missed


def last_after(sequence: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The place of the unit that last followed each place's unit before, earlier in the text; -1: none."""
    doc = np.repeat(np.arange(len(lengths), dtype=U), lengths)
    before = np.zeros(len(sequence), U)
    before[1:] = sequence[:-1] + U(1)
    before[np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)[:-1]])] = 0
    key = doc * (U(sequence.max(initial=0)) + U(2)) + before
    order = ordered(key, int(key.max(initial=0)).bit_length())
    out = np.full(len(sequence), -1)
    out[order[1:]] = np.where(key[order[1:]] == key[order[:-1]], order[:-1], -1)
    return out


def collected(columns: list[np.ndarray], parts: np.ndarray) -> list[int]:
    """Total, most frequent, how often, second, how often, of a hot context from its parts."""
    value, n = (np.concatenate([columns[i][parts], columns[i + 2][parts]]).astype(np.int64) for i in (1, 2))
    a, b = np.lexsort((value, -n))[:2]
    return [columns[0][parts].sum(), value[a], n[a], value[b], n[b]]


def known_contexts(hashes, sequence, lengths, trained, got: list[np.ndarray], plan: Plan) -> tuple[tuple, tuple]:
    """Columns of the contexts of one and of two units, and each place's number among them, from the answers."""
    own = tallies(hashes, sequence, lengths, trained, plan)
    if [len(x.keys) for x in own] != [len(got[0]), len(got[5])]:
        raise ValueError("a block was read with other documents than before")
    first, second, asked = heard(got[:5], own[0].columns(False)), heard(got[5:], own[1].columns(False)), own[1].keys
    del own
    before, key = contexts(hashes, sequence, lengths, plan)
    key, number = numbered(key, KEY_BITS + plan.ranges.bit_length())
    place = np.minimum(np.searchsorted(asked, key), len(asked) - 1)
    one, two = (first, before), ([x[place] for x in second[:3]], number)
    for k, some in plan.parts().items():
        for found, own_keys in ((one[0], plan.keys(hashes)), (two[0], key)):
            pick = np.flatnonzero(own_keys == U(k))
            if len(pick):
                for column, x in zip(found, collected(second, np.searchsorted(asked, some)), strict=False):
                    column[pick] = x
    return one, two


def scored(script: bytes, answers: list[bytes], speller: Speller, plan: Plan, classes: np.ndarray) -> dict[str, np.ndarray]:
    """A block's columns. ``answers`` by range; ``classes``: training units of each class."""
    (hashes, sequence, lengths, ids, named, train, sizes, of, token, rare), blob = unpressed(script, 10)
    hashes, of, rare = (np.cumsum(x, dtype=x.dtype) for x in (hashes, of, rare))
    token = token.view(np.int32) + of.astype(np.int64)
    n_unit, more, *got = (np.concatenate(x) for x in zip(*(unpressed(a, 12)[0] for a in answers), strict=True))
    n_unit, more = n_unit.astype(np.int64), more.astype(np.int64)
    n_token = n_unit + (more >> 1 ^ -(more & 1))
    one, two = known_contexts(hashes, sequence, lengths, np.repeat(train, lengths) > 0, got, plan)
    del got
    after = following(hashes)[sequence].astype(np.int32)
    earlier = last_after(sequence, lengths)
    last = np.where(earlier >= 0, after[earlier], np.int32(-1))
    del earlier
    known = n_unit[sequence] > 0
    lengths = lengths.astype(np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    value, missed = np.zeros(len(lengths)), np.zeros(len(sequence), bool)
    for i in range(0, len(lengths), SLICE):
        part = slice(begins[i], begins[i + SLICE] if i + SLICE < len(lengths) else len(sequence))
        value[i : i + SLICE], missed[part] = mix(after[part], lengths[i : i + SLICE], last[part], (two[0], two[1][part]), (one[0], one[1][part]), known[part])
    share = np.where(known, np.log10(np.maximum(n_unit, 1))[sequence], 0)
    share -= np.where(missed, 0, np.log10(classes + 1.0)[after])
    unknown = np.unique(sequence[~known])
    cost = np.zeros(len(hashes))
    words = blob.split(b" ")
    cost[unknown] = speller.costs([words[i] for i in np.searchsorted(rare, unknown)])
    share += np.where(known, 0, cost[sequence])
    each = [np.bincount(of, x, len(hashes)) for x in (np.ones(len(of)), (n_token[token] > 0).astype(float), np.log10(n_token[token] + 1.0))]
    n_tokens, n_known, base = (np.add.reduceat(x[sequence], begins) for x in each)
    return {
        "doc_id": np.ma.masked_array(ids.view(np.int64), named == 0), "held_out": train == 0, "n_tokens": n_tokens.astype(np.int64), "n_known": n_known.astype(np.int64),
        "base": base, "value": value / math.log(10) + np.add.reduceat(share, begins), "n_shares": np.add.reduceat((missed & known).astype(np.int64), begins), "n_bytes": sizes.astype(np.int64),
    }


def in_blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[list, list[bytes]]]:
    ids, held, size = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
            ids.append(doc)
            held.append(text)
            size += len(text) + 100
            if size >= block_bytes:
                yield ids, held
                ids, held, size = [], [], 0
    if held:
        yield ids, held


def class_counts(documents: list[bytes]) -> np.ndarray:
    """Units of each class."""
    n = np.zeros(1 << NEXT_BITS, np.int64)
    return n + np.bincount((hashed(laid(documents))[2] >> U(64 - NEXT_BITS)).astype(np.int64), minlength=len(n)) if documents else n


def profile(docs: DataFrame, block_bytes: int, share: float, plan: Plan) -> DataFrame:
    """kind, key, n: trigrams of all training texts' bytes; their units by class; contexts with ``share`` of the units; the number of units.

    Contexts are counted in one of ``PLANNING`` documents: they only say how rows are dealt, and no result depends on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, held in in_blocks(batches, block_bytes):
            training = [x for i, x in zip(ids, held, strict=True) if remainder(i) != 2]
            codes = np.sort(trigrams(training))
            first = np.flatnonzero(np.append(codes[:1] == codes[:1], codes[1:] != codes[:-1]))
            n = class_counts(training)
            rows = [(TRIGRAM, codes[first], np.diff(np.append(first, len(codes)))), (CLASS, np.flatnonzero(n), n[n > 0])]
            own = Block(*map(list, zip(*list(zip(ids, held, strict=True))[::PLANNING], strict=True)))
            before, two = contexts(own.hashes, own.sequence, own.lengths, plan)
            for key in (plan.keys(own.hashes)[before], two):
                key, number = numbered(key, 64)
                n = np.bincount(number)
                often = np.flatnonzero(n >= share * len(number))
                rows.append((HEAVY, key[often], n[often]))
            rows.append((COUNT, [0], [len(own.sequence)]))
            columns = (np.repeat([k for k, *_ in rows], [len(x) for _, x, _ in rows]).astype(np.int32), *(np.concatenate([r[i] for r in rows]).astype(np.int64) for i in (1, 2)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "key", "n"])

    return docs.mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, *, block_bytes: int = 8 << 20, range_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte of every document.

    ``block_bytes``: text that one step of a task holds; ``range_bytes``: text for which there is a range of contexts.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = max(math.ceil(size / range_bytes), 8)  # of the data alone: contexts that share counts don't depend on the session
    found = written(profile(docs, block_bytes, 1 / min(ranges, 10_000), Plan(ranges)), "profile")
    trigrams = found.where(F.col("kind") == TRIGRAM).select("key", "n").toArrow()
    number = found.where(F.col("kind") == COUNT).select("n").first()
    least = max(1, math.ceil((number.n if number else 0) / min(ranges, 10_000)))
    hot = {x.key: math.ceil(x.n / least) + 1 for x in found.where((F.col("kind") == HEAVY) & (F.col("n") >= least)).select("key", "n").collect()}
    some, classes = found.where(F.col("kind") == CLASS).select("key", "n").toArrow(), np.zeros(1 << NEXT_BITS, np.int64)
    classes[some["key"].to_numpy()] = some["n"].to_numpy()
    shared = spark.sparkContext.broadcast((Speller(trigrams["key"].to_numpy(), trigrams["n"].to_numpy()), Plan(ranges, hot), classes))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, (ids, held) in enumerate(in_blocks(batches, block_bytes)):
            block, own = (TaskContext.get().partitionId() << 32) + k, Block(ids, held)
            rows = [*own.asks(shared.value[1]), (-1 - block, own.script())]
            for a in range(0, len(rows), 500):
                some = rows[a : a + 500]
                columns = [pa.array([r for r, _ in some], pa.int64()), pa.array([block] * len(some), pa.int64()), pa.array([d for _, d in some], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["place", "block", "data"])

    def answer(table: pa.Table) -> pa.Table:
        place = table.column("place")[0].as_py()
        rows = []
        if place >= 0:
            blocks = table.column("block").to_pylist()
            out, totals = answered(table.column("data").to_pylist(), shared.value[1].parts_in(place))
            rows = [*((-1 - b, place, x) for b, x in zip(blocks, out, strict=True)), (TOTALS, place, totals)]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["place", "step", "data"])

    schema = T.StructType.fromDDL("doc_id long, held_out boolean, n_tokens long, n_known long, base double, value double, n_shares long, n_bytes long, v long")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = [d for _, d in sorted(zip(right.column("step").to_pylist(), right.column("data").to_pylist(), strict=True))]
        if left.num_rows and answers:
            found = scored(left.column("data")[0].as_py(), answers, *shared.value)
            columns = [pa.array(found[f.name]) if f.name != "v" else pa.nulls(len(found["held_out"]), pa.int64()) for f in schema]
        elif answers:
            n, v, all_units = sum(unpressed(x, 1)[0][0].astype(np.int64) for x in answers)
            columns = [pa.array([x], t) for x, t in ((None, pa.int64()), (None, pa.bool_()), (n, pa.int64()), (None, pa.int64()), (None, pa.float64()), (None, pa.float64()), (all_units, pa.int64()), (None, pa.int64()), (v, pa.int64()))]
        else:
            columns = [pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())]
        return pa.Table.from_arrays(columns, names=schema.names)

    rows = docs.mapInArrow(ask, "place long, block long, data binary")
    answers = rows.groupBy("place").applyInArrow(answer, "place long, step long, data binary")
    out = written(rows.groupBy("place").cogroup(answers.groupBy("place")).applyInArrow(finish, schema), "scores")
    totals = out.where("v is not null").select("n_tokens", "v", "n_shares").first()
    n, v, all_units = totals or (0, 0, 0)
    value = F.col("value") - F.col("n_shares") * F.lit(math.log10(max(all_units, 1)))
    base = F.col("base") - F.col("n_tokens") * F.lit(math.log10(n + v + 1))
    bits = -value / F.lit(math.log10(2)) / F.greatest("n_bytes", F.lit(1))
    return out.where("v is null").select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), value.alias("score"), "n_bytes", bits.alias("bits_per_byte"))
