"""Collocations: frequent phrases of two to four words whose parts seldom occur without each other.

Words of a text are lower-cased (A-Z) and parted by blanks and tabs; pieces end at ``.,;:!?`` and line ends, and no phrase crosses them.

* **Blocks.** A task turns its texts into blocks of about ``BLOCK`` words: a sequence of numbers that the block gives its own words, and how
  often each occurs. Long texts are read in slices, so a block ends within a text if need be, but only at the end of a piece.
* **Words.** Their counts are range-partitioned, sorted and run-length added up; a frequent word gets an id, which goes back to the blocks
  that hold it. These ids are the dictionary, all other words break the pieces.
* **Phrases**, level by level. A phrase of k + 1 words can only be frequent if its first and last k words are, so its key is the pair
  of their ids, 128 bits at every level, and only places where both are frequent are counted. A block counts its phrases first and
  sorts them. Splitters, drawn from the phrases of some blocks, cut the keys into ``RANGES`` ranges; of each range a block sends one packed
  message. A range's task sorts the keys of its messages by radix, run-length adds up, and answers every message with the ids of its
  frequent keys.

A word or phrase is one entry a block, however often it occurs, so a common one doesn't load a task, and splitters only decide how evenly
ranges are dealt. With the number of blocks ranges are dealt further by a hash of the key, so a range's entries stay bounded; a message
holds at least one entry, so messages never outnumber entries. Nothing that grows with the input is sent to all tasks or the driver.
Memory: a task holds one block (a piece without any end makes its block longer) or one range. Blocks and ids are written to the shared folder.

Defined results: null texts have no words; a null language is ``und``. Bytes beyond ASCII, of whatever encoding, are parts of words.
Repeated rows count as often as they occur. An empty table gives an empty result. Columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import texts, written

#: Words of a block, bytes of a slice, rows of an Arrow batch that is passed on, bytes of one with messages.
BLOCK, SLICE, ROWS, BYTES = 2_000_000, 1 << 20, 1 << 16, 1 << 22
#: Ranges of keys, blocks from which splitters are drawn, keys drawn, and blocks for which a range isn't dealt further.
RANGES, SAMPLED, DRAWN, DEALT = 2048, 32, 200_000, 4096
#: Separators become line ends, tabs blanks, A-Z a-z. A capital can't occur any more, so it can stand for the end of a piece.
TABLE = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\n" * 10 + b" abcdefghijklmnopqrstuvwxyz")
END = b"E"
UNKNOWN = "und"
COUNTS = "kind int, block long, local long, n long, lang string, word binary, seq binary"


class Numbers(dict):
    """word -> its number in the block; numbers are shared by the block's languages."""

    def __init__(self, lang: str, words: list[tuple[str, bytes]]) -> None:
        self.lang, self.words = lang, words
        self[END] = 0

    def __missing__(self, word: bytes) -> int:
        self.words.append((self.lang, word))
        value = self[word] = len(self.words)
        return value


def slices(text: bytes, size: int) -> Iterator[tuple[bytes, bool]]:
    """A translated text in slices that don't cut words, and whether a piece ends there."""
    at = 0
    while len(text) - at > size:
        cut = text.rfind(b"\n", at, at + size)
        ended = cut >= at
        if not ended:
            cut = text.rfind(b" ", at, at + size)
        if cut < at:  # one word is longer
            ends = [x for x in (text.find(b"\n", at), text.find(b" ", at)) if x >= 0]
            if not ends:
                break
            cut = min(ends)
            ended = text[cut] == 10
        yield text[at : cut + 1], ended
        at = cut + 1
    yield text[at:], True


def encode(batches: Iterator[pa.RecordBatch], block_words: int, slice_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches of (text, lang) as blocks: their words (kind 0) and their sequence (kind 1)."""
    task, made = TaskContext.get().partitionId(), 0
    words: list[tuple[str, bytes]] = []
    numbers: dict[str, Numbers] = {}
    parts: list[np.ndarray] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        seq = np.concatenate(parts)
        block = task << 32 | made
        counts = np.bincount(seq, minlength=len(words) + 1)[1:]
        for s in range(0, len(words), ROWS):
            some = words[s : s + ROWS]
            n = len(some)
            langs, names = pa.array([x[0] for x in some], pa.string()), pa.array([x[1] for x in some], pa.binary())
            yield batch([np.zeros(n, np.int32), np.full(n, block), np.arange(s + 1, s + 1 + n), counts[s : s + n], langs, names, pa.nulls(n, pa.binary())])
        packed = pa.array([zstandard.compress(seq.tobytes(), 3)], pa.binary())
        yield batch([np.ones(1, np.int32), np.array([block]), np.zeros(1, np.int64), np.zeros(1, np.int64), pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), packed])

    for b in batches:
        for text, lang in zip(texts(b), b.column(1).to_pylist(), strict=True):
            lang = UNKNOWN if lang is None else lang
            for part, ended in slices(text.translate(TABLE), slice_bytes):
                own = numbers.get(lang)
                if own is None:
                    own = numbers[lang] = Numbers(lang, words)
                found = part.replace(b"\n", b" " + END + b" ").split()
                if found:
                    parts.append(np.fromiter(map(own.__getitem__, found), np.int32, len(found)))
                    size += len(found)
                if ended and size:
                    parts.append(np.zeros(1, np.int32))
                if ended and size >= block_words:
                    yield from flush()
                    words, numbers, parts, size, made = [], {}, [], 0, made + 1
    if words:
        yield from flush()


def batch(columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=[x.split()[0] for x in COUNTS.split(", ")])


def frequent(counts: DataFrame, keys: list[str], least: int) -> DataFrame:
    """block, local, id of the rows whose key adds up to at least ``least``; a key's first row (head) has f, the sum, and the key, too."""
    kinds = dict(counts.dtypes)
    schema = "block long, local long, id long, f long, head boolean, " + ", ".join(f"{k} {kinds[k]}" for k in keys)
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId() << 40, 0
        open_, last = [], None  # the rows of the run that may go on, and its key

        def borders(rows: pa.RecordBatch) -> np.ndarray:
            new = np.zeros(rows.num_rows, bool)
            new[:1] = True
            for c in rows.columns[:width]:
                new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
            return np.flatnonzero(new)

        def close(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            """The frequent keys' rows of whole runs."""
            nonlocal made
            starts = borders(rows)
            total = np.add.reduceat(rows.column(width + 2).to_numpy(), starts)
            sizes = np.diff([*starts, rows.num_rows])
            good = total >= least
            ids = np.repeat(task + made + np.cumsum(good), sizes)
            made += int(good.sum())
            take = np.flatnonzero(np.repeat(good, sizes))
            total, head = np.repeat(total, sizes), np.zeros(rows.num_rows, bool)
            head[starts] = True
            for s in range(0, len(take), ROWS):
                at = take[s : s + ROWS]
                some, first = rows.take(pa.array(at)).columns, pa.array(head[at])
                named = [pc.if_else(first, c, pa.scalar(None, c.type)) for c in some[:width]]
                yield pa.RecordBatch.from_arrays([*some[width : width + 2], *(pa.array(x[at]) for x in (ids, total)), first, *named], names=["block", "local", "id", "f", "head", *keys])

        key = lambda rows: tuple(c[0].as_py() for c in rows.columns[:width])
        for b in batches:
            if not b.num_rows:
                continue
            starts = borders(b)
            if open_ and (key(b) != last or len(starts) > 1):
                until = 0 if key(b) != last else int(starts[1])
                yield from close(pa.concat_batches([*open_, b.slice(0, until)]))
                open_, b, starts = [], b.slice(until), starts[starts >= until] - until
            if len(starts) > 1:
                yield from close(b.slice(0, int(starts[-1])))
                b = b.slice(int(starts[-1]))
            last = key(b)
            open_.append(b)
        if open_:
            yield from close(pa.concat_batches(open_))

    rows = counts.select(*keys, "block", "local", "n")
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of longs, byte by byte: the high bytes are alike, so that the shuffle's compression drops them."""
    return b"".join(np.ascontiguousarray(c.astype("<i8").view(np.uint8).reshape(len(c), 8).T).tobytes() for c in columns)


def unpack(data: bytes, width: int) -> list[np.ndarray]:
    planes = np.frombuffer(data, np.uint8).reshape(width, 8, -1)
    return [np.ascontiguousarray(p.T).view("<i8").ravel() for p in planes]


def radix_order(*keys: np.ndarray) -> np.ndarray:
    """The order of rows by non-negative keys, the first one leading: stable passes over 16-bit digits from the last to the first."""
    order = np.arange(len(keys[0]))
    for key in reversed(keys):
        for shift in range(0, 64, 16):
            digit = (key >> shift & 0xFFFF).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


class Levels:
    """A block's phrases, made anew level by level from its sequence and the ids that have come back to it."""

    def __init__(self, seq: np.ndarray, ids: dict[int, list[tuple[np.ndarray, np.ndarray]]]) -> None:
        self.ids = ids
        self.known = self.of(0, int(seq.max(initial=0)))
        self.place = np.flatnonzero(self.known[seq])
        self.local = seq[self.place].astype(np.int64)

    def of(self, level: int, most: int) -> np.ndarray:
        """The id of each of the level's local numbers; 0: not frequent."""
        out = np.zeros(most + 1, np.int64)
        for local, found in self.ids.get(level, []):
            out[local] = found
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct pairs of neighbours by their ids a and b, in that order, with their counts; the places, and their pairs' numbers."""
        at = np.flatnonzero(np.diff(self.place) == 1)
        both, inverse, n = np.unique(self.local[at] << 32 | self.local[at + 1], return_inverse=True, return_counts=True)
        a, b = self.known[both >> 32], self.known[both & 0xFFFFFFFF]
        order = radix_order(a, b)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(1, len(order) + 1)
        return a[order], b[order], n[order], self.place[at], rank[inverse]

    def step(self, level: int) -> None:
        """On to the phrases one word longer."""
        a, _, _, place, local = self.pairs()
        self.known = self.of(level, len(a))
        good = np.flatnonzero(self.known[local])
        self.place, self.local = place[good], local[good]


def by_block(blocks: DataFrame, levels: list[DataFrame], use, schema: str) -> DataFrame:
    """What ``use`` makes of each block and its ``Levels``. A block's ids come before its sequence in a task.

    ``levels``: for words (block, local, id), for phrases (block, data: local numbers and ids packed)."""
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    both = blocks.where("kind = 1").select("block", F.lit(99).alias("kind"), none("long", "local"), none("long", "id"), F.col("seq").alias("data"))
    for n, level in enumerate(levels):
        more = (F.col("local"), F.col("id"), none("binary", "data")) if n == 0 else (none("long", "local"), none("long", "id"), F.col("data"))
        both = both.unionByName(level.select("block", F.lit(n).alias("kind"), *more))
    depth = len(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, {}
        for b in batches:
            numbers, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(numbers) != 0) | (np.diff(kinds) != 0)) + 1), b.num_rows]
            for start, end in zip(edges, edges[1:], strict=False):
                if start == end:
                    continue
                if numbers[start] != block:
                    block, held = numbers[start], {}
                kind = int(kinds[start])
                if kind == 0:
                    part = b.slice(start, end - start)
                    held.setdefault(0, []).append((part.column(2).to_numpy(), part.column(3).to_numpy()))
                elif kind < 99:
                    held.setdefault(kind, []).extend(unpack(x, 2) for x in b.column(4).slice(start, end - start).to_pylist())
                else:
                    levels = Levels(np.frombuffer(zstandard.decompress(b.column(4)[start].as_py()), np.int32), held)
                    for level in range(1, depth):
                        levels.step(level)
                    yield from use(int(block), levels)
                    held = {}

    return both.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(run, schema)


def splitters(blocks: DataFrame, levels: list[DataFrame], count: int, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``ranges`` - 1 keys that part the phrases of some blocks evenly."""
    share = max(1, count // SAMPLED)
    chosen = lambda df: df.where(F.pmod(F.xxhash64("block"), F.lit(share)) == 0)

    def draw(block: int, found: Levels) -> Iterator[pa.RecordBatch]:
        a, b, *_ = found.pairs()
        if len(a):
            at = np.arange(0, len(a), max(1, len(a) * min(count, 4 * SAMPLED) // DRAWN))
            yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at])], names=["a", "b"])

    drawn = by_block(chosen(blocks), [chosen(x) for x in levels], draw, "a long, b long").limit(4 * DRAWN).toArrow()
    a, b = (drawn.column(c).to_numpy() for c in "ab")
    order = radix_order(a, b)
    at = order[np.unique(np.arange(1, ranges) * len(order) // ranges)] if len(order) else order
    return a[at], b[at]


def phrases(blocks: DataFrame, levels: list[DataFrame], count: int, least: int, ranges: int = RANGES, dealt: int = DEALT) -> DataFrame:
    """The frequent phrases one word longer than the last of ``levels``: rows (id, a, b, f) and, for each block, answers (block, data)."""
    high, low = splitters(blocks, levels, count, ranges)
    deal = -(-count // dealt)

    def send(block: int, found: Levels) -> Iterator[pa.RecordBatch]:
        a, b, n, *_ = found.pairs()
        first, last = np.searchsorted(a, high, "left"), np.searchsorted(a, high, "right")
        cuts = [0, *(f + int(np.searchsorted(b[f:e], x)) for f, e, x in zip(first.tolist(), last.tolist(), low.tolist(), strict=True)), len(a)]
        names, data, size = [], [], 0
        for r, (f, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
            share = (a[f:e] * 31 + b[f:e]) % deal if deal > 1 else None
            for d in range(deal) if e > f else ():
                at = np.arange(f, e) if share is None else f + np.flatnonzero(share == d)
                if len(at):
                    names.append(r * deal + d)
                    data.append(pack(a[at], b[at], n[at], at + 1))
                    size += len(data[-1])
            if size >= BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([block] * len(names), pa.int64()), pa.array(data, pa.binary())], names=["range", "block", "data"])
                names, data, size = [], [], 0
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([block] * len(names), pa.int64()), pa.array(data, pa.binary())], names=["range", "block", "data"])

    def count_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        name = None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for r, block, data in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    if r != name and held:
                        yield from close(name, held)
                        held = []
                    name = r
                    held.append((block, data))
        if held:
            yield from close(name, held)

    def close(name: int, held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(data, 4) for _, data in held]
        a, b, n, local = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = radix_order(a, b)
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
        starts = np.flatnonzero(new)
        total = np.add.reduceat(n[order], starts)
        good = total >= least
        ids = np.where(good, (name << 32) + np.cumsum(good), 0)
        every = np.empty(len(order), np.int64)
        every[order] = np.repeat(ids, np.diff([*starts, len(order)]))
        heads = order[starts[good]]
        if not len(heads):
            return
        zero = pa.nulls(len(heads), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[good], a[heads], b[heads], total[good])] + [zero, pa.nulls(len(heads), pa.binary())], names=["id", "a", "b", "f", "block", "data"])
        blocks_, data, at, size = [], [], 0, 0
        for (block, _), part in zip(held, parts, strict=True):
            mine_ = every[at : at + len(part[0])]
            keep = np.flatnonzero(mine_)
            if len(keep):
                blocks_.append(block)
                data.append(pack(part[3][keep], mine_[keep]))
                size += len(data[-1])
            at += len(part[0])
            if size >= BYTES or (at == len(every) and blocks_):
                zero = pa.nulls(len(blocks_), pa.int64())
                yield pa.RecordBatch.from_arrays([zero, zero, zero, zero, pa.array(blocks_, pa.int64()), pa.array(data, pa.binary())], names=["id", "a", "b", "f", "block", "data"])
                blocks_, data, size = [], [], 0

    sent = by_block(blocks, levels, send, "range long, block long, data binary")
    return sent.repartition("range").sortWithinPartitions("range").mapInArrow(count_, "id long, a long, b long, f long, block long, data binary")


def mine(docs: DataFrame, *, least: int = 30, longest: int = 4, inside: int = 80, top: int = 2000, block_words: int = BLOCK, slice_bytes: int = SLICE, ranges: int = RANGES, dealt: int = DEALT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases by score.

    a is how often the phrase occurs (``least`` at least), l and r how often the two parts of its lowest-scoring cut do, score
    floor(2000000 * a / (l + r)), n the language's words. A phrase goes if a longer candidate that holds it occurs at least ``inside``
    hundredths as often.
    """
    blocks = written(docs.select("text", "lang").mapInArrow(partial(encode, block_words=block_words, slice_bytes=slice_bytes), COUNTS), "blocks")
    words = blocks.where("kind = 0")
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    count = blocks.where("kind = 1").count()
    found = written(frequent(words, ["lang", "word"], least), "words")
    levels, heads = [found.select("block", "local", "id")], [found.where("head")]
    for k in range(2, longest + 1):
        found = written(phrases(blocks, levels, count, least, ranges, dealt), f"phrases{k}")
        levels.append(found.where("block is not null").select("block", "data"))
        heads.append(found.where("block is null").select("id", "a", "b", "f"))
    # front and back: how often the first and the last 1, 2, ... words occur, the phrase itself included
    one = heads[0].select("id", "lang", F.col("word").cast("string").alias("phrase"), F.col("word").cast("string").alias("tail"), "f", F.array("f").alias("front"), F.array("f").alias("back"))
    out = None
    for k, found in enumerate(heads[1:], 2):
        of = lambda end: one.select(F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in ("lang", "phrase", "tail", "front", "back")])  # noqa: B023, E731
        rows = found.join(of("a"), "a").join(of("b"), "b").select(
            "id", "a", "b", F.col("a_lang").alias("lang"), F.concat_ws(" ", "a_phrase", "b_tail").alias("phrase"), F.col("b_tail").alias("tail"), "f",
            F.concat("a_front", F.array("f")).alias("front"), F.concat("b_back", F.array("f")).alias("back"),
        )
        one = rows.drop("a", "b")
        if k < longest:
            longer = heads[k].select(F.explode(F.array("a", "b")).alias("id"), F.col("f").alias("longer")).groupBy("id").agg(F.max("longer").alias("longer"))
            wide = lambda n, c: F.lit(n) * F.col(c).cast("decimal(20,0)")
            # a phrase within one two words longer lies within one that is one word longer and at least as frequent
            rows = rows.join(longer, "id", "left").where(F.col("longer").isNull() | (wide(100, "longer") < wide(inside, "f"))).drop("longer")
        cut = lambda m: F.struct(score(F.col("f"), F.col("front")[m - 1], F.col("back")[k - m - 1]).alias("score"), F.lit(m).alias("k"), F.col("front")[m - 1].alias("l"), F.col("back")[k - m - 1].alias("r"))  # noqa: B023, E731
        rows = rows.select("lang", "phrase", F.col("f").alias("a"), F.array_min(F.array(*[cut(m) for m in range(1, k)])).alias("cut"))
        out = rows if out is None else out.unionByName(rows)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = out.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def score(a, l, r):  # noqa: E741
    """floor(2000000 * a / (l + r)) of longs, exactly."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", F.lit(2_000_000) * wide(a), wide(l) + wide(r))
