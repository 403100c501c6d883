"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is read as its tokens: lower-cased words, each closed by a space, and the end, a line
feed. A byte becomes bits by a Huffman code of the training bytes that follow the byte before
it. Five contexts predict every bit of every token, each hashed with the node of the code into
slots of zeros and ones: the last four bytes, the word so far, the last short word (it tells
language and topic) with the last three bytes, the word before with the word so far, and the
two words before with it. The first two are counted over all training words, as often as they
occur, the others over all training tokens. The log odds of a slot, drawn towards zero the more
the less it holds, are mixed by weights of several sets; a gate, how often the word so far was
seen and whether the word before is known to lead here, chooses among them for each byte. Two
tables of the text itself, of words so far and of the last two bytes, are added. Weights and
tables start alike for each text and follow the gradient of all bits after every block of tokens
(``BLOCK``, four times as many after the first thousand), so a
prediction rests on what came before it only, and the mix refines itself through the whole
text. A new word has no mark or code of its own: it is spelled by the same bits, so
the score is a probability over all strings. It is the sum of log10 over the tokens.

Slot tables grow with the number of distinct training words (``table_bits``) up to
``MOST_BITS``, which bounds the model that is sent to all tasks; beyond, contexts share slots,
and an estimate is trusted by what its slot holds more than others bring into it in the mean.
How words are counted for the base score (``HOT_WORDS`` by a list, the rest by a join) doesn't
touch the score.

Null texts are empty: one token, the end. Rows that repeat are scored alike; a row with a
null id is learnt from. Words are counted as they are; a step of the scoring and the list of frequent
words tell them apart by a 64-bit hash. Texts of any length are read whole.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm import text as tx
from quillstone.runtime import cut

#: Contexts that depend on the word alone: its last four bytes, all so far; and all contexts,
#: with those of the words before: the last short one, the last, the last two.
SPELLING, CONTEXTS = 2, 5
#: Bytes of a short word with its end.
SHORT = 4
#: Least slots of a context's table, and what a table has beyond the power of two that holds
#: all distinct words; all as powers of two, and the most of any.
LEAST_BITS, MORE = (18, 18, 18, 18, 18), (1, 3, 3, 3, 3)
MOST_BITS = 22
#: Blocks that counts are summed in.
BLOCKS = 64
#: Tokens of a text between two steps along the gradient, and texts that are read side by side.
BLOCK, LANES = 16, 256
#: Slots of a text's own tables, as a power of two.
OWN_BITS = 11
#: Where a bit's slots in both own tables and its cells in both spelling contexts lie in one number,
#: above its node and value.
OWN_AT, CELL_AT = (6, 6 + OWN_BITS), (32, 48)
#: Bytes taken at a time: bounds a task's memory.
STEP_BYTES, COUNT_BYTES = 2 << 20, 4 << 20
#: What is worked on at a time, so that it fits the processor's cache: bytes to hash, distinct words to spell,
#: tokens whose contexts are hashed, bytes whose contexts are counted.
HASH_BYTES, WORDS, TOKENS, EVENTS = 1 << 17, 1 << 13, 1 << 13, 1 << 15
SPACES = np.frombuffer(tx.SPACES, np.uint8)
#: Words whose counts for the base score are sent to all tasks; others are joined.
HOT_WORDS = 1 << 17
#: Eighths of a binary log of 1 + times seen that part gates: never, about once, a few, often.
KNOWN = np.array([1, 12, 28])
GATES = 2 * (len(KNOWN) + 1)
#: Where mixing starts: weights by context; rates of learning of weights and of both own tables.
START = np.array([0.4, 0.4, 0.4, 0.3, 0.3], dtype=np.float32)
RATE, OWN_RATES = np.float32(0.004), (np.float32(0.1), np.float32(0.1))
#: Counts' worth of no opinion in each slot, and of each other context that shares it in the mean.
DOUBT, SHARED = (1.0, 1.0, 1.5, 1.0, 0.5), 1.5
#: Slots that lie together for a context's nodes; rarer nodes share them.
NODES = 32
_C = np.uint32(0x9E3779B1)
_E = np.uint32(0x2C1B3C6D)


def table_bits(distinct: int) -> tuple[int, ...]:
    """Sizes of the tables for so many distinct words, as powers of two."""
    n = int(distinct).bit_length()
    return tuple(min(MOST_BITS, max(least, n + more)) for least, more in zip(LEAST_BITS, MORE))


def is_training(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 7 != 2, F.lit(True))


@dataclass
class Code:
    """Huffman codes of byte values, one for each byte before: nodes and bits along the paths."""

    length: np.ndarray  # by 256 * byte before + byte
    first: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    step: np.ndarray  # both: the node, and ``NODES`` for a one


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, and nodes and bits of all paths one after the other; every value has a code, as
    if seen once more; ties go to the smaller value."""
    many = len(counts)
    heap = [(int(c) + 1, v) for v, c in enumerate(counts)]
    heapq.heapify(heap)
    above, side = [0] * (2 * many), [0] * (2 * many)
    n = many
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        above[a[1]] = above[b[1]] = n
        side[b[1]] = 1
        heapq.heappush(heap, (a[0] + b[0], n))
        n += 1
    length, node, bit = [], [], []
    for v in range(many):
        path, at = [], v
        while at != n - 1:
            path.append((above[at] - many, side[at]))
            at = above[at]
        length.append(len(path))
        node.extend(x for x, _ in reversed(path))
        bit.extend(x for _, x in reversed(path))
    return np.array(length), np.array(node, np.uint32), np.array(bit, np.uint8)


def code_of(pairs: np.ndarray) -> Code:
    """The code of how often each byte follows each, 256 by 256."""
    got = [huffman(row) for row in pairs]
    length = np.concatenate([x[0] for x in got])
    # the root is 0, and nodes that are passed more often come before others
    node = np.concatenate([(len(pairs) - 2 - x[1]) & (NODES - 1) for x in got]).astype(np.uint8)
    bit = np.concatenate([x[2] for x in got])
    return Code(length, np.cumsum(length) - length, node, bit, node | bit * np.uint8(NODES))


@dataclass
class Units:
    """Distinct words (with what closes them) of some texts, and where the texts use them."""

    size: np.ndarray  # bytes of each with its end; the end of a text is a word without bytes
    data: np.ndarray  # their bytes, one after the other
    word: np.ndarray  # hash of each without its end
    of: np.ndarray  # distinct word at every token place
    tokens: np.ndarray  # of each text

    def names(self) -> pa.Array:
        """Each distinct word without its end."""
        end = np.cumsum(self.size)
        at = np.concatenate(([0], end - np.arange(1, len(end) + 1))).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(end), [None, pa.py_buffer(at), pa.py_buffer(np.delete(self.data, end - 1))])


def word_hashes(words: list[bytes]) -> np.ndarray:
    size = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    sums, first = tx.prefix_hash(data), np.cumsum(size) - size
    return tx.mix((sums[first + size] - sums[first]) * tx.POWERS.get(len(data) + 1)[1][first])


def units(texts: list[bytes]) -> Units:
    """Words by their hashes, numbered as they come."""
    got, done = [], 0
    for part in tx.pieces(texts, len, HASH_BYTES):
        buf, start = tx.joined([t.lower() for t in part])
        a, b = tx.words(buf)
        last = np.searchsorted(a, start)  # words before each text
        # a text's end is an empty word in the place of the line feed that closes it
        h = np.insert(tx.word_hashes(buf, a, b), last[1:], tx.mix(np.zeros(1, np.uint64))[0])
        got.append((h, np.insert(a, last[1:], start[1:] - 1) + done, np.insert(b - a, last[1:], 0) + 1, np.diff(last) + 1, buf))
        done += len(buf)
    h, at, size, tokens, buf = map(np.concatenate, zip(*got))
    seen = pa.array(h).dictionary_encode()
    of = seen.indices.to_numpy()
    top = np.maximum.accumulate(of)
    new = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1])))  # where a word comes first
    size = size[new]
    data, end = buf[_bits_of(at[new], size)], np.cumsum(size) - 1
    data[end] = np.where(size > 1, ord(" "), ord("\n"))
    return Units(size, data, seen.dictionary.to_numpy(), of, tokens)


@dataclass
class Spelled:
    """Bytes of distinct words, one after the other, and all bits of those."""

    length: np.ndarray  # bits of each byte
    byte: np.ndarray  # the byte of each bit
    two: np.ndarray  # hash of the two bytes before each
    three: np.ndarray
    four: np.ndarray
    word: np.ndarray  # hash of the word so far
    step: np.ndarray  # see ``Code``


def back(data: np.ndarray, pos: np.ndarray, k: int) -> np.ndarray:
    """The byte ``k`` places before each in the same word, or 0."""
    out = np.zeros(len(data), dtype=np.uint32)
    out[k:] = data[:-k]
    out[pos < k] = 0
    return out


def places(h: np.ndarray, bits: int) -> np.ndarray:
    """A slot of a context; its low bits are changed by the node's number, so that all bits of a
    byte are found in one line of memory."""
    h = h ^ (h >> np.uint32(15))
    h *= _E
    h >>= np.uint32(32 - bits)
    return h.view(np.int32)


def _bits_of(begin: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Places of all bits of tokens whose words begin at ``begin`` and have ``c`` bits."""
    return np.arange(int(c.sum())) + np.repeat(begin - (np.cumsum(c) - c), c)


def bytes_of(size: np.ndarray, first: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some tokens: places among those of the distinct words, and numbers of the tokens."""
    c = size.take(of)
    token = np.repeat(np.arange(len(of), dtype=np.int32), c)
    j = (first.take(of) - (np.cumsum(c) - c)).take(token)
    j += np.arange(len(token))
    return j, token


def hashed(size: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of all bytes of words that lie one after the other: the byte and the one before it in one number,
    and hashes of the two, three and four bytes before and of the word so far."""
    start = np.repeat(np.cumsum(size) - size, size)
    pos = np.arange(len(data)) - start
    one, two = back(data, pos, 1), back(data, pos, 2)
    sums = tx.prefix_hash(data)
    so_far = (tx.mix((sums[:-1] - sums[start]) * tx.POWERS.get(len(data) + 1)[1][start]) >> np.uint64(32)).astype(np.uint32)
    value = one << np.uint32(8) | data
    two = one | two << np.uint32(8)
    three = two | back(data, pos, 3) << np.uint32(16)
    four = three | back(data, pos, 4) << np.uint32(24)
    return value, two * _C, (three ^ np.uint32(0x5BD1E995)) * _C, four * _C, so_far


def bits_of(value: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits of each byte, the byte of each bit and its place in the code."""
    length = code.length.take(value)
    byte = np.repeat(np.arange(len(value), dtype=np.int32), length)
    step = (code.first.take(value) - (np.cumsum(length) - length)).take(byte)
    step += np.arange(len(byte))
    return length, byte, step


def spelled(size: np.ndarray, data: np.ndarray, code: Code) -> Spelled:
    """Bytes of words that lie one after the other in ``data``."""
    value, two, three, four, so_far = hashed(size, data)
    length, byte, step = bits_of(value, code)
    return Spelled(length, byte, two, three, four, so_far, code.step.take(step))


def in_parts(u: Units) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sizes and bytes of ``WORDS`` distinct words after the other, which keeps the work in the processor's cache."""
    end = np.cumsum(u.size)
    for a in range(0, len(u.size), WORDS):
        size = u.size[a : a + WORDS]
        yield size, u.data[end[a] - size[0] : end[a + len(size) - 1]]


def _texts(batches: Iterator[pa.RecordBatch], k: int = 0) -> Iterator[tuple]:
    for b in batches:
        for i in range(b.num_rows):
            yield (*(b.column(j)[i].as_py() for j in range(k)), b.column(k)[i].as_py() or b"")


def _steps(batches, k: int = 0, limit: int = 0):
    return tx.pieces(_texts(batches, k), lambda x: len(x[-1]) + 200, limit or STEP_BYTES)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Times of each word; the end is the empty one."""
    for part in _steps(batches, 0, COUNT_BYTES):
        buf, _ = tx.joined([t.lower() for (t,) in part])
        a, b = tx.words(buf)
        at = np.concatenate(([0], np.cumsum(b - a))).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(at), pa.py_buffer(buf[~np.isin(buf, SPACES)])])
        n = words.value_counts()
        yield pa.RecordBatch.from_arrays([n.field("values"), n.field("counts")], ["word", "c"])
        yield pa.RecordBatch.from_arrays([pa.array([b""], pa.binary()), pa.array([len(part)], pa.int64())], ["word", "c"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Times, sizes and bytes of words with what closes them, at most about ``STEP_BYTES`` at a time."""
    for b in batches:
        times, words = b.column(0).to_numpy(), b.column(1).cast(pa.binary())
        _, at, data = words.buffers()
        at = np.frombuffer(at, np.int32, len(words) + 1, 4 * words.offset)
        data = np.frombuffer(data or b"", np.uint8)
        cuts = np.unique((at[:-1] - at[0]) // STEP_BYTES, return_index=True)[1].tolist()
        for lo, hi in zip(cuts, [*cuts[1:], len(words)]):
            size = np.diff(at[lo : hi + 1]).astype(np.int64)
            end = np.where(size > 0, ord(" "), ord("\n")).astype(np.uint8)
            yield times[lo:hi], size + 1, np.insert(data[at[lo] : at[hi]], at[lo + 1 : hi + 1] - at[lo], end)


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each byte follows each in words, by 256 * byte before + byte."""
    total = np.zeros(1 << 16, dtype=np.int64)
    for n, size, data in _words(batches):
        pos = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
        value = back(data, pos, 1) << np.uint32(8) | data
        np.add.at(total, value.astype(np.intp), np.repeat(n, size))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "c"])


def _blocks(flat: np.ndarray) -> pa.RecordBatch:
    data = [zstandard.compress(x.tobytes(), 1) for x in flat.reshape(BLOCKS, -1)]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(BLOCKS)), pa.array(data, pa.binary())], ["block", "data"])


def low_of(step: np.ndarray) -> np.ndarray:
    """A slot's part that no context changes, and which of its counts."""
    return (step & np.uint8(NODES - 1)) << np.uint8(1) | step // np.uint8(NODES)


def _count_spelling(code: Code, sizes: tuple[int, ...]):
    """Zeros and ones of the spelling contexts over a task's distinct words, as compressed blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, any_ = np.zeros(sum(2 << b for b in sizes), dtype=np.uint32), False
        for n, size, data in _words(batches):
            any_, at = True, 0
            d = spelled(size, data, code)
            times, low = np.repeat(n.astype(np.uint32), size).take(d.byte), low_of(d.step)
            for h, bits in zip((d.four, d.word), sizes):
                slot = (places(h, bits) << 1).take(d.byte)
                slot ^= low
                np.add.at(flat[at : at + (2 << bits)], slot, times)
                at += 2 << bits
        if any_:
            yield _blocks(flat)

    return run


def before(u: Units) -> list[np.ndarray]:
    """Hashes of the last short word, of the word before and of the two words before each token,
    all of the same text."""
    n, none = len(u.of), tx.mix(np.arange(3, dtype=np.uint64))
    began, at = np.repeat(np.cumsum(u.tokens) - u.tokens, u.tokens), np.arange(n)

    def top(x: np.ndarray) -> np.ndarray:
        return (tx.mix(x + np.uint64(3)) >> np.uint64(32)).astype(np.uint32)

    # of distinct words, and of none in their place, by numbers that stand for it behind them
    words = np.concatenate((u.word, none[:2]))
    short = np.maximum.accumulate(np.where((u.size <= SHORT)[u.of], at, -1))
    last = np.concatenate(([-1], short[:-1]))
    topic = np.where(last >= began, u.of[np.maximum(last, 0)], len(u.word))
    one = np.where(at > began, np.concatenate((u.of[:1], u.of[:-1])), len(u.word) + 1)
    two = np.where(at - 2 >= began, u.word.take(u.of[np.maximum(at - 2, 0)]), none[2])
    both = tx.mix(words.take(one) * np.uint64(0x9E3779B97F4A7C15) + two + np.uint64(7))
    tops = top(words)
    return [tops.take(topic), tops.take(one), top(both)]


def _count_contexts(code: Code, sizes: tuple[int, ...]):
    """Zeros and ones of the contexts of words before, over all tokens of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, any_, low = np.zeros(sum(2 << b for b in sizes), dtype=np.uint32), False, low_of(code.step)
        for part in _steps(batches, 0, STEP_BYTES // 2):
            any_, at = True, 0
            u = units([t for (t,) in part])
            value, three, word = map(np.concatenate, zip(*((h[0], h[2], h[4]) for h in (hashed(*x) for x in in_parts(u)))))
            contexts, first = before(u), np.cumsum(u.size) - u.size
            # a byte in a context: the slot, and the byte with the one before it, which tell its bits
            seen, o = np.empty((len(sizes), int(u.size[u.of].sum())), np.uint64), 0
            for a in range(0, len(u.of), TOKENS):
                j, token = bytes_of(u.size, first, u.of[a : a + TOKENS])
                mine = value.take(j)
                for k, (bits, key) in enumerate(zip(sizes, (three, word, word))):
                    h = contexts[k][a : a + TOKENS].take(token)
                    h ^= key.take(j)
                    x = places(h, bits).astype(np.uint64)
                    x <<= np.uint64(16)
                    x |= mine
                    seen[k, o : o + len(j)] = x
                o += len(j)
            for bits, x in zip(sizes, seen):
                x.sort()  # those that are alike count at once, and slots come in order
                for a in range(0, o, EVENTS):
                    _add_bytes(flat[at : at + (2 << bits)], x[a : a + EVENTS], code, low)
                at += 2 << bits
        if any_:
            yield _blocks(flat)

    return run


def _add_bytes(table: np.ndarray, x: np.ndarray, code: Code, low: np.ndarray) -> None:
    """Adds the bits of bytes in a context, which are sorted (see ``_count_contexts``)."""
    new = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    times = np.diff(new, append=len(x)).astype(np.uint32)
    x = x.take(new)
    _, byte, step = bits_of((x & np.uint64(0xFFFF)).astype(np.intp), code)
    slot = ((x >> np.uint64(16)).astype(np.intp) << 1).take(byte)
    slot ^= low.take(step)
    np.add.at(table, slot, times.take(byte))


def _small(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of (zeros, ones) in twelfths, and eighths of the binary log of 1 + their sum: a byte each."""
    n = n.astype(np.float64)
    odds = (np.log(n[:, 1] + 0.02) - np.log(n[:, 0] + 0.02)) * 12
    return np.clip(odds, -127, 127).round().astype(np.int8), np.minimum(8 * np.log2(1 + n.sum(axis=1)), 255).round().astype(np.uint8)


def _add_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of blocks over all tasks."""
    held, total = None, None

    def done():
        odds, seen = _small(total.reshape(-1, 2))
        return pa.RecordBatch.from_arrays([pa.array([held]), pa.array([zstandard.compress(odds.tobytes() + seen.tobytes(), 1)], pa.binary())], ["block", "data"])

    for b in batches:
        for block, data in zip(b.column(0).to_pylist(), b.column(1)):
            x = np.frombuffer(zstandard.decompress(data.as_py()), dtype=np.uint32).astype(np.uint64)
            if block != held:
                if held is not None:
                    yield done()
                held, total = block, np.zeros_like(x)
            total = total + x
    if held is not None:
        yield done()


def _summed(blocks: DataFrame, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Every table: a slot's two bytes (see ``_small``) in one number, from blocks of all tasks."""
    n, slots = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(1 << b for b in sizes)
    blocks = blocks.repartition(min(n, BLOCKS), "block").sortWithinPartitions("block").mapInArrow(_add_slots, "block long, data binary")
    cells = np.zeros((BLOCKS, slots // BLOCKS), np.uint16)
    for r in blocks.toLocalIterator():  # a partition's blocks at a time
        raw = np.frombuffer(zstandard.decompress(bytes(r["data"])), np.uint8)
        odds, seen = raw[: len(raw) // 2], raw[len(raw) // 2 :].astype(np.uint16)
        cells[r["block"]] = odds | seen << np.uint16(8)
    return np.split(cells.ravel(), np.cumsum([1 << b for b in sizes])[:-1])


_TIMES = (np.exp2(np.arange(256) / 8) - 1).astype(np.float32)


@dataclass
class Model:
    code: Code
    cells: list[np.ndarray]  # by context: slots, see ``_summed``
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # hashes of words counted here, sorted
    hot_log: np.ndarray = field(default_factory=lambda: np.zeros(0))  # log10(count + 1)
    train_tokens: int = 0
    distinct: int = 0

    @property
    def sizes(self) -> tuple[int, ...]:
        return tuple(len(x).bit_length() - 1 for x in self.cells)


def blocks(n: int) -> Iterator[tuple[int, int]]:
    """Where the blocks of so many tokens begin, and their sizes."""
    at = 0
    while at < n:
        size = BLOCK if at < BLOCK * 64 else 4 * BLOCK
        yield at, size
        at += size


class Reader:
    """A model with the log odds of all cells worked out, once a process."""

    def __init__(self, model: Model) -> None:
        self.model, self.sizes, self.odds = model, model.sizes, []
        odds = np.arange(256, dtype=np.uint8).view(np.int8).astype(np.float32) / 12
        for cells, doubt in zip(model.cells, DOUBT):
            free = max(np.count_nonzero(cells < 256) / len(cells), 1e-3)
            others = -np.log(free)  # contexts and nodes that share a slot in the mean
            trust = (_TIMES / (_TIMES + np.float32(doubt + SHARED * others))).astype(np.float32)
            self.odds.append((trust[:, None] * odds).ravel())

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """log2 probability of each text."""
        u = units(texts)
        return np.add.reduceat(self.read(u), np.cumsum(u.tokens) - u.tokens)

    def words(self, d: Spelled) -> tuple[np.ndarray, ...]:
        """What depends on the word alone: of its bytes bits, hashes and gates, of each bit its node and value,
        own slots and cells in one number."""
        node, rows, begin = d.step & np.uint8(NODES - 1), d.step.astype(np.uint64), np.cumsum(d.length) - d.length
        for shift, h in zip(OWN_AT, (d.word, d.two)):
            rows |= (places(h * _C, OWN_BITS).take(d.byte) ^ node).astype(np.uint64) << np.uint64(shift)
        for k, h in enumerate((d.four, d.word)):
            cell = self.model.cells[k].take(places(h, self.sizes[k]).take(d.byte) ^ node)
            rows |= cell.astype(np.uint64) << np.uint64(CELL_AT[k])
        return d.length, d.three, d.word, rows, np.searchsorted(KNOWN, cell.take(begin) >> np.uint16(8), side="right")

    def read(self, u: Units) -> np.ndarray:
        """log2 probability of each token; texts of most tokens come first, ``LANES`` side by side."""
        lengths, three, word, rows, gate = map(np.concatenate, zip(*(self.words(spelled(*x, self.model.code)) for x in in_parts(u))))
        begin, first_byte, contexts = np.cumsum(lengths) - lengths, np.cumsum(u.size) - u.size, before(u)
        first, out = np.cumsum(u.tokens) - u.tokens, np.zeros(len(u.of))
        order = np.argsort(-u.tokens, kind="stable")
        for s in range(0, len(order), LANES):
            lanes = order[s : s + LANES]
            size, start = u.tokens[lanes], first[lanes]
            w = np.repeat(START[:, None], len(lanes) * GATES, axis=1)
            tables = [np.zeros(len(lanes) << OWN_BITS, np.float32) for _ in OWN_RATES]
            for b, block in blocks(int(size[0])):
                live = int(np.searchsorted(-size, -b, side="left"))
                n_tokens = np.minimum(size[:live] - b, block)
                token = _bits_of(start[:live] + b, n_tokens)
                # bytes of longest codes first: the k-th bits of the first n of them lie from o on, so a byte's
                # value meets its bits, and their sum the byte, slice by slice
                j, t = bytes_of(u.size, first_byte, u.of[token])
                length = lengths.take(j)
                by = np.argsort(255 - length.astype(np.uint8), kind="stable")
                j, t, n = j.take(by), t.take(by), len(j) - np.cumsum(np.bincount(length))[:-1]
                slices = [*zip(range(len(n)), n.tolist(), (np.cumsum(n) - n).tolist())]
                lane = np.repeat(np.arange(live, dtype=np.int32), n_tokens).take(t)
                many, bits = len(j), int(n.sum())
                # of every byte: its slots in the contexts of words before, its lane's own tables
                byte = np.empty((CONTEXTS - SPELLING + 1, many), np.int32)
                for k, key in enumerate((three, word, word)):
                    byte[k] = places(contexts[k].take(token).take(t) ^ key.take(j), self.sizes[SPELLING + k])
                byte[-1] = lane << OWN_BITS
                at, slot, lead = np.empty(bits, np.intp), np.empty((len(byte), bits), np.int32), begin.take(j)
                for i, n, o in slices:
                    np.add(lead[:n], i, out=at[o : o + n])
                    slot[:, o : o + n] = byte[:, :n]
                row = rows.take(at, mode="clip")
                low = row.astype(np.uint32).view(np.int32)
                slot[:-1] ^= low & NODES - 1
                x = np.empty((CONTEXTS, bits), np.float32)
                for k in range(SPELLING):
                    self.odds[k].take((row >> np.uint64(CELL_AT[k])).astype(np.uint16), out=x[k], mode="clip")
                for k in range(SPELLING, CONTEXTS):
                    cell = self.model.cells[k].take(slot[k - SPELLING], mode="clip")
                    self.odds[k].take(cell, out=x[k], mode="clip")
                    if k == SPELLING + 1:
                        known = cell[:many] > 255
                g = gate.take(j) + lane * GATES + known * (GATES // 2)
                slots = [(low >> shift & (1 << OWN_BITS) - 1 | slot[-1]).astype(np.intp) for shift in OWN_AT]
                z, v = tables[0].take(slots[0], mode="clip"), w.take(g, axis=1, mode="clip")
                z += tables[1].take(slots[1], mode="clip")
                for _, n, o in slices:
                    z[o : o + n] += np.einsum("kb,kb->b", v[:, :n], x[:, o : o + n])
                np.clip(z, -12, 12, out=z)
                err = (low >> 5 & 1).astype(np.float32) - 1 / (1 + np.exp(-z))
                log, step = np.log2(1 - np.abs(err)), np.zeros((CONTEXTS, many), np.float32)
                for _, n, o in slices:
                    step[:, :n] += err[o : o + n] * x[:, o : o + n]
                    if o:
                        log[:n] += log[o : o + n]
                out[token] = np.bincount(t, log[:many], len(token))
                # one step along the gradient of the block's bits
                for table, own, rate in zip(tables, slots, OWN_RATES):
                    np.add.at(table, own, rate * err)
                for k in range(CONTEXTS):
                    w[k, : live * GATES] += RATE * np.bincount(g, step[k], live * GATES).astype(np.float32)
        return out


def find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each hash among sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(h), dtype=np.int64), np.zeros(len(h), dtype=bool)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return at, keys[at] == h


_READERS: dict[tuple, Reader] = {}


def reader(model: Model) -> Reader:
    key = (model.train_tokens, model.distinct, len(model.hot), *(int(c.sum(dtype=np.int64)) for c in model.cells))
    if key not in _READERS:
        _READERS.clear()
        _READERS[key] = Reader(model)
    return _READERS[key]


def _hot(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of at most ``HOT_WORDS`` words: those above the least count that so many
    reach, from how many words have each count; no task sends more rows than that."""
    short = words.filter(F.length("word") <= 64)  # words of great length are left to the join
    level = F.least("c", F.lit(1 << 16))
    least, total = (1 << 16) + 1, 0
    for k, many in sorted(((r["k"], r["count"]) for r in short.groupBy(level.alias("k")).count().collect()), reverse=True):
        if (total := total + many) > HOT_WORDS:
            break
        least = k
    top = short.filter(F.col("c") >= least).toPandas()
    h = word_hashes([bytes(w) for w in top["word"]])
    by = np.argsort(h)
    return h[by], top["c"].to_numpy(np.int64)[by]


def fit(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and ``(word, c)`` counts of all words, from all texts of ``docs(text)``."""
    src = docs.select(F.col("text").cast("binary").alias("text"))
    words = cut(src.mapInArrow(_count_words, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")))
    size = words.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    counted = words.select(F.col("c").alias("n"), "word")
    pairs = np.zeros(1 << 16, dtype=np.int64)
    for r in counted.mapInArrow(_count_pairs, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).collect():
        pairs[r["pair"]] = r["c"]
    code, sizes = code_of(pairs.reshape(256, 256)), table_bits(size.v)
    cells = _summed(counted.mapInArrow(_count_spelling(code, sizes[:SPELLING]), "block long, data binary"), sizes[:SPELLING])
    cells += _summed(src.mapInArrow(_count_contexts(code, sizes[SPELLING:]), "block long, data binary"), sizes[SPELLING:])
    hot, c = _hot(words)
    return Model(code, cells, hot, np.log10(c.astype(np.float64) + 1), size.n or 0, size.v), words


SCORED = "key long, doc_id long, held_out boolean, n_tokens long, hot_log double, hot_known long, score double, n_bytes long, words array<struct<word: binary, n: long>>"


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader(model).read
        for part in _steps(batches, 3):
            u = units([x[-1] for x in part])
            first = np.cumsum(u.tokens) - u.tokens
            bits = np.add.reduceat(read(u), first)
            place, hit = find(model.hot, u.word)
            log = np.zeros(len(hit))
            log[hit] = model.hot_log[place[hit]]
            text_of = np.repeat(np.arange(len(part)), u.tokens)
            hot_log = np.bincount(text_of, log[u.of], len(part))
            hot_n = np.bincount(text_of, hit[u.of], len(part)).astype(np.int64)
            n_bytes = np.add.reduceat(u.size[u.of], first)
            use = np.flatnonzero(~hit[u.of])  # for the join with their counts
            rare, n = np.unique(text_of[use] * len(hit) + u.of[use], return_counts=True)
            at = pa.array(np.searchsorted(rare, np.arange(len(part) + 1) * len(hit)).astype(np.int32))
            rare = pa.StructArray.from_arrays([u.names().take(pa.array(rare % len(hit))), pa.array(n)], ["word", "n"])
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in part], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.bool_()))]
                + [pa.array(u.tokens), pa.array(hot_log), pa.array(hot_n), pa.array(bits * np.log10(2)), pa.array(n_bytes.astype(np.int64))]
                + [pa.ListArray.from_arrays(at, rare)],
                ["key", "doc_id", "held_out", "n_tokens", "hot_log", "hot_known", "score", "n_bytes", "words"],
            )

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of all rows by a model of the training rows (see ``is_training``).

    ``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte)``.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), raw.alias("text"))
    model, words = fit(rows.filter(is_training(F.col("doc_id"))).select("text"))
    key = F.xxhash64("doc_id", "text", F.col("doc_id").isNull())
    data = F.col("text").cast("binary")
    scored = cut(rows.select(key.alias("key"), "doc_id", (~is_training(F.col("doc_id"))).alias("held_out"), data.alias("text")).mapInArrow(_score(model), SCORED))
    # rows that repeat share a key and send their words once, so that no word is hot
    cold = scored.groupBy("key").agg(F.first("words").alias("words")).select("key", F.inline("words"))
    extra = cold.join(words, "word").groupBy("key").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("log"), F.sum("n").alias("known"))
    base = F.col("hot_log") + F.coalesce("log", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(model.train_tokens + model.distinct + 1)))
    return scored.join(extra, "key", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("hot_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        F.col("score"),
        (-F.col("score") / F.lit(float(np.log10(2))) / F.col("n_bytes")).alias("bits_per_byte"),
    )
