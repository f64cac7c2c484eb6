"""Phrases of two and three words that stand together more often than their parts would, counted by double-array tries.

The texts are split once and stored as portions: the distinct words of about ``PORTION`` words, and a number for every
word of the text, the commonest words first. Further passes read them:

1. Words are counted, and every pair and triple adds to one of ``2**BUCKET_BITS`` or more hashed counters. A portion
   sends its counters in ranges, as Golomb-coded numbers; a range is summed in one place and becomes a bitmap of the
   counters that reach the least frequency.
2. A phrase can only be frequent where its counter and those of all pairs in it are (the Apriori rule; a counter never
   counts too little). What passes is a candidate. A task sends its distinct candidates and how often it has them in
   letters, one a bucket of the first two words' hashes: the words that stand in them once, the phrases as Golomb-coded
   numbers of these words, and the counts above 1.
3. A bucket's letters meet in one place, and counters of its own, which know how often each phrase was sent, thin the
   candidates once more. What is left is dealt into double-array tries of about ``BLOCK_PHRASES``; all phrases of a letter
   advance through a trie together, and their counts are added up at the accepting states.

The portions are read twice, however many candidates there are. What is broadcast has a bounded size: two bitmaps of at
most ``2**MOST_BITS`` bits. With more text they let more candidates pass, which costs letters and changes no count.
"""

from __future__ import annotations

import ctypes
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowtide.llm.double_array import DoubleArray
from flowtide.llm.fingerprints import golomb_decode, golomb_encode
from flowtide.llm.shingles import mix
from flowtide.llm.spark_help import Shelf, buckets_for, cut

#: There are ``2**BUCKET_BITS`` counters, with more text one for two words, up to ``2**MOST_BITS``.
BUCKET_BITS, MOST_BITS, RANGE_BITS = 26, 28, 20
#: A bucket's own counters are at most ``2**OWN_BITS``.
OWN_BITS = 23
BLOCK_PHRASES = 300_000
#: Words of a portion, about; bounds a task's memory.
PORTION = 700_000
#: Bytes of a text that are split at once; the cut lies at the end of a piece.
SLICE = 1_000_000
#: Word numbers of a portion have so many bits, so that three fit into one integer; a giant piece may need more.
_BITS = 21
#: ``least`` is at most this; the counters of a portion are sent up to ``least``.
_MOST = 65_535
#: A bucket gets the candidates of about so many words of text; bounds the memory of the task that counts them.
BUCKET_WORDS = 8_000_000
#: A task sends its candidates when it holds so many distinct ones, its counters after so many positions.
HELD, POSITIONS = 500_000, 2_000_000
#: Phrases of a letter at most.
LETTER = 100_000

#: Every end of a piece becomes a full stop, a tab a space.
_TABLE = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", b".........\x20")
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Numbers(dict):
    """word -> its number, in the order of first sight; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _slices(text: bytes):
    start = 0
    while len(text) - start > SLICE:
        end = text.rfind(b".", start, start + SLICE)
        end = end if end >= 0 else text.find(b".", start + SLICE)
        if end < 0:
            break
        yield text[start : end + 1]
        start = end + 1
    yield text[start:]


def _give_back() -> None:
    """Returns freed memory to the machine: a reused worker else keeps the largest arrays it ever had."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _portions(batches):
    """(lang, words, numbers): distinct words and the numbers of all words in text order, pieces parted by 0."""
    held, open_ = 0, {}

    def closed():
        for lang, (known, parts) in open_.items():
            yield lang, list(known), np.concatenate(parts)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = (text.as_py() or b"").lower().translate(_TABLE)
            for part in _slices(text):
                words = part.replace(b".", b" . ").split()
                if not words:
                    continue
                known, parts = open_.setdefault(lang, (_Numbers(), []))
                parts.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                parts.append(np.zeros(1, np.int32))
                held += len(words)
                if held >= PORTION:
                    yield from closed()
                    held, open_ = 0, {}
    yield from closed()


def _planes(values: np.ndarray) -> bytes:
    """All first bytes of the integers, then all second bytes, ...: the high ones are nearly all 0 and compress away."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _flat(planes: bytes, dtype) -> np.ndarray:
    """The integers that ``_planes`` was given."""
    wide = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(wide, -1).T).view(dtype).ravel()


def _sparse(places: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending, distinct places and their counts. Most counts are 1; the others follow with their index."""
    more = np.flatnonzero(times > 1)
    (shift, code), (more_shift, more_code) = golomb_encode(places.astype(np.uint64)), golomb_encode(more.astype(np.uint64))
    head = np.array([len(places), shift, len(code), len(more), more_shift, len(more_code)], np.int64)
    return head.tobytes() + code + more_code + _planes(times[more])


def _unpacked(letter: bytes, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The places and counts that ``_sparse`` was given."""
    n, shift, size, m, more_shift, more_size = np.frombuffer(letter, np.int64, 6).tolist()
    code, more, rest = letter[48 : 48 + size], letter[48 + size : 48 + size + more_size], letter[48 + size + more_size :]
    times = np.ones(n, dtype)
    times[golomb_decode(m, more_shift, more).astype(np.int64)] = _flat(rest, dtype)
    return golomb_decode(n, shift, code).astype(np.int64), times


def _hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(first * _STEP + second)


def _bits(words: int) -> int:
    """The counters of so many words of text are two to this power."""
    return max(BUCKET_BITS, min(MOST_BITS, (max(words, 1) // 2).bit_length()))


def _counters(hashes: np.ndarray, numbers: np.ndarray, bits: int):
    """Positions of pairs and triples, and the counter of each; ``hashes`` are those of the words."""
    hashes, real = hashes[numbers], numbers > 0
    two = real[:-1] & real[1:]
    three = two[:-1] & real[2:]
    shift = np.uint64(64 - bits)
    pair = _pair_hash(hashes[:-1], hashes[1:])
    triple = _pair_hash(pair[:-1], hashes[2:])
    return two, three, (pair >> shift).astype(np.uint32), (triple >> shift).astype(np.uint32)


_SEEN = "lang string, words array<binary>, counts array<bigint>, numbers binary"


def _seen(batches):
    """Portions with the counts of their words, the commonest word first."""
    for lang, words, numbers in _portions(batches):
        counts = np.bincount(numbers, minlength=len(words))
        # The end of a piece keeps number 0.
        order = np.append(0, 1 + np.argsort(-counts[1:], kind="stable"))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang], pa.string()), pa.array([[words[k] for k in order]], pa.list_(pa.binary())),
             pa.array([counts[order]], pa.list_(pa.int64())), pa.array([_planes(place[numbers])], pa.binary())],
            ["lang", "words", "counts", "numbers"])
        del words, numbers, counts, order, place
        _give_back()


def _stored(batches):
    """The portions that ``_seen`` wrote; the words as an Arrow array."""
    for batch in batches:
        for lang, words, numbers in zip(*(batch.column(k) for k in range(3))):
            yield lang.as_py(), words.values, _flat(numbers.as_py(), np.int32)


def _added(least: int, bits: int):
    """The counters of the portions' pairs and triples, by range, each up to ``least``."""

    def letters(held):
        rows = []
        for kind, parts in held.items():
            where, times = np.unique(np.concatenate(parts), return_counts=True)
            times = np.minimum(times, least).astype(np.uint16)
            edges = np.searchsorted(where, np.arange((1 << bits - RANGE_BITS) + 1) << RANGE_BITS)
            for k in np.flatnonzero(np.diff(edges)):
                own = slice(edges[k], edges[k + 1])
                rows.append((kind, int(k), _sparse(where[own] - np.uint32(int(k) << RANGE_BITS), times[own])))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["kind", "range", "letter"])

    def run(batches):
        held, size = {2: [], 3: []}, 0
        for lang, words, numbers in _stored(batches):
            if len(numbers) < 3:
                continue
            two, three, pair, triple = _counters(_hashes(lang, words.to_pylist()), numbers, bits)
            held[2].append(pair[two])
            held[3].append(triple[three])
            size += len(numbers)
            del two, three, pair, triple
            if size >= POSITIONS:
                yield letters(held)
                held, size = {2: [], 3: []}, 0
        if size:
            yield letters(held)
        del held
        _give_back()

    return run


def _heavy(least: int):
    """Counters sorted by range, summed: one bitmap a range."""

    def run(batches):
        at, total = None, None

        def closed():
            return pa.RecordBatch.from_arrays(
                [pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())],
                ["kind", "range", "bits"])

        for batch in batches:
            for kind, part, letter in zip(*batch.columns):
                if (kind.as_py(), part.as_py()) != at:
                    if at:
                        yield closed()
                    at, total = (kind.as_py(), part.as_py()), np.zeros(1 << RANGE_BITS, np.uint32)
                places, times = _unpacked(letter.as_py(), np.uint16)
                total[places] = np.minimum(total[places] + times, least)
        if at:
            yield closed()

    return run


def _distinct(size: int, columns: list[np.ndarray], times: np.ndarray | None = None) -> list[np.ndarray]:
    """The distinct rows, ascending, of two or three columns of numbers below ``size``, and the sums of their ``times``
    (by default each row counts once)."""
    if size > 1 << _BITS:
        found, which = np.unique(np.stack(columns), axis=1, return_inverse=True)
        total = np.zeros(found.shape[1], np.int64)
        np.add.at(total, which.ravel(), 1 if times is None else times)
        return [*found, total]
    key = columns[0].astype(np.int64)
    for c in columns[1:]:
        key = key << _BITS | c
    if times is None:
        key.sort()
    else:
        order = np.argsort(key)
        key, times = key[order], times[order]
    starts, low = np.flatnonzero(np.diff(key, prepend=-1) > 0), (1 << _BITS) - 1
    total = np.diff(starts, append=len(key)) if times is None else np.add.reduceat(times, starts) if len(starts) else times
    key = key[starts]
    return [*(key >> _BITS * (len(columns) - 1 - k) & low for k in range(len(columns))), total]


class _Phrases:
    """Distinct phrases of one language, as numbers of their words (0 is no word), and how often each was given."""

    def __init__(self):
        self.known, self.parts, self.held, self.kept = _Numbers(), [], 0, 0

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The numbers of ``words``, behind a 0 for no word."""
        return np.fromiter(map(self.known.__getitem__, [b".", *words]), np.int32, len(words) + 1)

    def add(self, columns: list[np.ndarray], times: np.ndarray) -> None:
        self.parts.append([*columns, times])
        self.held += len(times)
        if self.held > 2 * self.kept + HELD:
            self.distinct()

    def distinct(self) -> list[np.ndarray]:
        *columns, times = (np.concatenate(c) for c in zip(*self.parts)) if self.parts else (np.zeros(0, np.int32),) * 4
        *found, times = _distinct(len(self.known), columns, times)
        found = [*(c.astype(np.int32) for c in found), times]
        self.parts, self.held, self.kept = [found], len(times), len(times)
        return found

    def words(self) -> pa.Array:
        return pa.array(list(self.known), pa.binary())


_LETTER = "bucket int, lang string, words array<binary>, entries int, shift int, code binary, times binary"


def _written(words: pa.Array, first: np.ndarray, second: np.ndarray, third: np.ndarray) -> tuple:
    """A letter: the phrases' own words, and the phrases as numbers of these (from 1; 0 is none)."""
    used, own = np.unique(np.concatenate([first, second, third]), return_inverse=True)
    own = own.astype(np.uint64)
    if used[0] == 0:
        used = used[1:]
    else:
        own += np.uint64(1)
    bits = np.uint64(len(used).bit_length())
    a, b, c = np.split(own, 3)
    shift, code = golomb_encode(np.sort((a << bits | b) << bits | c))
    return words.take(pa.array(used)), len(first), shift, code


def _read(words: int, entries: int, shift: int, code: bytes) -> list[np.ndarray]:
    """The first, second and third words' numbers of a letter of so many words."""
    return _split(golomb_decode(entries, shift, code), words)


def _split(keys: np.ndarray, words: int) -> list[np.ndarray]:
    bits = np.uint64(words.bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    return [(keys >> bits * np.uint64(k) & low).astype(np.int64) for k in (2, 1, 0)]


def _candidates(bitmaps, buckets: int, bits: int):
    """Letters by bucket: the distinct phrases of a task's portions whose counters, and those of the pairs in them, are
    heavy, and the places and numbers of their further occurrences."""

    def heavy(kind: int, at: np.ndarray) -> np.ndarray:
        return (bitmaps.value[kind][at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)

    def letters(lang: str, phrases: _Phrases):
        *found, times = phrases.distinct()
        words = phrases.words()
        hashes = _hashes(lang, words.to_pylist())
        to = (_pair_hash(hashes[found[0]], hashes[found[1]]) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        ends = np.cumsum(np.bincount(to, minlength=buckets))
        for bucket, end in enumerate(ends):
            for start in range(ends[bucket - 1] if bucket else 0, end, LETTER):
                # The phrases ascend, so a letter keeps their order.
                part = order[start : min(start + LETTER, end)]
                own, entries, shift, code = _written(words, *(c[part] for c in found))
                more = np.flatnonzero(times[part] > 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket], pa.int32()), pa.array([lang], pa.string()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own),
                     pa.array([entries], pa.int32()), pa.array([shift], pa.int32()), pa.array([code], pa.binary()),
                     pa.array([_sparse(more, times[part][more] - 1)], pa.binary())],
                    ["bucket", "lang", "words", "entries", "shift", "code", "times"])

    def run(batches):
        open_ = {}
        for lang, text, numbers in _stored(batches):
            if len(numbers) < 3:
                continue
            two, three, pair, triple = _counters(_hashes(lang, text.to_pylist()), numbers, bits)
            two[two] = heavy(2, pair[two])
            three &= two[:-1] & two[1:]
            three[three] = heavy(3, triple[three])
            *doubles, often = _distinct(len(text), [numbers[:-1][two], numbers[1:][two]])
            *triples, more = _distinct(len(text), [numbers[:-2][three], numbers[1:-1][three], numbers[2:][three]])
            del two, three, pair, triple
            if len(often):
                found = [np.concatenate(c) for c in zip((*doubles, np.zeros(len(often), np.int64)), triples)]
                used = np.zeros(len(text), bool)
                for c in found:
                    used[c] = True
                used[0] = False
                phrases = open_.setdefault(lang, _Phrases())
                number = np.zeros(len(text), np.int32)
                number[used] = phrases.numbers(text.filter(pa.array(used)).to_pylist())[1:]
                phrases.add([number[c] for c in found], np.concatenate([often, more]))
                del found, used, number
            del doubles, triples
            if sum(p.held for p in open_.values()) >= 2 * HELD and sum(len(p.distinct()[0]) for p in open_.values()) >= HELD:
                for at, phrases in open_.items():
                    yield from letters(at, phrases)
                open_ = {}
                _give_back()
        for at, phrases in open_.items():
            yield from letters(at, phrases)
        del open_
        _give_back()

    return run


class _Bucket:
    """The letters of one bucket and language: the numbers of a letter's words, its sorted phrases and their times."""

    def __init__(self):
        self.phrases, self.letters = _Phrases(), []

    def add(self, words: list[bytes], entries: int, shift: int, code: bytes, times: bytes | None) -> None:
        own = np.ones(entries, np.int64)
        if times is not None:
            places, more = _unpacked(times, np.int64)
            own[places] += more
        self.letters.append((self.phrases.numbers(words), golomb_decode(entries, shift, code), own))

    def rows(self, letter) -> list[np.ndarray]:
        number, keys, _ = letter
        return [number[c] for c in _split(keys, len(number) - 1)]

    def _own(self, columns: list[np.ndarray], bits: int) -> np.ndarray:
        a, b, c = (x.astype(np.uint64) for x in columns)
        return (_pair_hash(_pair_hash(a, b), c) >> np.uint64(64 - bits)).astype(np.int64)

    def candidates(self, least: int) -> list[np.ndarray]:
        """The distinct phrases whose counter reaches ``least``: their words' numbers, ascending."""
        bits = min(OWN_BITS, 1 + sum(len(keys) for _, keys, _ in self.letters).bit_length())
        counters = np.zeros(1 << bits, np.int64)
        for letter in self.letters:
            np.add.at(counters, self._own(self.rows(letter), bits), letter[2])
        for letter in self.letters:
            columns = self.rows(letter)
            passed = counters[self._own(columns, bits)] >= least
            self.phrases.add([c[passed] for c in columns], letter[2][passed])
        return self.phrases.distinct()[:3]

    def counted(self, least: int):
        """(first, second and third words' numbers, f) of the phrases with f >= ``least``, a block of them at a time."""
        found = np.stack(self.candidates(least), axis=1).astype(np.int64)
        for start in range(0, len(found), BLOCK_PHRASES):
            block = found[start : start + BLOCK_PHRASES]
            trie = DoubleArray.build(np.zeros(len(block), np.int64), block, len(self.phrases.known))
            totals = np.zeros(len(block), np.int64)
            for letter in self.letters:
                columns = self.rows(letter)
                own = np.flatnonzero((columns[0] >= block[0, 0]) & (columns[0] <= block[-1, 0]))
                trie.add(0, np.stack([c[own] for c in columns], axis=1), letter[2][own], totals)
            often = totals >= least
            yield block[often], totals[often]


def _merged(batches, least: int = 1):
    """Letters sorted by bucket and language -> their distinct phrases with f >= ``least``; w3 is null in pairs. Letters
    without times give no f, and count their phrases once."""
    at, bucket = None, None

    def closed():
        words = bucket.phrases.words()
        for rows, f in bucket.counted(least):
            columns = [words.take(pa.array(c, mask=c == 0)) for c in rows.T]
            for k in range(0, len(rows), LETTER):
                own = [c.slice(k, LETTER) for c in columns]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at[1]] * len(own[0]), pa.string()), *own, *([pa.array(f[k : k + LETTER])] if timed else [])],
                    ["lang", "w1", "w2", "w3", "f"][: 4 + timed])

    for batch in batches:
        timed = batch.num_columns > 6
        for place, lang, words, entries, shift, code, *times in zip(*batch.columns):
            if (place.as_py(), lang.as_py()) != at:
                if at:
                    yield from closed()
                    bucket = None
                    _give_back()
                at, bucket = (place.as_py(), lang.as_py()), _Bucket()
            bucket.add(words.as_py(), entries.as_py(), shift.as_py(), code.as_py(), times[0].as_py() if timed else None)
    if at:
        yield from closed()
    bucket = None
    _give_back()


_COUNTED = "lang string, w1 binary, w2 binary, w3 binary, f bigint"


def _frequencies(docs: DataFrame, shelf: Shelf, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, word, f) of all words, and (lang, w1, w2, w3, f) of the phrases with f >= ``least``; w3 may be null."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    seen = shelf.put(texts.mapInArrow(_seen, _SEEN), "seen", compression="zstd")
    portions = seen.select("lang", "words", "numbers")
    counted = seen.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
    # The first word of a portion is the end of a piece.
    words = shelf.put(counted.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f")).where(
        F.col("word") != F.lit(".").cast("binary")), "words")
    total = words.agg(F.sum("f")).first()[0] or 0
    bits = _bits(total)
    ranges = portions.mapInArrow(_added(least, bits), "kind int, range int, letter binary")
    heavy = ranges.repartition("kind", "range").sortWithinPartitions("kind", "range").mapInArrow(_heavy(least), "kind int, range int, bits binary")
    bitmaps = {k: np.zeros(1 << bits - 3, np.uint8) for k in (2, 3)}
    size = 1 << RANGE_BITS - 3
    for r in heavy.toLocalIterator():
        bitmaps[r.kind][r.range * size : (r.range + 1) * size] = np.frombuffer(r.bits, np.uint8)
    sent = spark.sparkContext.broadcast(bitmaps)
    del bitmaps
    letters = portions.mapInArrow(_candidates(sent, buckets_for(total, BUCKET_WORDS), bits), _LETTER).repartition("bucket").sortWithinPartitions("bucket", "lang")
    phrases = shelf.put(letters.mapInArrow(partial(_merged, least=least), _COUNTED), "phrases")
    sent.destroy()
    shelf.remove("seen")
    return words, phrases


def _score(l: str, r: str):
    """floor(1000000 * a * a / (l * r)), exact: decimals of 38 digits hold it up to a of 10**15."""
    return F.expr(f"(CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(16,0)) * CAST(a AS DECIMAL(15,0))) div "
                  f"(CAST({l} AS DECIMAL(19,0)) * CAST({r} AS DECIMAL(19,0)))")


def mine_phrases(docs: DataFrame, least: int = 10, percent: int = 50, top: int | None = 2000) -> DataFrame:
    """The ``top`` phrases of every language of ``docs`` (text, lang): lang, rank, phrase, a, l, r, n, score.

    Phrases have two or three words and a frequency a >= ``least``; l and r are the frequencies of the parts at the cut
    that scores lowest, n the number of words of the language. A phrase inside a longer one with 100 * frequency >=
    ``percent`` * a is dropped. A null lang is ``und``, a null text empty; repeated rows count each time. Ties: score,
    then a, fall, the phrase's bytes rise. Words and texts may have any length; a piece (text between ends) is held
    whole in a task. Columns other than text and lang are not read; no phrase gives an empty result. ``top=None`` gives
    all phrases. ``least`` is at most 65535.
    """
    if not 1 <= least <= _MOST:
        raise ValueError(f"least must be from 1 to {_MOST}")
    shelf = Shelf(docs.sparkSession, "collocations")
    words, phrases = _frequencies(docs, shelf, least)
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    pairs = phrases.where("w3 IS NULL").select("lang", "w1", "w2", F.col("f").alias("a"))
    triples = phrases.where("w3 IS NOT NULL").select("lang", "w1", "w2", "w3", F.col("f").alias("a"))
    often = words.where(F.col("f") >= least)
    single = lambda w, f: often.select("lang", F.col("word").alias(w), F.col("f").alias(f))
    double = lambda u, v, f: pairs.select("lang", F.col("w1").alias(u), F.col("w2").alias(v), F.col("a").alias(f))

    longer = triples.select("lang", "a", F.explode(F.array(
        F.struct(F.col("w1").alias("u"), F.col("w2").alias("v")), F.struct(F.col("w2").alias("u"), F.col("w3").alias("v")))).alias("p"))
    longer = longer.groupBy("lang", F.col("p.u").alias("w1"), F.col("p.v").alias("w2")).agg(F.max("a").alias("around"))
    two = (pairs.join(longer, ["lang", "w1", "w2"], "left").where(F.col("around").isNull() | (100 * F.col("around") < percent * F.col("a")))
           .join(single("w1", "l"), ["lang", "w1"]).join(single("w2", "r"), ["lang", "w2"])
           .select("lang", F.concat("w1", F.lit(" ").cast("binary"), "w2").alias("phrase"), "a", "l", "r", _score("l", "r").alias("score")))
    three = (triples.join(single("w1", "l1"), ["lang", "w1"]).join(double("w2", "w3", "r1"), ["lang", "w2", "w3"])
             .join(double("w1", "w2", "l2"), ["lang", "w1", "w2"]).join(single("w3", "r2"), ["lang", "w3"])
             .withColumn("s1", _score("l1", "r1")).withColumn("s2", _score("l2", "r2")))
    first = F.col("s1") <= F.col("s2")
    three = three.select("lang", F.concat("w1", F.lit(" ").cast("binary"), "w2", F.lit(" ").cast("binary"), "w3").alias("phrase"), "a", *[
        F.when(first, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("l1", "l2", "l"), ("r1", "r2", "r"), ("s1", "s2", "score"))])

    order = [F.desc("score"), F.desc("a"), "phrase"]
    every = two.unionByName(three)
    if top is not None:
        # The first of every slice of a language, then the first of these.
        every = every.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(64)))
        every = every.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).where(F.col("rank") <= top)
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    out = cut(ranked.join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", "n", "score"))
    shelf.close()
    return out
