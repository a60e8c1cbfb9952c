"""Best-fit packing after Martello-Toth dominance reduction.

Lengths are whole numbers from 1 to the capacity, so the instance is a histogram of at most `capacity` counts, however many
documents there are; only that goes to the driver. There the reduction fixes, for as many bins as the counts allow, sets that
provably dominate every other way to fill a bin around its largest item (an item nothing fits beside; an item with the one
that fills its bin exactly; an item with the largest that fits, where no two others fit together, or no two of them are
larger). Best-fit decreasing packs what is left, also by counts. The plan is a list of bin patterns with multiplicities;
pieces find their places by their rank among the pieces of the same length, counted over even slices of each length.

Defined cases: null text is empty; an empty document is the closing id alone. Only documents longer than the capacity are
cut. Repeated rows are packed each for itself. No rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordvane.llm.common import hash01, in_small_batches, local_rows, running_sum, staged

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Chunks and words whose ids a worker keeps: two generations of so many of each.
CACHED = 150_000
#: Only characters that the tokenizer drops for certain part the chunks, which are encoded each for itself.
GAPS = ("\t", "\n", "\r", "\x0b", "\x0c")
#: Chunks of printable ASCII and of Latin-1 letters are cut into words here; NFC changes none of them, and lower-casing is one to one.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: The tokenizer's own split of lower-cased text, over these characters.
WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Cache:
    """Two generations: once the young one is full it becomes the old one; what is met again moves over."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def find(self, key: str) -> bytes | None:
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.young[key] = found
        return found

    def turn(self) -> None:
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where printable, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes. The tokenizer drops white space and never joins over it, nor over the
    borders of its words, so a text's ids are those of its chunks in order, and a plain chunk's those of its words; both are
    looked up where met before. Chunks with other characters or special tokens go through the whole tokenizer."""

    def __init__(self, path: str, cached: int = CACHED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize, self.letters = self.tokenizer.model.tokenize, byte_letters()
        self.units = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.chunks, self.words = Cache(cached), Cache(cached)

    def word(self, word: str) -> bytes:
        ids = self.words.find(word)
        if ids is None:
            seen = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
            units = self.units
            ids = self.words.young[word] = b"".join([units[t.id] for t in self.tokenize(seen)])
        return ids

    def learn(self, chunks: set[str]) -> None:
        known, whole = self.chunks.young, []
        for c in chunks:
            if self.chunks.find(c) is not None:
                continue
            if PLAIN.fullmatch(c) and "<|" not in c:
                low = c.lower()
                # letters alone are one word of the tokenizer's split
                known[c] = self.word(low) if low.isalpha() else b"".join([self.word(w) for w in WORDS.findall(low)])
            else:
                whole.append(c)
        if whole:
            for c, e in zip(whole, self.tokenizer.encode_batch(whole, add_special_tokens=False), strict=True):
                known[c] = b"".join([i.to_bytes(4, "little") for i in e.ids])

    def encode(self, text: str) -> bytes:
        for gap in GAPS:
            text = text.replace(gap, " ")
        chunks = text.split(" ")
        if new := set(chunks).difference(self.chunks.young):
            self.learn(new)
        out = b"".join(map(self.chunks.young.__getitem__, chunks))
        self.words.turn()
        self.chunks.turn()
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """One per Python worker, kept over its tasks."""
    return WordEncoder(path)


def pieces(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces."""
    path = path or tokenizer_path()

    def cut(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, last = encoder(path).encode, end_id.to_bytes(4, "little")
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            out: list[list] = [[], [], [], [], []]
            for at in range(0, batch.num_rows, 64):
                for doc_id, text in zip(ids.slice(at, 64).to_pylist(), texts.slice(at, 64).to_pylist(), strict=True):
                    data = encode(text or "") + last
                    for k, begin in enumerate(range(0, len(data) // 4, capacity)):
                        part = data[4 * begin : 4 * (begin + capacity)]
                        for column, value in zip(out, (doc_id, k, begin, len(part) // 4, zlib.crc32(part)), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return in_small_batches(documents).select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


Pattern = tuple[tuple[int, int], ...]


def reduce_instance(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Fixes dominating sets, taking their items out of counts; a list of (pattern as (length, how many) runs, times)."""
    fixed: list[tuple[Pattern, int]] = []
    for length in sorted(counts, reverse=True):
        present = sorted(k for k, n in counts.items() if n)
        while counts[length]:
            room, own = capacity - length, counts[length]
            # what else fits beside one item of this length
            left = {k: counts[k] - (k == length) for k in present[: bisect_left(present, room + 1)]}
            fitting = [k for k in left if left[k] > 0]
            if not fitting:
                fixed.append((((length, 1),), own))
                counts[length] = 0
                break
            largest = fitting[-1]
            two_smallest = fitting[0] + (fitting[0] if left[fitting[0]] > 1 else fitting[1] if len(fitting) > 1 else capacity)
            exact, single = length + largest == capacity, two_smallest > room
            if not (exact or single or largest >= best_pair(fitting, left, room)):
                break
            times = own // 2 if largest == length else min(own, counts[largest])
            fixed.append((((length, 2),) if largest == length else ((length, 1), (largest, 1)), times))
            counts[length] -= times * (2 if largest == length else 1)
            if largest != length:
                counts[largest] -= times
            present = [k for k in present if counts[k]]
    for k in [k for k, n in counts.items() if not n]:
        del counts[k]
    return fixed


def best_pair(fitting: list[int], left: dict[int, int], room: int) -> int:
    """The largest sum of two or more items' lengths within room, or room itself where more than two fit (then nothing is known)."""
    smallest = fitting[0]
    if smallest * 3 <= room:  # three may fit
        return room
    best, i, j = 0, 0, len(fitting) - 1
    while i <= j:
        total = fitting[i] + fitting[j]
        if total > room or (i == j and left[fitting[i]] < 2):
            j -= 1
        else:
            best = max(best, total)
            i += 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing by counts: what item-by-item best fit would do, whole groups of equal bins at a time."""
    by_room: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, times: int) -> None:
        if room not in by_room or not by_room[room]:
            insort(rooms, room)
        by_room[room].append((pattern, times))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                room, pattern, times = capacity, (), -(-n // (capacity // length))
            else:
                room = rooms[at]
                pattern, times = by_room[room].pop()
                if not by_room[room]:
                    rooms.pop(at)
            each = room // length
            full = min(times, n // each)
            if full:
                put(room - each * length, (*pattern, (length, each)), full)
            n -= full * each
            if full < times:
                if n:  # fewer than `each` are left for one more bin
                    put(room - n * length, (*pattern, (length, n)), 1)
                    full, n = full + 1, 0
                if full < times and pattern:
                    put(room, pattern, times - full)
    return [x for room in sorted(by_room) for x in by_room[room]]


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    counts = dict(counts)
    return reduce_instance(counts, capacity) + best_fit(counts, capacity)


def slots(plan: list[tuple[Pattern, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, pieces per bin, first sequence, offset in its bins) of each run of each pattern."""
    rank: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for pattern, times in plan:
        offset = 0
        for length, each in pattern:
            out.append((length, rank[length], rank[length] + each * times, each, sequence, offset))
            rank[length] += each * times
            offset += each * length
        sequence += times
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces() with sequence_id and offset. cut is read several times: stage it first."""
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    runs = slots(packing_plan(counts, capacity))
    ranked = running_sum(cut.withColumn("_spot", hash01(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("piece"), seed="pack")).withColumn("_one", F.lit(1)), "length", "_spot", ["doc_id", "piece", "ids_crc32"], "_one", "_rank")
    places = local_rows(spark, runs, "_length long, _from long, _to long, _each long, _sequence long, _offset long")
    # Runs follow from at most `capacity` counts, a few per length; they grow with that, not with the documents.
    found = ranked.join(F.broadcast(places), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")), "left")
    nth = F.col("_rank") - F.col("_from")
    return found.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_sequence") + F.floor(nth / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + (nth % F.col("_each")) * F.col("length")).cast("long").alias("offset"),
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of `documents` with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(staged(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
