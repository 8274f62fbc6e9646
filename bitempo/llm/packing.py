"""Best-fit packing of token sequences through a configuration linear program.

Documents become token ids and an end mark; only longer ones are cut, into pieces
of CAPACITY. The program's rows are the piece lengths with their counts, its columns
configurations (how many pieces of each length fill one sequence). Multiplicative
weights price the lengths and a knapsack by dynamic programming finds the dearest
configurations, which add up to a fractional solution (``fractional``). Its columns
are rounded to whole sequences, and what stays is solved and rounded again
(``rounded``); pieces that no column takes, a small rest, go best fit into the room
that is left or into sequences of their own. All of this sees only the histogram of
lengths, whose size is fixed. Groups of equal sequences are then dealt out to pieces
by their rank among the pieces of their length, which is counted in hash buckets, as
many as the number of pieces asks for, so that no length is one task's.

A null text is empty: the end mark alone. Rows that repeat a doc_id are documents
of their own; ties of rank are settled by doc_id, piece and checksum. A null doc_id
stays null. Further columns are ignored.
"""

from __future__ import annotations

import re
import string
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

CAPACITY = 2048
END = 0
#: Steps of the program, how fast its prices move, and how full a column is that is rounded, of the fullest.
STEPS, ETA, NEARLY = 8, 8.0, 0.998
#: What counts as nothing when covers are compared.
EDGE = 1e-9
#: Pieces of one length that one task ranks, about.
RANKED = 2_000
#: Bytes of text that are encoded at once, about.
BATCH_BYTES = 24_000_000
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

_TOKENIZERS: dict[str, tuple] = {}


def _tokenizer(path: str) -> tuple:
    """The tokenizer, its model alone (parting at spaces), and which ids end a word."""
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer, pre_tokenizers

        whole = Tokenizer.from_file(path)
        bare = Tokenizer(whole.model)
        bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = whole.get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        _TOKENIZERS[path] = whole, bare, ends
    return _TOKENIZERS[path]


#: A sign that is one token by itself; words that hold it are encoded alone.
PART = "\x01"
SIGNS = string.punctuation.encode()
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


def _bytes_of(ids: list[int]) -> tuple[np.ndarray, bytes]:
    found = np.array(ids, "<u4")
    return found, found.tobytes()


def _plain_ids(bare, ends: np.ndarray, parts: list[bytes]) -> list[bytes]:
    """The ids of parts that are one unit for the model: lower-case letters, or signs. The model alone sees them, many at a time."""
    out: list[bytes] = []
    for at in range(0, len(parts), 2000):
        some = parts[at : at + 2000]
        ids, raw = _bytes_of(bare.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids)
        cuts = ((np.flatnonzero(ends[ids]) + 1) * 4).tolist()
        assert len(cuts) == len(some), "a part is more than one unit"
        out += [raw[s:e] for s, e in zip([0, *cuts], cuts)]
    return out


def _ids(tokenizer, words: list[bytes]) -> list[bytes]:
    """The ids of any words. Many go as one text with PART between them, which costs less than a text each."""
    out: list[bytes] = []
    mark = tokenizer.encode(PART, add_special_tokens=False).ids
    for at in range(0, len(words), 2000):
        part = [w.decode() for w in words[at : at + 2000]]
        joined = [w for w in part if PART not in w]
        ids, raw = _bytes_of(tokenizer.encode_batch_fast([f" {PART} ".join(["", *joined])], add_special_tokens=False)[0].ids)
        starts = np.flatnonzero(ids == mark[-1])
        assert len(mark) == 1 and len(starts) == len(joined), "the sign between words is no token of its own"
        starts = (starts * 4).tolist()
        found = iter([raw[s + 4 : e] for s, e in zip(starts, [*starts[1:], len(raw)])])
        out += [np.array(tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes() if PART in w else next(found) for w in part]
    return out


def _of_words(words: list[bytes], path: str) -> list[bytes]:
    """The ids of distinct words.

    The vocabulary ignores case and parts letters from signs: a word of Latin letters,
    with or without signs after it, is its letters and its signs, which are encoded once.
    """
    tokenizer, bare, ends = _tokenizer(path)
    out: list[bytes] = [b""] * len(words)
    plain: list[tuple] = []
    other, latin, letters, signs = [], LATIN.fullmatch, {}, {b"": 0}
    for i, w in enumerate(words):
        core = w.rstrip(SIGNS)
        if core.isalpha():
            low = core.lower()
        elif not core.isascii() and latin(said := core.decode()):
            low = said.lower().encode()
        else:
            low = b""
        if low and b"<|" not in w:  # with it, perhaps a special token
            plain.append((i, letters.setdefault(low, len(letters)), signs.setdefault(w[len(core) :], len(signs))))
        elif w:
            other.append(i)
    of_letters = _plain_ids(bare, ends, list(letters))
    of_signs = [b"", *_plain_ids(bare, ends, list(signs)[1:])]
    for i, a, b in plain:
        out[i] = of_letters[a] + of_signs[b]
    for i, ids in zip(other, _ids(tokenizer, [words[i] for i in other])):
        out[i] = ids
    return out


def encode(texts: pa.Array, path: str = VOCABULARY) -> Iterator[np.ndarray]:
    """The ids of each text (null: none), as unsigned 32-bit numbers. ASCII white space parts tokens in this vocabulary, so each word of a batch is encoded once."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    coded = split.flatten().dictionary_encode()
    found = _of_words(coded.dictionary.cast(pa.large_binary()).to_pylist(), path)
    flat = np.frombuffer(b"".join(found), "<u4")
    lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
    starts = np.cumsum(lengths) - lengths
    words, ends = coded.indices.to_numpy(zero_copy_only=False), split.offsets.to_numpy()
    ends = ends - ends[0]
    for at, to in zip(ends[:-1], ends[1:]):
        w = words[at:to]
        n = lengths[w]
        upto = np.cumsum(n)
        yield flat[np.repeat(starts[w] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)]


def token_pieces(docs: DataFrame, path: str = VOCABULARY, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of each piece."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for whole_batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(whole_batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < whole_batch.num_rows:
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH_BYTES, side="right")))
                batch = whole_batch.slice(at, to - at)
                at = to
                out: list[list] = [[] for _ in names]
                for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1), path)):
                    for piece, s in enumerate(range(0, len(ids) + 1, capacity)):
                        cut = ids[s : s + capacity]
                        if len(cut) < capacity:  # the last piece, with the end mark
                            cut = np.append(cut, np.uint32(END))
                        row = [doc, piece, s, len(cut), zlib.crc32(cut.astype("<u4").tobytes())]
                        for c, v in zip(out, row + [cut.astype(np.int64)] * with_ids):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def knapsack(price: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """For each room up to capacity, the highest total price of pieces that fit: a knapsack by dynamic programming."""
    best = np.zeros(capacity + 1)
    ends = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if n := ends[room]:
            best[room] = max(best[room], (best[room - lengths[:n]] + price[:n]).max())
    return best


def configuration(row: int, best: np.ndarray, price: np.ndarray, lengths: np.ndarray, most: np.ndarray, capacity: int) -> dict[int, int]:
    """The dearest way to fill a sequence that holds lengths[row], of what there is: places in lengths and how many of each, at most most."""
    held, room, left = {row: 1}, capacity - int(lengths[row]), most.copy()
    left[row] -= 1
    while room >= lengths[0]:
        fit = np.flatnonzero(left[: np.searchsorted(lengths, room, side="right")] > 0)
        if not len(fit):
            break
        worth = best[room - lengths[fit]] + price[fit]
        k = int(fit[len(fit) - 1 - worth[::-1].argmax()])  # of equals the longest
        n = int(min(left[k], room // lengths[k])) if lengths[k] * 8 < room else 1
        held[k] = held.get(k, 0) + n
        left[k] -= n
        room -= n * int(lengths[k])
    return held


Group = tuple[tuple[int, ...], int]  # lengths in a sequence, number of such sequences
Column = tuple[tuple[int, int], ...]  # (place in lengths, pieces of it), by place


def fractional(counts: dict[int, int], capacity: int, steps: int = STEPS) -> tuple[np.ndarray, dict[Column, float], float]:
    """lengths, a fractional solution of the configuration program, and a lower bound of its value by its dual.

    The covering rows rise together: after step k of steps, every row is covered to at
    least k / steps. A row that is behind takes the dearest configuration that holds it
    and no row that is a step ahead, as much as it lacks or until one of its rows is a
    step ahead. The price of a row falls exponentially with its cover.
    """
    lengths = np.array(sorted(counts), np.int64)
    many = np.array([counts[int(n)] for n in lengths], np.int64)
    covered, x = np.zeros(len(lengths)), Counter()
    start, bound = lengths / capacity, 0.0
    for step in range(steps):
        price = start * np.exp(-ETA * (covered - step / steps))
        best = knapsack(price, lengths, capacity)
        bound = max(bound, float(price @ many) / best[capacity])  # prices over the dearest configuration's are a dual solution
        target, ahead = (step + 1) / steps, min((step + 2) / steps, 1.0)
        open_ = np.where(covered < ahead - EDGE, many, 0)
        for row in np.lexsort((-lengths, covered)):
            while covered[row] < target - EDGE:
                held = configuration(int(row), best, price, lengths, open_, capacity)
                ks, ns = np.array(list(held)), np.array(list(held.values()))
                amount = min((target - covered[row]) * many[row] / held[int(row)], float(((ahead - covered[ks]) * many[ks] / ns).min()))
                x[tuple(sorted(held.items()))] += amount
                covered[ks] += ns * amount / many[ks]
                open_[ks[covered[ks] >= ahead - EDGE]] = 0
    return lengths, x, bound


def rounded(counts: dict[int, int], capacity: int = CAPACITY) -> list[Group]:
    """Whole sequences of the program's columns, none of whose pieces is there twice.

    Columns about as full as the fullest are rounded down, then, by what was cut off, up
    where all their pieces are left. What stays is a smaller program, solved and rounded
    again while that places a tenth of its pieces or more.
    """
    groups: Counter = Counter()
    left = {n: k for n, k in counts.items() if k}
    while left:
        lengths, x, _ = fractional(left, capacity)
        room, before = dict(left), sum(left.values())

        def take(column: Column, most: int) -> None:
            times = min(most, *(room[int(lengths[k])] // n for k, n in column))
            if times > 0:
                groups[tuple(int(lengths[k]) for k, n in reversed(column) for _ in range(n))] += times
                for k, n in column:
                    room[int(lengths[k])] -= n * times

        full = {c: sum(int(lengths[k]) * n for k, n in c) for c in x}
        least = NEARLY * max(full.values())
        good = sorted((c for c in x if full[c] >= least), key=lambda c: (-full[c], -x[c], c))
        for column in good:
            take(column, int(x[column]))
        for column in sorted(good, key=lambda c: (-full[c], int(x[c]) - x[c])):
            take(column, 1)
        left = {n: k for n, k in room.items() if k}
        if 10 * sum(left.values()) > 9 * before:
            break
    return list(groups.items())


def best_fit(counts: dict[int, int], capacity: int, begun: list[Group] = []) -> list[Group]:
    """begun and the pieces of counts, each in the fullest sequence that has room for it, longest first; equal sequences are one group."""
    free: dict[int, dict[tuple[int, ...], int]] = {}
    for content, many in begun:
        free.setdefault(capacity - sum(content), {})[content] = many
    room = sorted(free)  # what is in free
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fit = bisect_left(room, length)
            if fit == len(room):
                each = capacity // length
                full, rest = divmod(left, each)
                for n, many in ((each, full), (rest, 1 if rest else 0)):
                    if many:
                        at = free.setdefault(capacity - n * length, {})
                        at[(length,) * n] = at.get((length,) * n, 0) + many
                left = 0
            else:
                content, many = free[room[fit]].popitem()
                each = min(room[fit] // length, left)
                used = min(many, left // each)
                if many > used:
                    free[room[fit]][content] = many - used
                at = free.setdefault(room[fit] - each * length, {})
                more = content + (length,) * each
                at[more] = at.get(more, 0) + used
                left -= used * each
            room = sorted(r for r, groups in free.items() if groups)
    return [(content, many) for groups in free.values() for content, many in groups.items()]


def pack(counts: dict[int, int], capacity: int = CAPACITY) -> list[Group]:
    """Groups of sequences that hold every piece of the histogram once."""
    groups: list[Group] = [((capacity,), counts[capacity])] if counts.get(capacity) else []
    short = {n: k for n, k in counts.items() if k and n < capacity}
    columns = rounded(short, capacity)
    held = Counter()
    for content, many in columns:
        for n in content:
            held[n] += many
    return groups + best_fit({n: k - held[n] for n, k in short.items() if k > held[n]}, capacity, columns)


def places(groups: list[Group]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, pieces of it in one sequence, first sequence, offset there) of each length in each group."""
    out, rank, sequence = [], Counter(), 0
    for content, many in groups:
        at = 0
        for length in dict.fromkeys(content):
            n = content.count(length)
            out.append((length, rank[length], n * many, n, sequence, at))
            rank[length] += n * many
            at += n * length
        sequence += many
    return out


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset. pieces is read four times: let it be a written table."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most CAPACITY rows
    buckets = 64 + max(histogram.values(), default=0) // RANKED
    keyed = pieces.withColumn("_bt_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy("length", "_bt_bucket").agg(F.count("*").alias("n"))
    plan = places(pack(histogram, capacity))
    slots = spark.createDataFrame(plan, "_bt_length long, _bt_first long, _bt_ranks long, _bt_each long, _bt_seq long, _bt_at long")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_bt_bucket")) - F.col("n")
    bases = counts.select("length", "_bt_bucket", before.alias("_bt_base"))
    within = F.row_number().over(Window.partitionBy("length", "_bt_bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = keyed.withColumn("_bt_within", within).join(bases, ["length", "_bt_bucket"]).withColumn("_bt_rank", F.col("_bt_base") + F.col("_bt_within"))
    here = (F.col("length") == F.col("_bt_length")) & (F.col("_bt_rank") >= F.col("_bt_first")) & (F.col("_bt_rank") < F.col("_bt_first") + F.col("_bt_ranks"))
    # slots: their number follows from the histogram's lengths and the steps of the program, not from the number of pieces
    met = ranked.join(F.broadcast(slots), here)
    j = F.col("_bt_rank") - F.col("_bt_first")
    sequence = F.col("_bt_seq") + F.floor(j / F.col("_bt_each"))
    offset = F.col("_bt_at") + F.pmod(j, F.col("_bt_each")) * F.col("length")
    return met.select(*[F.col(f"`{c}`") for c in pieces.columns], sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))


def pack_documents(docs: DataFrame, with_ids: bool = False) -> DataFrame:
    return packed(written(token_pieces(docs, with_ids=with_ids), "pieces"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
