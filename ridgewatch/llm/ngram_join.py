"""Near-duplicate join: Jaccard similarity of word n-gram sets by vertical partitioning.

The global order of n-grams puts those that only one set has first and orders the others by hash. The hash range is cut
into fragments; each task holds one fragment of all sets, packed.

1. Every text becomes its set of hashed n-grams. Equal sets are one set from here on.
2. Each fragment counts, for each set, how many of its n-grams in the fragment some other set has too. The partial
   counts (with those n-grams) are summed for each set. Similarity s needs an intersection of at least s times the
   set's size, so a set with fewer shared n-grams in all can't link and is done; measured, nine in ten are.
3. The remaining sets meet in their prefixes: two sets of similarity s share one of the first n - ceil(s n) + 1
   n-grams of either in the global order. N-grams that only one set has come first, so the prefix of a set with many
   own n-grams reaches few shared ones. Sets of comparable size with the same prefix n-gram form a bucket. Buckets
   with the same best member (fewest own n-grams) make one group; any two sets that meet in a bucket meet in its group.
4. A group's candidate pairs are its best member with each other one, as many as it has members. Their n-grams are cut
   into PAIR_FRAGMENTS fragments of the global order; each fragment counts every pair's partial overlap by itself, and
   the partial counts are summed for each pair in a shuffle. Large groups are dealt to blocks of BLOCK_TOKENS, each with
   the best member's fragment, so a group of a third of all rows is many tasks.
5. Members that aren't similar to their best one may link with others that they meet in a bucket of the group: these few
   are compared with all that meet others, in blocks, and only while they haven't yet come into the component; a pair's
   overlap is again summed over fragments, until none can be enough. Such a task emits at most one link for each member, which needn't be a similar
   pair but joins the right components. So no pair is emitted but with a best member, a group of copies costs its size,
   and every link that could join two components is tested. link_counts has a group emit all true links.
6. Components of the links, by smallest labels with pointer jumping, written after each round.

Bounded memory: a fragment holds FRAGMENT_TOKENS n-grams on average, however many fragments that makes, and an n-gram
counts in it once for each chunk of CHUNK_TOKENS, however many texts have it. Beyond MOST_TASKS fragments a task goes
through several, one after another.

Hashes have 64 bits (an n-gram) and 128 bits (a set). Within a fragment n-grams are told apart by 48 more bits than the
fragment's number. A collision can matter only inside one pair of sets or, in step 2, keep a set for step 3.

Defined results: null, empty and blank texts have no n-grams and link with nothing; fewer than SHINGLE words are one
n-gram; rows with a null id have no component (null) and link nothing; rows with equal ids are separate texts, and
ids never link; an empty table gives an empty result. one_of_each keeps one row of each component, that with the
smallest id, whatever other rows have that id: rows are told apart by id and text, and of rows equal in both one stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgewatch.llm.common import LOWER_ASCII, discard, fresh, give_back_memory, map_batches, store, utf8

SHINGLE = 5
#: Similarity in hundredths.
SIMILARITY = 80
FRAGMENT_TOKENS, CHUNK_TOKENS, GROUP_TOKENS, BLOCK_TOKENS = 2_000_000, 1_000_000, 1_000_000, 250_000
#: Partitions that fragments are shuffled into at most; results don't depend on it.
MOST_TASKS = 50_000
_FACTORS = np.array([0x9E3779B97F4A7C15 * k | 1 for k in range(3, 99, 2)], dtype=object) % (1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def ngrams(data: bytes, size: int = SHINGLE) -> np.ndarray:
    """The sorted set of hashed n-grams of a text's words."""
    words = data.translate(LOWER_ASCII).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    hashes = np.array(list(map(xxhash.xxh3_64_intdigest, words)), dtype=np.uint64)
    count = len(words) - size + 1
    out = np.zeros(count, dtype=np.uint64)
    for k in range(size):
        out += hashes[k : count + k] * np.uint64(_FACTORS[k])
    return np.unique(_mix(out))


def set_id(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def needed(n: int, similarity: int) -> int:
    """The least intersection of a set of n with any set of that similarity."""
    return -(-similarity * n // 100)


def set_ids(documents: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """Per row: key, mark (a hash of its text), n (the set's size) and sid (16 bytes, null for an empty set)."""
    own = F.col(text).cast("string")
    rows = documents.select(F.col(key).alias("key"), own.alias("text"), F.xxhash64(own).alias("mark"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [ngrams(data, size) for data in utf8(batch.column(1))]
        sids = [set_id(s) if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(list(map(len, sets)), pa.int64()), pa.array(sids, pa.binary())],
            ["key", "mark", "n", "sid"],
        )

    return map_batches(rows, run, f"key {rows.schema['key'].dataType.simpleString()}, mark bigint, n bigint, sid binary")


# A packed segment row holds some n-grams of many sets: a key for each set, runs (how many n-grams follow for it, 1 byte)
# and grams. A set that several rows have may come from several chunks, so its key is KEY_BYTES of its id. Any other set
# comes from one chunk only: its key is the chunk's name, which a row holds once, and its number there (LOCAL_BYTES), so
# that however few n-grams a set has in a fragment, its key costs less than they do. Only the collecting parts need whole
# ids and sizes, so these come once for each set and chunk, in directory rows, which have sizes (and, once collected, the
# keys as grams). part says where a row goes: fragments first, then as many collecting parts.
_SEGMENTS = "part int, sids binary, sizes binary, runs binary, grams binary, chunk binary"
_NAMES = ["part", "sids", "sizes", "runs", "grams", "chunk"]
#: Ranges of the global order in which a pair's overlap is counted.
PAIR_FRAGMENTS = 4
#: Pieces in which a task goes through its fragment.
SLICES = 4
#: Keys have 80 bits: with 10**10 sets, two share one with a chance of 4 in 100,000; then the collecting part stops the job.
KEY_BYTES, LOCAL_BYTES, LONGEST_RUN = 10, 2, 255
#: Bits at most of the map of sets that several rows have (8 MB). Where it is full, more sets have keys of their ids.
MOST_BITS = 1 << 26


def _fragment(grams: np.ndarray, fragments: int) -> np.ndarray:
    return (grams >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)


def _collector(keys: np.ndarray, parts: int) -> np.ndarray:
    """The collecting part of each set. keys: n x 2 numbers."""
    with np.errstate(over="ignore"):
        return (_mix(keys[:, 0] + keys[:, 1] * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(parts)).astype(np.int64)


def _pack(part: int, keys: np.ndarray, owner: np.ndarray, grams: np.ndarray, chunk: bytes = b"") -> tuple:
    """owner: for each n-gram the row of its set in keys; equal owners are next to each other. chunk: the name of the one
    that all these sets come from, if they have such keys."""
    starts = np.nonzero(np.diff(owner, prepend=-1))[0]
    own, runs = owner[starts], np.diff(np.append(starts, len(owner)))
    pieces = -(-runs // LONGEST_RUN)
    if (pieces > 1).any():
        own, rest = np.repeat(own, pieces), runs - (pieces - 1) * LONGEST_RUN
        ends = np.cumsum(pieces) - 1
        runs = np.full(len(own), LONGEST_RUN)
        runs[ends] = rest
    packed = keys.view(np.uint8)[own, len(chunk) : KEY_BYTES].tobytes()
    return part, packed, b"", runs.astype(np.uint8).tobytes(), grams.tobytes(), chunk


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.binary()] * 5]
    columns = list(zip(*rows)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _NAMES)


def _bounds(sorted_keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    starts = np.nonzero(np.diff(sorted_keys, prepend=sorted_keys[:1] - 1))[0] if len(sorted_keys) else []
    for start, end in zip(starts, [*starts[1:], len(sorted_keys)]):
        yield int(sorted_keys[start]), int(start), int(end)


def _low(grams: np.ndarray) -> np.ndarray:
    """The low 48 bits as 6 bytes each: the high ones are the fragment's."""
    return np.ascontiguousarray(grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def _wide(packed: bytes, size: int, to: int) -> np.ndarray:
    """Rows of size bytes as rows of little-endian numbers of to bytes in all."""
    rows = np.frombuffer(packed, dtype=np.uint8).reshape(-1, size)
    out = np.zeros((len(rows), to), dtype=np.uint8)
    out[:, :size] = rows
    return out.view("<u8")


def repeated_sets(ids: DataFrame, rows: int) -> bytes:
    """A map of the sets that several rows of set_ids have: _bit() of each is set, of others some may be."""
    bits = min(MOST_BITS, 1 << max(15, (16 * rows).bit_length()))
    bit = F.conv(F.hex(F.substring("sid", 1, 4)), 16, 10).cast("bigint").bitwiseAND(bits - 1)
    some = ids.where("sid is not null").groupBy("sid").agg(F.count("*").alias("k")).where("k > 1").select(bit.alias("bit"))
    # Each of the pieces has 2**15 bits.
    place = (F.col("bit") % (1 << 15)).alias("place")
    pieces = some.select(F.shiftright("bit", 15).alias("piece"), place).groupBy("piece").agg(F.bitmap_construct_agg("place").alias("bitmap"))
    out = bytearray(bits // 8)
    for piece, bitmap in pieces.collect():
        out[piece << 12 : (piece + 1) << 12] = bitmap
    return bytes(out)


def _bit(sids: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Whether the map has each set. sids: n x 2 numbers."""
    at = np.ascontiguousarray(sids).view(np.uint8).reshape(-1, 16)[:, :4].copy().view(">u4").reshape(-1).astype(np.int64) % (8 * len(bitmap))
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _cut_chunk(sets: dict[bytes, np.ndarray], fragments: int, bitmap: np.ndarray) -> list[tuple]:
    """Segment rows of a chunk's sets. bitmap: of repeated_sets().

    N-grams that two sets of the chunk have are shared, so each goes to its fragment once (with no set, to mark it
    for other chunks) and straight to the collecting parts of its sets.
    """
    sids = np.frombuffer(b"".join(sets), dtype="<u8").reshape(-1, 2)
    sizes = np.array([len(s) for s in sets.values()])
    chunk = xxhash.xxh3_64_intdigest(sids.tobytes())
    keys, own_key = _cut_keys(sids), _bit(sids, bitmap)
    keys[~own_key, 0], keys[~own_key, 1] = chunk, np.nonzero(~own_key)[0]
    kinds = ((own_key, b""), (~own_key, chunk.to_bytes(8, "little")))
    grams, owner = np.concatenate(list(sets.values())), np.repeat(np.arange(len(sets)), sizes)
    distinct, inverse, counts = np.unique(grams, return_inverse=True, return_counts=True)
    shared = counts[inverse] > 1
    rows = []
    single, single_owner = grams[~shared], owner[~shared]
    known = distinct[counts > 1]
    place, known_place = _fragment(single, fragments), _fragment(known, fragments)
    order = np.argsort(place, kind="stable")
    for part, start, end in _bounds(place[order].astype(np.int64)):
        mine = order[start:end]
        for kind, name in kinds:
            if len(some := mine[kind[single_owner[mine]]]):
                rows.append(_pack(part, keys, single_owner[some], _low(single[some]), name))
    for part, start, end in _bounds(known_place.astype(np.int64)):
        rows.append((part, b"", b"", b"", _low(known[start:end]).tobytes(), b""))
    common, common_owner = grams[shared], owner[shared]
    collector = _collector(keys, fragments)
    place = collector[common_owner]
    order = np.argsort(place, kind="stable")
    for part, start, end in _bounds(place[order]):
        mine = order[start:end]
        for kind, name in kinds:
            if len(some := mine[kind[common_owner[mine]]]):
                rows.append(_pack(fragments + part, keys, common_owner[some], common[some], name))
    order = np.argsort(collector, kind="stable")
    for part, start, end in _bounds(collector[order]):
        mine = order[start:end]
        rows.append(_directory_row(fragments + part, keys[mine], sids[mine], sizes[mine]))
    return rows


def _distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of one of each distinct row of two numbers, and the number of each row's distinct one; sorted."""
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    fresh = np.ones(len(rows), dtype=bool)
    fresh[1:] = (rows[order][1:] != rows[order][:-1]).any(axis=1)
    number = np.empty(len(rows), dtype=np.int32)
    number[order] = np.cumsum(fresh) - 1
    return order[fresh], number


def _unique_pairs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, sorted."""
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    keep = np.ones(len(first), dtype=bool)
    keep[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    return first[keep], second[keep]


def _keys_of(packed: bytes, chunk: bytes) -> np.ndarray:
    """The keys of a row, n x 2 numbers."""
    if not chunk:
        return _wide(packed, KEY_BYTES, 16)
    number = np.frombuffer(packed, dtype=f"<u{LOCAL_BYTES}").astype(np.uint64)
    return np.stack([np.full(len(number), int.from_bytes(chunk, "little"), dtype=np.uint64), number], axis=1)


def _unpack(rows: list[tuple], gram_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of segment rows of one part: the distinct keys, and for each n-gram the row of its set and itself."""
    keys = np.concatenate([_keys_of(r[1], r[5]) for r in rows])
    runs = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint8)
    first, number = _distinct_rows(keys)
    grams = _wide(b"".join(r[4] for r in rows), gram_bytes, 8).reshape(-1)
    return keys[first], np.repeat(number, runs), grams


def _shared_of(owner: np.ndarray, grams: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, ...]:
    """Owner and n-gram of the n-grams that have several owners or are in marks; each pair once, sorted."""
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    # Equal n-grams are next to each other now; one is shared if its sets differ somewhere in its run.
    fresh_run = np.ones(len(grams), dtype=bool)
    fresh_run[1:] = grams[1:] != grams[:-1]
    run = np.cumsum(fresh_run, dtype=np.int32) - 1
    shared = np.zeros(int(run[-1]) + 1, dtype=bool)
    shared[run[1:][~fresh_run[1:] & (owner[1:] != owner[:-1])]] = True
    if len(marks):
        distinct = grams[fresh_run]
        at = np.minimum(np.searchsorted(distinct, marks), len(distinct) - 1)
        shared[at[distinct[at] == marks]] = True
    keep = shared[run]
    return _unique_pairs(owner[keep], grams[keep])  # a set may come from several chunks


def _count_fragment(part: int, rows: list[tuple], fragments: int) -> list[tuple]:
    """The shared n-grams of a fragment, dealt to the collecting parts of their sets. Empties rows.

    The fragment's own range is gone through in SLICES pieces, so that sorting needs a fraction of its size.
    """
    marks = _wide(b"".join(r[4] for r in rows if not r[1]), 6, 8).reshape(-1)
    segments = [r for r in rows if r[1]]
    rows.clear()
    if not segments:
        return []
    keys, owner, grams = _unpack(segments, 6)
    segments.clear()
    found = []
    piece, mark_piece = ((x % np.uint64(SLICES)).astype(np.uint8) for x in (grams, marks))
    for k in range(SLICES):
        mine = piece == k
        if mine.any():
            found.append(_shared_of(owner[mine], grams[mine], marks[mark_piece == k]))
    del piece, owner, grams
    owner, grams = _unique_pairs(*(np.concatenate(x) for x in zip(*found)))
    # The high 16 bits are lost but for the fragment, so n-grams are known by fragment and low bits from here on.
    grams = _named(grams, np.uint64(part))
    place = _collector(keys, fragments)[owner]
    order = np.argsort(place, kind="stable")
    return [_pack(fragments + to, keys, owner[order[a:b]], grams[order[a:b]]) for to, a, b in _bounds(place[order])]


def _named(low: np.ndarray, part: np.ndarray) -> np.ndarray:
    """64-bit names of n-grams known by their low 48 bits and their fragment; their order is the global one."""
    with np.errstate(over="ignore"):
        return _mix(low ^ part * np.uint64(0x9E3779B97F4A7C15))


def _rename(grams: np.ndarray, fragments: int) -> np.ndarray:
    """Whole hashes named as _count_fragment names them."""
    return _named(grams & np.uint64((1 << 48) - 1), _fragment(grams, fragments))


def _directory_row(part: int, keys: np.ndarray, sids: np.ndarray, sizes: np.ndarray) -> tuple:
    packed = np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 16)[:, :KEY_BYTES].tobytes()
    return part, sids.tobytes(), sizes.astype("<u4").tobytes(), b"", packed, b""


def _directory(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of directory rows, sorted, with their sets' ids and sizes."""
    keys = _wide(b"".join(r[4] for r in rows), KEY_BYTES, 16)
    sids = np.frombuffer(b"".join(r[1] for r in rows), dtype="<u8").reshape(-1, 2)
    sizes = np.frombuffer(b"".join(r[2] for r in rows), dtype="<u4")
    first, number = _distinct_rows(keys)
    if (sids[first][number] != sids).any():
        raise ValueError("two sets share a key: raise KEY_BYTES")
    return keys[first], sids[first], sizes[first]


def _cut_keys(sids: np.ndarray) -> np.ndarray:
    """The keys of whole ids."""
    return sids & np.array([(1 << 64) - 1, (1 << 8 * (KEY_BYTES - 8)) - 1], dtype=np.uint64)


def by_part(fn: Callable[[int, list[tuple]], Iterator[pa.RecordBatch]]) -> Callable:
    """A mapInArrow function called for each value of the first column; equal values are next to each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                row = tuple(c[k].as_py() for c in batch.columns)
                if rows and row[0] != part:
                    yield from fn(part, rows)
                    rows = []
                part = row[0]
                rows.append(row)
            batch = row = None  # what follows may need the room
        if rows:
            yield from fn(part, rows)
        give_back_memory()

    return run


def _dealt(df: DataFrame, parts: int) -> DataFrame:
    """Each part in a partition of its own: no two large parts meet in a task, and nothing is sorted.

    Beyond MOST_TASKS a partition holds a range of parts, sorted.
    """
    of_task = -(-parts // MOST_TASKS)
    if of_task == 1:
        return df.repartitionById(parts, F.col("part"))
    dealt = df.repartitionById(-(-parts // of_task), F.floor(F.col("part") / of_task).cast("int"))
    return dealt.sortWithinPartitions("part")


def shared_sets(documents: DataFrame, total: int, repeated: bytes, size: int, similarity: int, text: str) -> DataFrame:
    """The sets that may link: sid, n, own (n-grams that no other set has) and grams, the others in their order.

    total: the sizes of all rows' sets; repeated: the map of repeated_sets().
    """
    fragments = max(1, -(-total // FRAGMENT_TOKENS))
    texts = documents.select(F.col(text).cast("string").alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast(repeated)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, tokens, bitmap = {}, 0, np.frombuffer(shared.value, dtype=np.uint8)
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                for data in utf8(batch.column(0).slice(start, 200)):
                    grams = ngrams(data, size)
                    if len(grams) and (sid := set_id(grams)) not in sets:
                        sets[sid] = grams
                        tokens += len(grams)
                    if tokens >= CHUNK_TOKENS or len(sets) == 1 << 8 * LOCAL_BYTES:
                        yield _batch(_cut_chunk(sets, fragments, bitmap))
                        sets, tokens = {}, 0
        if sets:
            yield _batch(_cut_chunk(sets, fragments, bitmap))
        give_back_memory()

    def count(part: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if part < fragments:
            yield _batch(_count_fragment(part, rows, fragments))
            return
        out = [_directory_row(part, *_directory([r for r in rows if r[2]]))]
        if common := [r for r in rows if not r[2]]:
            keys, owner, grams = _unpack(common, 8)
            out.append(_pack(part, keys, *_unique_pairs(owner, _rename(grams, fragments))))
        yield _batch(out)

    def collect(part: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        names, sids, sizes = _directory([r for r in rows if r[2]])
        out = []
        if shared := [r for r in rows if not r[2]]:
            keys, owner, grams = _unpack(shared, 8)
            _, both = _distinct_rows(np.concatenate([names, keys]))
            at = np.full(both.max() + 1, -1, dtype=np.int64)
            at[both[: len(sids)]] = np.arange(len(sids))
            row_of = at[both[len(sids) :]]
            if (row_of < 0).any():
                raise ValueError("n-grams of a set that no chunk named: the rows came in another order when read again")
            owner, grams = _unique_pairs(row_of[owner], grams)
            for row, start, end in _bounds(owner):
                n = int(sizes[row])
                if end - start >= needed(n, similarity):
                    out.append((sids[row].tobytes(), n, n - (end - start), grams[start:end].tobytes()))
        columns = list(zip(*out)) if out else [()] * 4
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["sid", "n", "own", "grams"]
        )

    segments = _dealt(texts.mapInArrow(cut, _SEGMENTS), 2 * fragments)
    collecting = segments.mapInArrow(by_part(count), _SEGMENTS).withColumn("part", F.col("part") - fragments)
    partial = _dealt(collecting, fragments)
    return partial.mapInArrow(by_part(collect), "sid binary, n bigint, own bigint, grams binary")


def _size_classes(similarity: int, longest: int) -> np.ndarray:
    """Lower bounds of size classes: sets of that similarity are in the same class or in neighbouring ones."""
    bounds = [1]
    while bounds[-1] <= longest:
        bounds.append(bounds[-1] * 100 // similarity + 1)
    return np.array(bounds)


def buckets(sets: DataFrame, similarity: int) -> DataFrame:
    """Prefix n-grams: gram, size_class, sid, n and code, which orders sets by their share of own n-grams."""
    bounds = _size_classes(similarity, 1 << 40)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        grams, classes, sids, sizes, codes = [], [], [], [], []
        for sid, n, own, packed in zip(*(c.to_pylist() for c in batch.columns)):
            prefix = np.frombuffer(packed, dtype="<i8")[: max(0, n - needed(n, similarity) + 1 - own)]
            level = int(np.searchsorted(bounds, n, side="right"))
            code = own * 1000 // n << 50 | int.from_bytes(sid[8:15], "little") & (1 << 50) - 1
            for size_class in (level, level + 1):
                grams.append(prefix)
                classes += [size_class] * len(prefix)
                sids += [sid] * len(prefix)
                sizes += [n] * len(prefix)
                codes += [code] * len(prefix)
        arrays = [pa.array(np.concatenate(grams)), pa.array(classes, pa.int32()), pa.array(sids, pa.binary())]
        arrays += [pa.array(sizes, pa.int64()), pa.array(codes, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, ["gram", "size_class", "sid", "n", "code"])

    return map_batches(sets, run, "gram bigint, size_class int, sid binary, n bigint, code bigint")


def groups(sets: DataFrame, similarity: int) -> DataFrame:
    """Members of groups: lead (the code of a group's best member), sid, n, code and wide, whether the member meets
    others than the best one in any of the group's buckets."""
    rows = buckets(sets, similarity)
    best = rows.groupBy("gram", "size_class").agg(F.min("code").alias("lead"), F.count("*").alias("met"))
    met = rows.join(best.where("met > 1"), ["gram", "size_class"])
    return met.groupBy("lead", "sid", "n", "code").agg((F.max("met") > 2).alias("wide"))


def _deal(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt and sorted by part, which tells the values of keys."""
    part = F.concat_ws(":", *keys).alias("part")
    rows = df.select(part, *[c for c in df.columns if c not in keys])
    return rows.repartition("part").sortWithinPartitions("part")


def _blocks(tokens: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(tokens / size).cast("int"))


def _block_of(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("sid"), blocks).cast("int")


def _every(blocks: Column) -> Column:
    return F.sequence(F.lit(0), blocks - 1)


def pair_overlaps(members: DataFrame, heads: DataFrame, sets: DataFrame) -> DataFrame:
    """The partial overlaps of each group's best member with its others, a row for each fragment and pair that meet
    there: lead, sid, partial. heads: lead, head (the best member's sid) and tokens."""
    own = members.join(heads.select("lead", "head", _blocks(F.col("tokens"), BLOCK_TOKENS).alias("blocks")), "lead")
    is_head = F.col("sid") == F.col("head")
    blocks = F.when(is_head, _every(F.col("blocks"))).otherwise(F.array(_block_of(F.col("blocks"))))
    rows = own.select("lead", "sid", F.explode(blocks).alias("block"), (~is_head).alias("late")).join(
        sets.select("sid", "grams"), "sid"
    )
    edges = (np.arange(1, PAIR_FRAGMENTS, dtype=np.float64) * (2.0**64 / PAIR_FRAGMENTS)).astype(np.uint64)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for lead, sid, block, late, packed in zip(*(c.to_pylist() for c in batch.columns)):
            grams = np.frombuffer(packed, dtype="<u8")
            bounds = [0, *np.searchsorted(grams, edges).tolist(), len(grams)]
            out += [(lead, block, v, late, sid, packed[8 * a : 8 * b]) for v, (a, b) in enumerate(zip(bounds, bounds[1:])) if b > a]
        columns = list(zip(*out)) if out else [()] * 6
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary())
        names = ["lead", "block", "fragment", "late", "sid", "grams"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    pieces = map_batches(
        rows.select("lead", "sid", "block", "late", "grams"), cut,
        "lead bigint, block int, fragment int, late boolean, sid binary, grams binary",
    )

    def count(part: str, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        head = [row for row in rows if not row[1]]
        others = [row for row in rows if row[1]]
        if not head or not others:
            return
        best = np.frombuffer(head[0][3], dtype="<u8")
        grams = np.frombuffer(b"".join(row[3] for row in others), dtype="<u8")
        at = np.minimum(np.searchsorted(best, grams), len(best) - 1)
        starts = np.cumsum([0, *(len(row[3]) // 8 for row in others[:-1])])
        common = np.add.reduceat((best[at] == grams).astype(np.int64), starts)
        met = np.nonzero(common)[0]
        leads = pa.array(np.full(len(met), int(part.split(":")[0]), dtype=np.int64))
        sids = pa.array([others[k][2] for k in met], pa.binary())
        yield pa.RecordBatch.from_arrays([leads, sids, pa.array(common[met])], ["lead", "sid", "partial"])

    dealt = _deal(pieces.select("lead", "block", "fragment", "late", "sid", "grams"), "lead", "block", "fragment")
    return dealt.mapInArrow(by_part(count), "lead bigint, sid binary, partial bigint")


class _Group:
    """Sets of one task, for which alike() finds those similar to one of them.

    N-grams are cut into PAIR_FRAGMENTS ranges of the global order. A pair's overlap is the sum of its partial overlaps,
    range after range, until no pair can reach the similarity any more. sets: (n, grams).
    """

    def __init__(self, sets: list[tuple[int, bytes]], similarity: int) -> None:
        self.similarity, self.sizes = similarity, np.array([n for n, _ in sets])
        parts = [np.frombuffer(packed, dtype="<u8") for _, packed in sets]
        self.held = np.array(list(map(len, parts)))
        owner, local = np.repeat(np.arange(len(parts)), self.held), np.unique(np.concatenate(parts), return_inverse=True)[1]
        count = int(local.max(initial=0)) + 1
        fragment = local * PAIR_FRAGMENTS // count
        placed = np.bincount(owner * PAIR_FRAGMENTS + fragment, minlength=len(parts) * PAIR_FRAGMENTS)
        self.placed, self.local = placed.reshape(-1, PAIR_FRAGMENTS), local
        self.cuts = [(local[fragment == v], np.concatenate([[0], np.cumsum(self.placed[:, v])])) for v in range(PAIR_FRAGMENTS)]
        self.starts, self.mark = np.concatenate([[0], np.cumsum(self.held)]), np.zeros(count, dtype=np.int32)

    def alike(self, k: int) -> np.ndarray:
        """The numbers of the sets similar to the k-th, without itself."""
        own = self.local[self.starts[k] : self.starts[k + 1]]
        self.mark[own] = 1
        common, rest = np.zeros(len(self.held), dtype=np.int64), self.held.copy()
        for v, (tokens, bounds) in enumerate(self.cuts):
            summed = np.concatenate([[0], np.cumsum(self.mark[tokens])])
            common += summed[bounds[1:]] - summed[bounds[:-1]]
            rest -= self.placed[:, v]
            most = common + np.minimum(rest, rest[k])
            within = 100 * most >= self.similarity * (self.sizes + self.sizes[k] - most)
            within[k] = False
            if not within.any():
                break
        self.mark[own] = 0
        return np.nonzero(within)[0]


def _pairs_batch(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*found)) if found else [(), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["a", "b"])


def rest_links(rest: DataFrame, members: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links a, b that join members in rest to others of their group. rest and members: lead, sid, n; joined members of
    a group are in one component already."""
    blocks = members.groupBy("lead").agg(_blocks(F.sum("n"), GROUP_TOKENS).alias("blocks"))
    late = rest.select("lead", "sid").withColumn("late", F.lit(True))
    own, every = _block_of(F.col("blocks")), _every(F.col("blocks"))
    place = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), F.lit(role).alias("role"))
    # Task i, j compares the late ones of block i (role 0) with all of block j (role 1, or 2 for late ones).
    first = F.transform(every, lambda j: place(own, j, 0))
    others = F.transform(F.filter(every, lambda i: i != own), lambda i: place(i, own, 2))
    joined = F.transform(every, lambda i: place(i, own, 1))
    rows = members.join(blocks, "lead").join(late, ["lead", "sid"], "left").select(
        "lead", "sid", F.inline(F.when(F.col("late"), F.concat(first, others)).otherwise(joined))
    ).join(sets.select("sid", "n", "grams"), "sid")

    def run(_: str, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        asked = [row for row in rows if row[1] == 0]
        if not asked:
            return
        held = asked + [row for row in rows if row[1] > 0]
        group = _Group([(row[3], row[4]) for row in held], similarity)
        first = next((k for k, row in enumerate(held) if row[1] == 1), -1)
        root = np.array([first if row[1] == 1 else k for k, row in enumerate(held)])
        for k in range(len(asked)):
            if first < 0 or root[k] != root[first]:
                joined = np.unique(root[np.append(group.alike(k), k)])
                root[np.isin(root, joined)] = joined.min()
        yield _pairs_batch([(held[root[k]][2], held[k][2]) for k in range(len(held)) if root[k] != k and not (held[k][1] == 1 and root[k] == first)])

    dealt = _deal(rows.select("lead", "i", "j", "role", "sid", "n", "grams"), "lead", "i", "j")
    return dealt.mapInArrow(by_part(run), "a binary, b binary")


def links(sets: DataFrame, similarity: int) -> DataFrame:
    """Links a, b between sids, enough for all components; stored."""
    members = store(groups(sets, similarity), "ngram-groups")
    heads = members.groupBy("lead").agg(
        F.min(F.struct("code", "sid", "n")).alias("best"), F.sum("n").alias("tokens"), F.count("*").alias("k")
    ).where("k > 1").select("lead", "tokens", F.col("best.sid").alias("head"), F.col("best.n").alias("head_n"))
    # Sets whose sizes differ too much can't be similar, whatever they share.
    near = (100 * F.least("n", "head_n") >= similarity * F.greatest("n", "head_n")) | (F.col("sid") == F.col("head"))
    asked = members.join(heads.select("lead", "head", "head_n"), "lead").where(near).select("lead", "sid")
    summed = pair_overlaps(asked, heads, sets).groupBy("lead", "sid").agg(F.sum("partial").alias("common"))
    common = F.coalesce("common", F.lit(0))
    alike = 100 * common >= similarity * (F.col("n") + F.col("head_n") - common)
    tested = store(
        members.join(heads, "lead").where("sid <> head").join(summed, ["lead", "sid"], "left")
        .select("lead", "sid", "n", "head", "wide", alike.alias("alike")),
        "ngram-pairs",
    )
    found = tested.where("alike").select(F.col("head").alias("a"), F.col("sid").alias("b"))
    rest = tested.where("wide and not alike").select("lead", "sid", "n")
    if not rest.isEmpty():
        others = tested.where("wide").join(rest.select("lead").distinct(), "lead", "left_semi").select("lead", "sid", "n")
        found = found.unionByName(rest_links(rest, others, sets, similarity))
    out = store(found.distinct(), "ngram-links")
    discard(members, tested)
    return out


def all_links(sets: DataFrame, similarity: int) -> DataFrame:
    """All links a, b between sids, each once, a the smaller one; stored."""
    members = store(groups(sets, similarity), "ngram-groups")
    counts = members.groupBy("lead").agg(_blocks(F.sum("n"), GROUP_TOKENS).alias("blocks"), F.count("*").alias("k"))
    own = _block_of(F.col("blocks"))
    # One block: a task of its own. More: each pair of blocks is a task, so that every two members meet.
    pairs = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.filter(
            F.transform(_every(F.col("blocks")), lambda b: F.struct(F.least(own, b).alias("i"), F.greatest(own, b).alias("j"))),
            lambda p: p["i"] < p["j"],
        )
    )
    rows = members.join(counts.where("k > 1"), "lead").select("lead", "sid", F.inline(pairs)).join(
        sets.select("sid", "n", "grams"), "sid"
    )

    def run(_: str, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        sids, group = [row[1] for row in rows], _Group([(row[2], row[3]) for row in rows], similarity)
        found = [(sids[k], sids[j]) for k in range(len(sids)) for j in group.alike(k) if j > k]
        yield _pairs_batch([(min(p), max(p)) for p in found])

    dealt = _deal(rows.select("lead", "i", "j", "sid", "n", "grams"), "lead", "i", "j")
    out = store(dealt.mapInArrow(by_part(run), "a binary, b binary").distinct(), "ngram-all-links")
    discard(members)
    return out


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Per node of edges a, b: v and c, the smallest node that it reaches."""
    both = store(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = store(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("c")), name)
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        lower = labels.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        hop = labels.select(F.col("v").alias("c"), F.col("c").alias("far"))
        moved = store(lower.join(hop, "c").select("v", "old", F.least("c", "far").alias("c")), name)
        labels = moved.select("v", "c")
        if moved.where("old <> c").isEmpty():
            return labels


def _prepared(documents: DataFrame, size: int, similarity: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """set_ids of all rows and shared_sets of those with a key, stored."""
    ids = store(set_ids(documents, size, key, text), "ngram-ids")
    total, rows = ids.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    repeated = repeated_sets(ids, rows)
    linkable = documents.where(F.col(key).isNotNull())
    return ids, store(shared_sets(linkable, total, repeated, size, similarity, text), "ngram-sets")


def classes(documents: DataFrame, size: int, similarity: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """set_ids of all rows, and the class of each set of rows with a key that isn't alone: sid and whole (a sid)."""
    ids, sets = _prepared(documents, size, similarity, key, text)
    found = links(sets, similarity)
    discard(sets)
    labels = components(found, "ngram-components")
    return ids, labels.select(F.col("v").alias("sid"), F.col("c").alias("whole"))


def near_duplicates(
    documents: DataFrame, size: int = SHINGLE, similarity: int = SIMILARITY, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: the key, n_shingles and component_id, the smallest key that it reaches by links."""
    ids, labels = classes(documents, size, similarity, key, text)
    # Copies are merged before the classes are: a set with a third of all rows is one row here.
    least = ids.where("sid is not null and key is not null").groupBy("sid").agg(F.min("key").alias("least"))
    named = least.join(labels, "sid", "left").withColumn("whole", F.coalesce("whole", "sid"))
    whole = named.groupBy("whole").agg(F.min("least").alias("first"))
    of_set = named.join(whole, "whole").select("sid", "first")
    own = F.when(F.col("key").isNotNull(), F.coalesce("first", "key"))
    return ids.join(of_set, "sid", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id")
    )


def link_counts(
    documents: DataFrame, size: int = SHINGLE, similarity: int = SIMILARITY, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: the key and n_links, the other rows with a key whose sets are that similar, copies of its own included.

    Every pair of similar distinct sets is tested and emitted once, so a group costs the number of its links.
    """
    ids, sets = _prepared(documents, size, similarity, key, text)
    found = all_links(sets, similarity)
    copies = ids.where("sid is not null and key is not null").groupBy("sid").agg(F.count("*").alias("copies"))
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(copies, F.col("b") == F.col("sid")).groupBy(F.col("a").alias("sid")).agg(F.sum("copies").alias("far"))
    linked = copies.join(others, "sid", "left").select("sid", (F.col("copies") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
    own = F.when(F.col("key").isNotNull(), F.col("n_links"))
    return ids.join(linked, "sid", "left").select(F.col("key").alias(key), F.coalesce(own, F.lit(0)).cast("bigint").alias("n_links"))


def one_of_each(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """documents with one row of each component; rows with a null key or without words stay."""
    ids, labels = classes(documents, SHINGLE, SIMILARITY, key, text)
    rows = ids.where("sid is not null and key is not null").groupBy("sid").agg(F.min(F.struct("key", "mark")).alias("first"))
    whole = rows.join(labels, "sid", "left").groupBy(F.coalesce("whole", "sid").alias("whole"))
    chosen = whole.agg(F.min("first").alias("first")).select("first.*")
    times = ids.groupBy("key", "mark").agg(F.count("*").alias("times"))
    own, mark = fresh(documents, "stay"), fresh(documents, "mark")
    stay = store(
        chosen.join(times, ["key", "mark"]).select(F.col("key").alias(own), F.col("mark").alias(mark), "times"), "ngram-stay"
    )
    of_text = F.xxhash64(documents[text].cast("string"))
    alone = documents[key].isNull() | ~F.coalesce(documents[text].cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    met = lambda part: documents.where(~alone).join(
        part, (documents[key] == F.col(own)) & (of_text == F.col(mark)), "left_semi"
    )
    kept = documents.where(alone).unionByName(met(stay.where("times = 1").drop("times")))
    repeated = stay.where("times > 1").drop("times")
    if not repeated.isEmpty():
        once = met(repeated).withColumn(mark, F.xxhash64(F.col(f"`{text}`").cast("string"))).dropDuplicates([key, mark])
        kept = kept.unionByName(once.drop(mark))
    return kept
