"""Removal of byte strings that an earlier document holds, by suffix arrays over shards.

What must be found: every 50-byte window that also starts in a document with a smaller id. A window's
*key* is the least hash among its 24-byte substrings, a function of the window alone, so equal windows
have equal keys; neighbouring windows mostly share theirs and form a run of some 14 windows, whose text
is the window text plus a few bytes. The job has five steps, all of them Spark shuffles of packed blocks:

1. shards of documents send each distinct key once (8 bytes for some 14 of text);
2. key buckets answer which keys occur in two documents; nothing else can repeat;
3. every document shard sorts all that can repeat in it to a suffix array by Larsson-Sadakane refinement,
   gets common prefixes by Kasai's rule, and so knows the shard's first document of each window; what an
   earlier document of the shard holds is decided, the texts of the other runs are sent, packed;
4. across shards, the texts of a bucket, in text shards of bounded bytes ordered by key, get suffix arrays and
   common prefixes likewise; where a key runs over a text shard's edge, the sorted windows of the two are
   merged by binary search;
5. document shards mark the windows whose first document is smaller, and cut the covered bytes.

A passage that a third of the corpus shares is one text a shard in step 3. A key with very many different
texts (the edge of such a passage) is dealt by single windows instead, so no bucket gathers it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a window, and of the substrings whose least hash is its key.
WINDOW, GRAM = 50, 24
#: Text bytes of a document shard; of a piece hashed at once; of a text shard.
SHARD_BYTES, CHUNK_BYTES, TEXT_BYTES = 8 << 20, 1 << 19, 1 << 20
#: Corpus bytes whose keys, and whose repeated texts, share a bucket: few buckets pack many keys of a shard in a row.
KEY_BUCKET_BYTES, TEXT_BUCKET_BYTES = 32 << 20, 16 << 20
#: Windows of a document shard that one suffix array takes; documents beyond them get another.
SLICE_WINDOWS = 1 << 20
#: A key with more runs in one document shard, or in more shards, is dealt by single windows.
HOT_RUNS, HOT_SHARDS = 256, 1024

_MULT = np.uint64(0x9E3779B97F4A7C15)


def _window_keys(data: np.ndarray) -> np.ndarray:
    """The key of the window at each start, by doubling: substring hashes, then sliding minima."""
    part, size, power = data.astype(np.uint64) + np.uint64(1), 1, _MULT
    done, covered, left = None, 0, GRAM
    while left:
        if left & 1:
            if done is None:
                done, covered = part, size
            else:
                many = min(len(done), len(part) - covered)
                done, covered = done[:many] * power + part[covered : covered + many], covered + size
        left >>= 1
        if left:
            part = part[:-size] * power + part[size:]
            power, size = power * power, 2 * size
    done = (done ^ (done >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    done ^= done >> np.uint64(32)
    wide, span = WINDOW - GRAM + 1, 1
    while 2 * span <= wide:
        done, span = np.minimum(done[:-span], done[span:]), 2 * span
    if span < wide:
        done = np.minimum(done[: len(done) - (wide - span)], done[wide - span :])
    return done & ~np.uint64(3)  # two bits are for flags


def runs_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, first window, last window, key) of every run, in order, in arrays chunk by chunk.

    A text longer than a chunk is hashed in pieces that overlap by a window; a run cut there is two runs.
    """
    with np.errstate(over="ignore"):
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for k, text in enumerate(texts):
            for at in range(0, len(text) - WINDOW + 1, CHUNK_BYTES):
                piece = text[at : at + CHUNK_BYTES + WINDOW - 1]
                held.append((k, at, piece))
                size += len(piece)
                if size >= CHUNK_BYTES:
                    yield _chunk_runs(held)
                    held, size = [], 0
        if held:
            yield _chunk_runs(held)


def _chunk_runs(held: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
    keys = _window_keys(data)
    sizes = np.fromiter((len(p) for _, _, p in held), np.int64, len(held))
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    step = np.zeros(len(keys) + 1, np.int8)
    step[begins] = 1
    step[begins + sizes - WINDOW + 1] -= 1
    whole = np.cumsum(step[:-1]).astype(bool)  # windows within one piece
    first, last = whole.copy(), whole.copy()
    changed = keys[1:] != keys[:-1]
    first[1:] &= ~whole[:-1] | changed
    last[:-1] &= ~whole[1:] | changed
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    piece = np.searchsorted(begins, a, side="right") - 1
    text = np.fromiter((k for k, _, _ in held), np.int64, len(held))[piece]
    shift = np.fromiter((at for _, at, _ in held), np.int64, len(held))[piece] - begins[piece]
    return text, a + shift, b + shift, keys[a]


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes at least, by Larsson-Sadakane refinement.

    The first order is by eight bytes; each round doubles it and touches only groups not yet in order,
    whose members are compared by the group numbers of the suffixes that many bytes on.
    """
    n = len(data)
    words = _words(data)
    order = np.argsort(words).astype(np.int32)
    ordered = words[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    del ordered
    group = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), np.int32(0)))
    rank = np.empty(n + 1, np.int32)
    rank[order], rank[n] = group, -1
    single = new & np.concatenate((new[1:], [True]))
    slots, done = np.flatnonzero(~single), 8
    while len(slots) and done < depth:
        members = order[slots]
        here, there = rank[members].astype(np.int64), rank[np.minimum(members.astype(np.int64) + done, n)].astype(np.int64)
        both = (here << 32) | (there + 1)
        by = np.argsort(both)
        members, both = members[by], both[by]
        order[slots] = members
        new = np.concatenate(([True], both[1:] != both[:-1]))
        group = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        rank[members] = group
        slots = slots[~(new & np.concatenate((new[1:], [True])))]
        done *= 2
    return order


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as one big-endian number, zeros beyond the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data),), ">u8", padded, strides=(1,)).astype(np.uint64)


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``order``, up to ``most``, by Kasai's rule.

    Walking the text, a prefix shrinks by one from place to place if its neighbour moves along; where another
    takes its place, which an order of limited depth allows to be a worse one, it starts anew. Strips of the text
    are walked in step, one lane each, and prefixes grow by eight bytes a comparison.
    """
    n, strip = len(data), 128
    words = np.concatenate((_words(data), np.zeros(most + 8, np.uint64)))
    lanes = -(-n // strip)
    before = np.full(lanes * strip, -1, np.int32)
    before[order[1:]] = order[:-1]
    steps = np.ascontiguousarray(before.reshape(lanes, strip).T)  # what the lanes read at one step lies side by side
    begins = np.arange(0, n, strip)
    out = np.zeros((strip, lanes), np.int32)
    length, last = np.zeros(lanes, np.int64), np.full(lanes, -2, np.int32)
    for k, other in enumerate(steps):
        length -= 1
        length[(other != last + 1) | (length < 0) | (other < 0)] = 0
        last = other
        live = np.flatnonzero((other >= 0) & (length < most))
        own = length[live]
        a, b = begins[live] + k + own, other[live] + own
        while len(live):
            differ = words[a] ^ words[b]
            equal, odd = np.full(len(live), 8), np.flatnonzero(differ)
            high = differ[odd]
            equal[odd] = sum((high < np.uint64(1 << bits)).astype(np.int64) for bits in range(8, 64, 8))
            room = n - np.maximum(a, b)
            own = own + np.minimum(equal, room)
            length[live] = own
            more = (equal == 8) & (room > 8) & (own < most)
            live, own, a, b = live[more], own[more], a[more] + 8, b[more] + 8
        np.minimum(length, most, out=length)
        out[k] = length
    return out.T.ravel()[:n][order]


def first_documents(strings: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """For each string the least of ``docs`` over all strings that hold its window, window by window."""
    data = np.frombuffer(b"".join(strings), np.uint8)
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(strings)), sizes)
    order = suffix_array(data, WINDOW)
    prefix = common_prefixes(data, order, WINDOW)
    none = np.iinfo(np.int64).max
    whole = np.arange(len(data)) + WINDOW <= ends[owner]
    least = np.where(whole, docs[owner], none)[order]
    heads = np.flatnonzero(prefix < WINDOW)
    least = np.minimum.reduceat(least, heads)
    first = np.empty(len(data), np.int64)
    first[order] = np.repeat(least, np.diff(np.append(heads, len(data))))
    return [first[e - s : e - WINDOW + 1] for s, e in zip(sizes, ends, strict=True)]


def decided_runs(texts: list[bytes], docs: np.ndarray, text: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether all windows of a run (text number, first and last window) stand in a document of a smaller id.

    Slices of documents of bounded size are sorted one by one; what repeats across slices is left to the buckets,
    and a slice of one document decides nothing.
    """
    done, own, room = np.zeros(len(text), bool), np.bincount(text, last - first + 1), 0
    cuts = []
    for k in np.unique(text):
        if room and room + own[k] > SLICE_WINDOWS:
            cuts.append(k)
            room = 0
        room += own[k]
    edges = [0, *np.searchsorted(text, cuts).tolist(), len(text)]
    for begin, end in zip(edges[:-1], edges[1:], strict=True):
        low, high = text[begin], text[end - 1] + 1
        if docs[low] != docs[high - 1]:
            part = slice(begin, end)
            done[part] = _decided(texts[low:high], docs[low:high], text[part] - low, first[part], last[part])
    return done


def _decided(texts: list[bytes], docs: np.ndarray, text: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """``decided_runs`` of one slice: one suffix array holds the bytes of all runs, each byte once."""
    whole = np.frombuffer(b"".join(texts), np.uint8)
    base = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
    start, end = base[text] + first, base[text] + last + 1

    def covered(ends: np.ndarray) -> np.ndarray:
        step = np.bincount(start, minlength=len(whole) + 1)
        step -= np.bincount(ends, minlength=len(whole) + 1)
        return np.cumsum(step, out=step)[: len(whole)] > 0

    on = covered(end + WINDOW - 1)
    place = np.cumsum(on, dtype=np.int32) - 1
    data, window = whole[on], covered(end)[on]
    owner = docs[np.searchsorted(base, np.flatnonzero(on), side="right") - 1]
    order = suffix_array(data, WINDOW)
    heads = np.flatnonzero(common_prefixes(data, order, WINDOW) < WINDOW)
    least = np.minimum.reduceat(np.where(window, owner, np.iinfo(np.int64).max)[order], heads)
    earlier = np.empty(len(data), bool)
    earlier[order] = np.repeat(least, np.diff(np.append(heads, len(data)))) < owner[order]
    upto = np.concatenate(([0], np.cumsum(earlier)))
    return upto[place[start] + last - first + 1] - upto[place[start]] == last - first + 1


def merge_shards(left: dict[bytes, int], right: dict[bytes, int]) -> None:
    """Give equal windows of two shards the lesser document, by binary search in the sorted windows."""
    if not left or not right:
        return
    a, b = np.array(sorted(left), f"V{WINDOW}").view(f"S{WINDOW}"), np.array(sorted(right), f"V{WINDOW}").view(f"S{WINDOW}")
    at = np.searchsorted(a, b)
    raw_a, raw_b = a.view(np.uint8).reshape(-1, WINDOW), b.view(np.uint8).reshape(-1, WINDOW)
    inside = np.flatnonzero(at < len(a))
    same = inside[(raw_a[at[inside]] == raw_b[inside]).all(axis=1)]
    for k in same:
        w = raw_b[k].tobytes()
        left[w] = right[w] = min(left[w], right[w])


def window_firsts(strings: list[bytes], keys: np.ndarray, docs: np.ndarray, shard: int = TEXT_BYTES) -> list[np.ndarray]:
    """``first_documents`` of strings in the order of their keys, in shards of bounded text.

    Equal windows have equal keys, so shards can share windows only of the keys at their edges.
    """
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    part = (np.cumsum(sizes) - sizes) // shard
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    bounds = list(zip(cuts, np.append(cuts[1:], len(strings)), strict=True))
    out: list[np.ndarray] = []
    for s, e in bounds:
        out += first_documents(strings[s:e], docs[s:e])
    edge = {int(keys[e - 1]) for (_, e) in bounds[:-1] if keys[e - 1] == keys[e]}
    for key in edge:
        own = np.flatnonzero(keys == key)
        lists: list[tuple[np.ndarray, dict[bytes, int]]] = []
        for s, e in bounds:
            here = own[(own >= s) & (own < e)]
            if len(here):
                seen: dict[bytes, int] = {}
                for k in here:
                    for j, d in enumerate(out[k]):
                        seen[strings[k][j : j + WINDOW]] = int(d)
                lists.append((here, seen))
        for i, (_, x) in enumerate(lists):
            for _, y in lists[i + 1 :]:
                merge_shards(x, y)
        for _ in range(2):  # the least has met every list after a way forth and one back
            for i in range(len(lists) - 1, 0, -1):
                merge_shards(lists[0][1], lists[i][1])
        for here, seen in lists:
            for k in here:
                out[k] = np.array([seen[strings[k][j : j + WINDOW]] for j in range(len(out[k]))], np.int64)
    return out


def _sorted_texts(table: pa.Table) -> tuple[list[int], list[bytes], np.ndarray]:
    """Ids, texts and order of a shard's rows; the order does not depend on how they arrived."""
    ids, texts = table.column("doc_id").to_pylist(), table.column("body").to_pylist()
    order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k]))
    return [ids[k] for k in order], [texts[k] for k in order], np.array(order)


def _by_bucket(shard: int, buckets: int, bucket: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k in range(buckets):
        if edge[k] < edge[k + 1]:
            yield k, shard, values[order[edge[k] : edge[k + 1]]].tobytes()


def _send_keys(buckets: int):
    """Step 1: each distinct key of a shard; flag 1: in two of its documents, flag 2: in very many runs."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        ids, texts, _ = _sorted_texts(table)
        number = np.unique(np.array(ids, np.int64), return_inverse=True)[1]
        keys, docs = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for text, _, _, key in runs_of(texts):
            keys.append(key)
            docs.append(number[text])
        key, doc = np.concatenate(keys), np.concatenate(docs)
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))[: len(key)]
        tail = np.append(head[1:], len(key)) - 1 if len(key) else head
        flags = (doc[head] != doc[tail]).astype(np.uint64) | ((tail - head >= HOT_RUNS).astype(np.uint64) << np.uint64(1))
        own = key[head] | flags
        rows = list(_by_bucket(shard, buckets, ((own >> np.uint64(2)) % np.uint64(buckets)).astype(np.int64), own))
        return _table(rows, [("bucket", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary())])

    return run


def _table(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table({n: pa.array(c, t) for c, (n, t) in zip(columns, fields, strict=True)})


def _repeated_keys(table: pa.Table) -> pa.Table:
    """Step 2: to each shard those of its keys that two documents hold; flag 2 on those to deal by window."""
    shards = table.column("shard").to_pylist()
    lists = [np.frombuffer(b, np.uint64) for b in table.column("keys").to_pylist()]
    flagged = np.concatenate(lists)
    bare = flagged & ~np.uint64(3)
    known, inverse, count = np.unique(bare, return_inverse=True, return_counts=True)
    many, hot = count > 1, count > HOT_SHARDS
    np.logical_or.at(many, inverse, (flagged & np.uint64(1)).astype(bool))
    np.logical_or.at(hot, inverse, (flagged & np.uint64(2)).astype(bool))
    answer = (bare | (hot[inverse].astype(np.uint64) << np.uint64(1)), many[inverse])
    rows, at = [], 0
    for shard, own in zip(shards, lists, strict=True):
        upto = at + len(own)
        chosen = answer[0][at:upto][answer[1][at:upto]]
        if len(chosen):
            rows.append((shard, 0, chosen.tobytes(), None, None))
        at = upto
    return _table(rows, _ANSWER)


_ANSWER = [("shard", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("firsts", pa.binary()), ("masks", pa.binary())]
_ANSWER_DDL = "shard int, kind int, keys binary, firsts binary, masks binary"


def _repeated_runs(texts: list[bytes], live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text numbers, first windows, last windows, keys) of the runs whose key is among ``live``, in order.

    The runs of keys with flag 2 come as single windows.
    """
    bare = live & ~np.uint64(3)
    order = np.argsort(bare)
    bare, hot = bare[order], (live[order] & np.uint64(2)).astype(bool)
    found = [(np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)]
    if len(bare):
        for text, a, b, key in runs_of(texts):
            at = np.minimum(np.searchsorted(bare, key), len(bare) - 1)
            chosen = np.flatnonzero(bare[at] == key)
            text, a, b, key, single = text[chosen], a[chosen], b[chosen], key[chosen], hot[at[chosen]]
            many = np.where(single, b - a + 1, 1)
            shift = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            text, a, b, key, single = (np.repeat(x, many) for x in (text, a, b, key, single))
            found.append((text, a + shift, np.where(single, a + shift, b), key))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _pack(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _unpack(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _live(aux: pa.Table) -> np.ndarray:
    found = [np.frombuffer(x, np.uint64) for x, k in zip(aux.column("keys").to_pylist(), aux.column("kind").to_pylist(), strict=True) if k == 0]
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def _send_texts(buckets: int):
    """Step 3: the distinct texts of a shard's repeated runs, with their number, key and least document."""
    import xxhash

    def run(docs: pa.Table, aux: pa.Table) -> pa.Table:
        fields = [("bucket", pa.int32()), ("shard", pa.int32()), ("numbers", pa.binary()), ("keys", pa.binary()), ("docs", pa.binary()), ("sizes", pa.binary()), ("texts", pa.binary())]
        live = _live(aux)
        if not docs.num_rows or not len(live):
            return _table([], fields)
        shard = docs.column("shard")[0].as_py()
        ids, texts, _ = _sorted_texts(docs)
        text_of, first, last, key_of = _repeated_runs(texts, live)
        decided = decided_runs(texts, np.array(ids, np.int64), text_of, first, last) if len(text_of) else np.empty(0, bool)
        least: dict[bytes, tuple[int, int]] = {}
        for k, s, e, key in zip(*(x[~decided].tolist() for x in (text_of, first, last, key_of)), strict=True):
            least.setdefault(texts[k][s : e + WINDOW], (ids[k], key))  # documents come in ascending order
        hot = {int(x) & ~3 for x in live if int(x) & 2}
        deal: dict[int, list[tuple[int, int, int, bytes]]] = {}
        for number, (text, (doc, key)) in enumerate(least.items()):
            bucket = (xxhash.xxh64_intdigest(text) if key in hot else key >> 2) % buckets
            deal.setdefault(bucket, []).append((number, key, doc, text))
        # which runs are decided goes to this shard's last step by way of a bucket
        rows = [(shard % buckets, shard, None, None, None, None, _pack(np.packbits(decided).tobytes()))]
        for bucket, own in deal.items():
            number, key, doc, text = zip(*own, strict=True)
            rows.append((
                bucket, shard, *map(_pack, (
                    np.array(number, np.int32).tobytes(), (np.array(key, np.uint64) >> np.uint64(32)).astype(np.uint32).tobytes(),
                    np.array(doc, np.int64).tobytes(), np.fromiter(map(len, text), np.int32).tobytes(), b"".join(text),
                )),
            ))
        return _table(rows, fields)

    return run


def _first_of_windows(table: pa.Table) -> pa.Table:
    """Step 4: the first document of every text and, where windows of it are earlier still, a mask of those."""
    number: dict[bytes, int] = {}
    key_of: list[int] = []
    doc_of: list[int] = []
    asked: list[tuple[int, np.ndarray, np.ndarray, list[int]]] = []
    columns = [table.column(n).to_pylist() for n in ("shard", "numbers", "keys", "docs", "sizes", "texts")]
    rows = []
    for shard, *packed in zip(*columns, strict=True):
        if packed[0] is None:
            rows.append((shard, 2, packed[-1], None, None))
            continue
        numbers, keys, docs, sizes, texts = map(_unpack, packed)
        own_docs, ends, at = np.frombuffer(docs, np.int64), np.cumsum(np.frombuffer(sizes, np.int32)), 0
        mine = []
        for doc, key, end in zip(own_docs.tolist(), np.frombuffer(keys, np.uint32).tolist(), ends.tolist(), strict=True):
            text, at = texts[at:end], end
            k = number.setdefault(text, len(number))
            if k == len(key_of):
                key_of.append(key)
                doc_of.append(doc)
            elif doc < doc_of[k]:
                doc_of[k] = doc
            mine.append(k)
        asked.append((shard, np.frombuffer(numbers, np.int32), own_docs, mine))
    del columns
    # the upper half of a key will do: equal windows have equal halves
    keys, docs = np.array(key_of, np.uint32), np.array(doc_of, np.int64)
    order = np.argsort(keys, kind="stable")
    every = list(number)
    firsts = window_firsts([every[k] for k in order], keys[order], docs[order]) if every else []
    earlier: dict[int, bytes] = {}
    for k, first in zip(order.tolist(), firsts, strict=True):
        mask = first < docs[k]
        if mask.any():
            earlier[k] = np.packbits(mask).tobytes()
    for shard, numbers, own, mine in asked:
        told = [i for i, k in enumerate(mine) if docs[k] < own[i] or k in earlier]
        if told:
            kept = [mine[i] for i in told]
            masks = [earlier.get(k, b"") for k in kept]
            sizes = np.fromiter(map(len, masks), np.int32, len(masks)).tobytes()
            rows.append((shard, 1, numbers[told].tobytes(), docs[kept].tobytes(), sizes + b"".join(masks)))
    return _table(rows, _ANSWER)


def _cut_texts(docs: pa.Table, aux: pa.Table) -> pa.Table:
    """Step 5: spans to remove and the bytes that stay, for each document of a shard."""
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())]
    if not docs.num_rows:
        return _table([], fields)
    ids, texts, _ = _sorted_texts(docs)
    told: dict[int, tuple[int, bytes]] = {}
    text_of, first_of, last_of, _ = _repeated_runs(texts, _live(aux))
    decided = np.zeros(len(text_of), bool)
    for kind, numbers, firsts, masks in zip(*(aux.column(n).to_pylist() for n in ("kind", "keys", "firsts", "masks")), strict=True):
        if kind == 1:
            numbers, firsts = np.frombuffer(numbers, np.int32).tolist(), np.frombuffer(firsts, np.int64).tolist()
            at = 4 * len(numbers)
            for number, first, size in zip(numbers, firsts, np.frombuffer(masks[:at], np.int32).tolist(), strict=True):
                told[number] = (first, masks[at : at + size])
                at += size
        elif kind == 2:
            decided = np.unpackbits(np.frombuffer(_unpack(numbers), np.uint8), count=len(text_of)).astype(bool)
    seen: dict[bytes, tuple[int, int]] = {}  # run text: its number and least document here
    cuts: dict[int, list[tuple[int, int]]] = {}
    for k, s, e, known in zip(*(x.tolist() for x in (text_of, first_of, last_of, decided)), strict=True):
        if known:
            _add(cuts.setdefault(k, []), s, e + WINDOW)
            continue
        number, own = seen.setdefault(texts[k][s : e + WINDOW], (len(seen), ids[k]))
        first, mask = told.get(number, (own, b""))
        if ids[k] > first:
            _add(cuts.setdefault(k, []), s, e + WINDOW)
        elif mask:
            for w in np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8))).tolist():
                _add(cuts.setdefault(k, []), s + w, s + w + WINDOW)
    rows = []
    for k, (doc, text) in enumerate(zip(ids, texts, strict=True)):
        spans, kept, at = cuts.get(k, []), [], 0
        for s, e in spans:
            kept.append(text[at:s])
            at = e
        rows.append((doc, len(text), [{"start": s, "end": e} for s, e in spans], b"".join(kept) + text[at:]))
    return _table(rows, fields)


def _add(spans: list[tuple[int, int]], start: int, end: int) -> None:
    """Append a span that starts no earlier than the last one, merging the two if they touch."""
    if spans and start <= spans[-1][1]:
        spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
    else:
        spans.append((start, end))


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for every row: the maximal removed byte runs and the bytes that stay.

    Texts are UTF-8 bytes, whole, whatever their length; null is the empty text. Rows that share a doc_id
    do not remove each other's bytes; they are dealt to shards by doc_id and text, so that only rows equal in
    both are sure to meet in a shard. Rows without a doc_id are neither cut nor compared. Extra columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ident = F.col(f"`{doc_id}`")
    rows = docs.select(ident.cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("body"))
    total = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    some = lambda size: max(-(-total // size), spark.sparkContext.defaultParallelism)
    shards, key_buckets, text_buckets = some(SHARD_BYTES), some(KEY_BUCKET_BYTES), some(TEXT_BUCKET_BYTES)
    # the shuffle of texts to shards is planned once and reused by all three readers
    known = rows.where("doc_id is not null").withColumn("shard", F.pmod(F.xxhash64("doc_id", "body"), F.lit(shards)).cast("int"))
    keys = known.groupBy("shard").applyInArrow(_send_keys(key_buckets), "bucket int, shard int, keys binary")
    repeated = keys.groupBy("bucket").applyInArrow(_repeated_keys, _ANSWER_DDL)
    texts = (
        known.groupBy("shard")
        .cogroup(repeated.groupBy("shard"))
        .applyInArrow(_send_texts(text_buckets), "bucket int, shard int, numbers binary, keys binary, docs binary, sizes binary, texts binary")
    )
    firsts = texts.groupBy("bucket").applyInArrow(_first_of_windows, _ANSWER_DDL)
    done = (
        known.groupBy("shard")
        .cogroup(repeated.unionByName(firsts).groupBy("shard"))
        .applyInArrow(_cut_texts, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    )
    free = rows.where("doc_id is null").select(
        "doc_id", F.octet_length("body").cast("long").alias("n_bytes"),
        F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"), F.col("body").alias("kept"),
    )
    return done.unionByName(free)
