"""Near duplicates by SimHash, linked by meet-in-the-middle ball hashing.

Two fingerprints at distance d meet in a common variant if both emit all variants within d / 2. The
radius is 3, so half of it leaves one bit over: the 64 bits are cut into thirds, and each third is left
out in turn. Of three differing bits at least one lies in some third, and with that third left out two at
most remain, which balls of radius 1 bring together: 3 * (1 + 64 * 2 / 3) = 131 variants a fingerprint.
The variants are shuffled, sorted in their partitions and read as a stream; colliding fingerprints are
verified by their whole 64 bits, and each bucket gives a spanning forest of its links, never all its pairs.

``simhash_components`` links by one fingerprint of word shingles. ``keep_one``, for pipelines, has to find
copies of which 0.8 of the five-word shingles agree, and those differ in some ten bits of a shingle
fingerprint. It searches with a fingerprint of single words, numbered by occurrence, which scattered edits
hardly move, and with bands of least shingle hashes, whose chance depends on the similarity alone and not on
where the edits are. Links are verified by their two whole sets of five-word shingles: first those of the balls
and of neighbours in each bucket of a band, then those of all other pairs in a bucket, where the sets lie side by
side. Such pairs are never rows: a bucket gives one link for each two groups that it joins.

Equal fingerprints are collapsed first, so groups of copies of any size add one fingerprint. A bucket's
distinct fingerprints agree, but for one bit, outside one third; it is compared in blocks of fixed memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradelens.llm.common import cut
from tradelens.llm.components import components

SEED, RADIUS = 42, 3
#: Bit ranges of the thirds.
THIRDS = ((0, 21), (21, 42), (42, 64))
#: Buckets up to SMALL are compared by shifts of the whole batch, larger ones as matrices of BLOCK rows.
SMALL, BLOCK = 8, 1024

_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The hash of every word shingle of a text in order; a text of fewer words is one shingle."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    many = len(words) - shingle + 1
    return np.fromiter(
        (xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[:many].tolist(), ends[shingle - 1 :].tolist(), strict=True)),
        np.uint64, many,
    )


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles."""
    return _fingerprint_of(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed long; null and empty texts have 0."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def fps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(fps, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _fingerprint_of(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the ``hashes``."""
    spread = _SPREAD[np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)]  # a byte a bit: sums of up to 255 rows fit
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 255):
        ones += spread[k : k + 255].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def word_fingerprint(text: str | None) -> int:
    """The SimHash of a text's words, the n-th occurrence of a word being a feature of its own."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    seen: dict[bytes, int] = {}
    hashes = []
    for w in words:
        n = seen[w] = seen.get(w, 0) + 1
        hashes.append(xxh64_intdigest(b"%b:%d" % (w, n), SEED))
    return _fingerprint_of(np.array(hashes, np.uint64))


def _ball(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, ...) to (key, fp, ...) for every variant of every fingerprint."""
    full = np.uint64(2**64 - 1)
    masks, flips = [], []
    for k, (low, high) in enumerate(THIRDS):
        out = sum(1 << b for b in range(low, high))
        tag = (k + 1) << low  # two of the bits that are left out tell the third
        bits = [0] + [1 << b for b in range(64) if not low <= b < high]
        masks += [full ^ np.uint64(out)] * len(bits)
        flips += [np.uint64(tag | b) for b in bits]
    masks, flips = np.array(masks, np.uint64), np.array(flips, np.uint64)
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            fps = part.column(0).to_numpy(zero_copy_only=False)
            keys = ((fps.view(np.uint64)[:, None] & masks) ^ flips).ravel()
            keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            take = pa.array(np.repeat(np.arange(part.num_rows), len(masks)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), *(c.take(take) for c in part.columns)], names=["key", *part.schema.names]
            )


def _close(x: np.ndarray, y: np.ndarray, check: int | None) -> np.ndarray:
    """Whether rows of (fp[, check]) link: within the radius, and within ``check`` bits."""
    near = np.bitwise_count(x[..., 0] ^ y[..., 0]) <= RADIUS
    return near if check is None else near & (np.bitwise_count(x[..., 1] ^ y[..., 1]) <= check)


def _forest(rows: np.ndarray, check: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Star links (member, least member) of the linked parts among distinct ``rows``, as row numbers."""
    near = _close(rows[:, None], rows[None, :], check)
    label = np.arange(len(rows))
    while True:
        new = np.where(near, label[None, :], len(rows)).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(rows)))
    return moved, label[moved]


def _bucket_links(keys: np.ndarray, rows: np.ndarray, check: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Verified links within runs of equal ``keys``, as row numbers; ``rows`` are distinct in a run."""
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    sizes = np.diff(edge)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    small = np.repeat(sizes <= SMALL, sizes)
    for shift in range(1, SMALL):
        at = np.flatnonzero(small[shift:] & (keys[shift:] == keys[:-shift]))
        if not len(at):
            break
        at = at[_close(rows[at], rows[at + shift], check)]
        a.append(at + shift)
        b.append(at)
    for k in np.flatnonzero(sizes > SMALL):
        blocks = [np.arange(i, min(i + BLOCK, edge[k + 1])) for i in range(edge[k], edge[k + 1], BLOCK)]
        for i, x in enumerate(blocks):
            for y in blocks[i + 1 :] if len(blocks) > 1 else [x[:0]]:
                both = np.concatenate((x, y))
                p, q = _forest(rows[both], check)
                a.append(both[p])
                b.append(both[q])
    return np.concatenate(a), np.concatenate(b)


def _links(check: int | None):
    """Arrow map from sorted (key, fp[, check]) to pairs of linked rows; reads buckets as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 1 if check is None else 2
        held_k, held = np.empty(0, np.int64), np.empty((0, width), np.uint64)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def found(keys: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
            a, b = _bucket_links(keys, rows, check)
            both = np.unique(np.concatenate((rows[a], rows[b]), axis=1), axis=0).view(np.int64)
            names = ["a", "ac", "b", "bc"] if width == 2 else ["a", "b"]
            return pa.RecordBatch.from_arrays([pa.array(both[:, k]) for k in range(both.shape[1])], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            rows = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for k in range(1, width + 1)]
            waiting.append((keys, np.stack(rows, axis=1)))
            if keys[0] == keys[-1] and waiting[0][0][0] == keys[-1]:
                continue  # one bucket so far
            keys = np.concatenate([held_k, *(x for x, _ in waiting)])
            rows = np.concatenate([held, *(x for _, x in waiting)])
            waiting = []
            whole = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
            held_k, held = keys[whole:], rows[whole:]
            yield found(keys[:whole], rows[:whole])
        keys = np.concatenate([held_k, *(x for x, _ in waiting)])
        if len(keys):
            yield found(keys, np.concatenate([held, *(x for _, x in waiting)]))

    return run


def ball_links(distinct: DataFrame, check: int | None = None) -> DataFrame:
    """Links among distinct rows (fp), enough to connect all within the radius: (a, b).

    With ``check`` rows are (fp, check), linked only if their checks differ in at most so many bits too:
    (a, ac, b, bc).
    """
    names = ["fp"] if check is None else ["fp", "check"]
    variants = distinct.select(*names).mapInArrow(_ball, "key long, fp long" + ("" if check is None else ", check long"))
    dealt = variants.repartition("key").sortWithinPartitions("key", *names)
    out = "a long, b long" if check is None else "a long, ac long, b long, bc long"
    return dealt.mapInArrow(_links(check), out).distinct()


def simhash_components(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    Fingerprints within ``RADIUS`` bits link; ``component_id`` is the least doc_id that links reach, the
    row's own included. Texts without words (null, empty, blank) have fingerprint 0 and link like others;
    equal texts share a fingerprint; texts of any length are hashed whole. Rows without a doc_id link but
    give no id, and a component of such rows alone has a null id. Repeated rows are returned one by one.
    An empty table gives an empty result; extra columns are ignored.
    """
    fps = cut(fingerprints(docs, shingle, doc_id, text))
    own = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = cut(components(ball_links(own)))
    rooted = own.join(roots, own["fp"] == roots["node"], "left").select(
        own["fp"], "least_id", F.coalesce("root", own["fp"]).alias("root")
    )
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = rooted.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return fps.join(classes.hint("merge"), "fp").select("doc_id", "fp", "component_id")


#: Documents of one group share SIMILAR of their five-word shingles. CHECK only sorts out hopeless pairs before
#: that is counted: at 0.8 shingle fingerprints differ in 9.7 of 64 bits on average with a deviation of 2.9.
SHINGLE, SIMILAR, CHECK = 5, 0.8, 24
#: Bands of least hashes. Two documents share a band with the chance 1 - (1 - J^WIDE)^BANDS: 0.9996 at 0.8.
BANDS, WIDE = 20, 5
_MIX = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * WIDE), np.uint64) | np.array([[0], [1]], np.uint64)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key of every band of the least values of ``hashes``, however edits are spread over the text."""
    least = np.full(BANDS * WIDE, 2**64 - 1, np.uint64)
    for k in range(0, len(hashes), 512):
        least = np.minimum(least, ((hashes[k : k + 512, None] ^ _MIX[0]) * _MIX[1]).min(axis=0))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(WIDE):
        keys = (keys ^ least[k::WIDE]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys


def _set_id(distinct: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(distinct.tobytes(), SEED) if len(distinct) else 0


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, s, n, fp, check, bands) of every row: id and size of its shingle set, the fingerprints of its
    words and of its shingles, and the band keys (none for a text without words)."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.zeros((batch.num_rows, 4), np.uint64)
            bands = []
            for k, body in enumerate(batch.column(1)):
                hashes = shingle_hashes(body.as_py(), SHINGLE)
                distinct = np.unique(hashes)
                made[k] = (_set_id(distinct), len(distinct), word_fingerprint(body.as_py()), _fingerprint_of(hashes))
                bands.append(band_keys(distinct).view(np.int64) if len(distinct) else [])
            columns = [pa.array(np.ascontiguousarray(made[:, k]).view(np.int64)) for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "s", "n", "fp", "check", "bands"]
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(signed, f"doc_id {kind}, s long, n long, fp long, check long, bands array<long>")


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to (s, hashes): the id and the distinct hashes of its shingles."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            sets = [np.unique(shingle_hashes(x.as_py(), SHINGLE)) for x in batch.column(0).slice(at, 256)]
            ids = np.array([_set_id(x) for x in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["s", "hashes"])


#: Up to so many ids, some 100 MB in a task, the set of them is broadcast and no text is shuffled.
BROADCAST_IDS = 2_000_000


def _sized(ids: DataFrame) -> DataFrame:
    ids = cut(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _sets(sought: DataFrame, own: DataFrame, texts: DataFrame) -> DataFrame:
    """(s, hashes) of the set ids ``sought(s)``; only the texts that have them are read on."""
    ids = _sized(sought.join(own.select("s", "doc_id"), "s").select("doc_id").distinct())
    made = texts.join(ids, "doc_id", "left_semi").select("text").mapInArrow(_shingle_sets, "s long, hashes array<long>")
    return made.groupBy("s").agg(F.first("hashes").alias("hashes"))


def _verified(pairs: DataFrame, own: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) of set ids whose shingle sets have a Jaccard similarity of SIMILAR at least."""
    pairs = cut(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    sets = _sets(pairs.select(F.col("a").alias("s")).union(pairs.select("b")).distinct(), own, texts)
    end = lambda name, kept: sets.select(F.col("s").alias(name), F.col("hashes").alias(kept))
    both = pairs.hint("merge").join(end("a", "x"), "a").join(end("b", "y").hint("merge"), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= SIMILAR * (F.size("x") + F.size("y") - common)).select("a", "b")


#: Hashes of the sets in one part of a bucket, and hashes looked up at once.
PART_HASHES, GATHER = 4_000_000, 8_000_000


def _cell_links(rows: pa.Table) -> tuple[list[int], list[int]]:
    """Links (a, b) of set ids in a cell of a bucket, one for each two groups that they join.

    ``rows`` are (key, i, j, part, root, s, check, hashes). Rows of one root need no link; in a cell off the
    diagonal only rows of different parts are compared.
    """
    i, j, part, root, s, check = (rows.column(k).to_numpy() for k in ("i", "j", "part", "root", "s", "check"))
    lists = pa.concat_arrays(rows.column("hashes").chunks)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    label = np.unique(root, return_inverse=True)[1]
    a: list[int] = []
    b: list[int] = []
    if label[0] == label.max() == label.min():
        return a, b
    ids = np.unique(lists.values.to_numpy()[offsets[0] : offsets[-1]], return_inverse=True)[1]
    offsets = offsets - offsets[0]
    size, check, mark = np.diff(offsets), check.view(np.uint64), np.zeros(len(ids), bool)
    for p in range(len(s) - 1):
        q = np.arange(p + 1, len(s))
        hopeful = (label[q] != label[p]) & (np.bitwise_count(check[q] ^ check[p]) <= CHECK)
        hopeful &= np.minimum(size[q], size[p]) >= SIMILAR * np.maximum(size[q], size[p])
        if i[0] != j[0]:
            hopeful &= part[q] != part[p]
        q = q[hopeful]
        if not len(q):
            continue
        mark[ids[offsets[p] : offsets[p + 1]]] = True
        for some in np.split(q, np.flatnonzero(np.diff(np.cumsum(size[q]) // GATHER)) + 1):
            starts = np.cumsum(size[some]) - size[some]
            places = np.repeat(offsets[some] - starts, size[some]) + np.arange(size[some].sum())
            common = np.add.reduceat(mark[ids[places]].astype(np.int64), starts)
            for k in some[common >= SIMILAR * (size[p] + size[some] - common)]:
                if label[k] != label[p]:
                    a.append(int(s[p]))
                    b.append(int(s[k]))
                    label[label == label[k]] = label[p]
        mark[ids[offsets[p] : offsets[p + 1]]] = False
    return a, b


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of cells to their links; cells are read as a stream."""
    held: list[pa.RecordBatch] = []

    def found() -> Iterator[pa.RecordBatch]:
        a, b = _cell_links(pa.Table.from_batches(held))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cell = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)])
        edge = np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0)) + 1
        for start, end in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows], strict=True):
            rows = batch.slice(start, end - start)
            if held and [held[0].column(k)[0] for k in range(3)] != [rows.column(k)[0] for k in range(3)]:
                yield from found()
                held = []
            held.append(rows)
    if held:
        yield from found()


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies of ``docs`` (the least doc_id), with the columns of ``docs``.

    Documents link if their sets of five-word shingles have a Jaccard similarity of SIMILAR at least, counted
    for every pair that the search brings together. Texts without words are copies of each other. Rows without a
    doc_id stay, unseen. Rows that repeat the kept doc_id stay, but for those equal in text as well. An empty
    table gives an empty result; extra columns pass through.
    """
    known = docs.where(F.col(f"`{doc_id}`").isNotNull())
    texts = known.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    seen = cut(signatures(known, doc_id, text))
    own = cut(seen.groupBy("s").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("fp", "check", "n", "bands")).alias("v")).select("s", "doc_id", "v.*"))
    # rows that agree in both fingerprints are one in the search, under their least set id
    least = own.groupBy("fp", "check").agg(F.min("s").alias("rep"))
    links = ball_links(least, CHECK)
    end = lambda fp, check, name: least.select(F.col("fp").alias(fp), F.col("check").alias(check), F.col("rep").alias(name))
    balls = links.join(end("a", "ac", "x"), ["a", "ac"]).join(end("b", "bc", "y"), ["b", "bc"]).select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = own.join(least, ["fp", "check"]).where("s <> rep").select(F.col("s").alias("a"), F.col("rep").alias("b"))
    # first, neighbours in every bucket of a band: groups of any size grow together by few pairs
    keyed = own.select("s", "check", "n", F.explode("bands").alias("key"))
    shared = cut(keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "key").select("key", "s", "check", "n"))
    before = F.lag("s").over(Window.partitionBy("key").orderBy("check", "s"))
    chain = shared.select(F.col("s").alias("a"), before.alias("b")).where("b is not null")
    roots = cut(components(_verified(balls.union(same).union(chain), own, texts)))
    # then all that are still apart in a bucket: big buckets are cut into parts, each two of which meet in a cell
    rooted = cut(shared.join(roots, shared["s"] == roots["node"], "left").select("key", F.coalesce("root", "s").alias("root"), "s", "check", "n"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.sum("n") / PART_HASHES).cast("int").alias("parts"))
    apart = rooted.drop("n").join(mixed.where("low <> high").select("key", "parts"), "key").withColumn("part", F.expr("cast(pmod(xxhash64(s), parts) as int)"))
    apart = cut(apart.withColumn("q", F.explode(F.expr("sequence(0, parts - 1)"))))
    cells = apart.withColumns({"i": F.least("part", "q"), "j": F.greatest("part", "q")}).join(_sets(apart.select("s").distinct(), own, texts), "s")
    dealt = cells.select("key", "i", "j", "part", "root", "s", "check", "hashes").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "root", "s")
    last = cut(dealt.mapInArrow(_across, "a long, b long").distinct())
    if not last.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(last))
    top = own.select("s", "doc_id").join(roots.withColumnRenamed("node", "s"), "s", "left").groupBy(F.coalesce("root", "s")).agg(F.min("doc_id").alias("doc_id"))
    every = seen.groupBy("doc_id").agg(F.count("*").alias("n"))
    gone = _sized(every.join(top, "doc_id", "left_anti").select("doc_id"))
    again = _sized(every.where("n > 1").select("doc_id"))
    ident = known[f"`{doc_id}`"]
    stay = known.join(gone, ident == gone["doc_id"], "left_anti")
    repeated = stay.join(again, ident == again["doc_id"], "left_semi").dropDuplicates([doc_id, text])
    return stay.join(again, ident == again["doc_id"], "left_anti").unionByName(repeated).unionByName(docs.where(F.col(f"`{doc_id}`").isNull()))
