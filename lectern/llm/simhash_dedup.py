"""SimHash near-dedup with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. Of two fingerprints that differ
in at most 3 bits, at least two segments differ in at most one bit (pigeonhole). A segment that
differs in at most one bit decodes to a Golay codeword that is also the nearest one to the other
segment or to one of its neighbours. So a fingerprint is filed under the three pairs of its
segments' codewords (24 bits each), and looks under the pairs of all codewords near its segments
(28 or so for each pair). Every two fingerprints that link meet under one key, where their distance
is verified. Equal fingerprints are one from the start, a key's rows give a spanning forest instead
of all pairs, and keys with too many rows go another exact way, so nothing grows with the square of
a group.

Where ``similar`` is told, texts also link whose sets of shingles have that Jaccard similarity, which
few fingerprints show. Candidates share one of 24 bands of 4 minima of the shingles' hashes, which two
of similarity 0.8 miss with probability 0.000003; each is verified by its texts.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import golay
from lectern.llm.common import partitions, pick, ship, stored
from lectern.llm.components import components

#: Rows of a key that are compared with each other in memory; keys with more go by ``_balls``.
CAP = 4096
#: Rows of sorted keys that a task looks at together.
WINDOW = 200_000
#: Words of a text whose shingles are hashed at once.
PART = 100_000
SEED = 42
DISTANCE = 3
#: Bands of minima, and minima in each.
BANDS, ROWS = 24, 4
_CUTS = ((0, 23), (23, 23), (46, 18))
_PAIRS = ((0, 1), (0, 2), (1, 2))


def hashes(text: str, shingle: int):
    """XXH64 of a text's word shingles, some at a time; none without words."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    for start in range(0, max(1, len(words) - shingle + 1) if words else 0, PART):
        w = words[start : start + PART + shingle - 1]
        shingles = [b" ".join(w)] if len(words) < shingle else map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False))
        yield np.array([xxh64_intdigest(x, SEED) for x in shingles], "<u8")


def _simhash(parts) -> int:
    votes, n = np.zeros(64, np.int64), 0
    for h in parts:
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):
            votes += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
        n += len(h)
    return sum(1 << i for i in np.flatnonzero(2 * votes > n).tolist())


def fingerprint(text: str, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, hashed by XXH64; 0 without words."""
    return _simhash(hashes(text, shingle))


def _numbered(docs: DataFrame) -> DataFrame:
    """row (the place in ``docs``), doc_id and text."""
    return pick(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """row, doc_id and fp (a long with the fingerprint's bits) of every row."""
    ship(docs.sparkSession)

    def run(arrived):
        for b in arrived:
            fps = np.array([fingerprint(x or "", shingle) for x in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(fps)], ["row", "doc_id", "fp"])

    return _numbered(docs).mapInArrow(run, f"row long, doc_id {pick(docs, 'doc_id').schema[0].dataType.simpleString()}, fp long")


@cache
def _multipliers() -> np.ndarray:
    return np.random.default_rng(11).integers(0, 2**63, (2, BANDS * ROWS), dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def bands(h: np.ndarray) -> np.ndarray:
    """For a set of hashes one number per band; two sets share it if they share the band's minima. None for no hashes."""
    if not len(h):
        return np.zeros(0, np.int64)
    mask, times = _multipliers()
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for k in range(0, len(h), 1024):
        np.minimum(least, ((h[k : k + 1024, None] ^ mask) * times).min(axis=0), out=least)
    key = ((least >> np.uint64(7)) * times[::-1]).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    return ((key ^ key >> np.uint64(31)) * times[0]).view(np.int64)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """row, doc_id, fp, text (its XXH64), n (distinct shingles) and bands of every row."""
    ship(docs.sparkSession)

    def run(arrived):
        from xxhash import xxh64_intdigest

        for b in arrived:
            fp, text, n, keys = [], [], [], []
            for x in b.column("text"):
                x = x.as_py() or ""
                parts = list(hashes(x, shingle))
                h = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
                fp.append(_simhash(parts)), text.append(xxh64_intdigest(x.encode(), SEED)), n.append(len(h)), keys.append(bands(h))
            longs = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in (fp, text, n)]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), *longs, pa.array(keys, pa.list_(pa.int64()))], ["row", "doc_id", "fp", "text", "n", "bands"])

    return _numbered(docs).mapInArrow(run, f"row long, doc_id {pick(docs, 'doc_id').schema[0].dataType.simpleString()}, fp long, text long, n long, bands array<long>")


def _verified(docs: DataFrame, pairs: DataFrame, shingle: int, similar: float, name: str) -> DataFrame:
    """Edges (a, b) between fingerprints of ``pairs`` (text_a, a, text_b, b) whose texts are similar."""
    pairs = stored(pairs, f"{name}-pairs")
    wanted = pairs.select(F.col("text_a").alias("key")).unionAll(pairs.select("text_b")).distinct()
    texts = pick(docs, "text").select(F.xxhash64("text").alias("key"), "text").join(wanted, "key", "left_semi")
    texts = stored(texts.groupBy("key").agg(F.first("text").alias("text")), f"{name}-texts")

    def run(arrived):
        last, right = None, None
        for b in arrived:
            ok = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                x, y = x.as_py(), y.as_py()
                if y != last:
                    last, right = y, np.unique(np.concatenate(list(hashes(y, shingle))))
                left = np.unique(np.concatenate(list(hashes(x, shingle))))
                both = len(np.intersect1d(left, right, assume_unique=True))
                ok.append(both >= similar * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(texts.select(F.col("key").alias("text_a"), F.col("text").alias("x")), "text_a").join(texts.select(F.col("key").alias("text_b"), F.col("text").alias("y")), "text_b")
    return stored(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), name)


def similar_links(docs: DataFrame, found: DataFrame, edges: DataFrame, shingle: int, similar: float) -> DataFrame:
    """``edges`` and more that connect all fingerprints of similar texts; ``found`` are the sketches of ``docs``."""
    filed = stored(found.select("fp", "text", "n", F.explode("bands").alias("key")).distinct(), "filed")

    def open_(edges):
        """What is filed under keys whose rows are not all in one component."""
        rows = filed.join(components(edges).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        pivot = rows.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.min(F.struct("root", "fp", "text", "n")).alias("p"))
        return stored(rows.join(pivot.where("least <> most").select("key", "p"), "key"), "open")

    def pairs(a, b, rows):
        """Pairs, once, that may be similar by the numbers of their shingles."""
        near = F.least(f"{a}.n", f"{b}.n") >= similar * F.greatest(f"{a}.n", f"{b}.n")
        return rows.where((F.col(f"{a}.root") != F.col(f"{b}.root")) & near).select(F.col(f"{a}.text").alias("text_a"), F.col(f"{a}.fp").alias("a"), F.col(f"{b}.text").alias("text_b"), F.col(f"{b}.fp").alias("b")).distinct()

    me = F.struct("root", "fp", "text", "n")
    rows = open_(edges)
    edges = edges.unionAll(_verified(docs, pairs("s", "p", rows.select(me.alias("s"), "p")), shingle, similar, "similar"))
    # Those under one key that are then not in one component are compared with each other.
    rows = open_(edges)
    if rows.isEmpty():
        return edges
    a, b = (rows.select("key", me.alias(x)) for x in ("s", "t"))
    return edges.unionAll(_verified(docs, pairs("s", "t", a.join(b, "key").where("s.root > t.root")), shingle, similar, "similar-2"))


def keys(arrived):
    """For each distinct fingerprint: rows (key, fp, filed) under which it is filed, and under which it looks."""
    for b in arrived:
        whole = b.column("fp").to_numpy()
        for start in range(0, len(whole), 2000):
            fp = whole[start : start + 2000]
            own, looks = [], []
            for low, n in _CUTS:
                word = (fp.view(np.uint64) >> np.uint64(low)).astype(np.int64) & ((1 << n) - 1)
                own.append(golay.decode(word).astype(np.int64))
                looks.append(golay.near(word, n).astype(np.int64))
            out_key, out_fp, out_filed = [], [], []
            for p, (i, j) in enumerate(_PAIRS):
                mine = (own[i] << 12 | own[j]) << 2 | p
                both = ((looks[i][:, :, None] << 12 | looks[j][:, None, :]) << 2 | p).reshape(len(fp), -1)
                ok = ((looks[i][:, :, None] >= 0) & (looks[j][:, None, :] >= 0)).reshape(len(fp), -1) & (both != mine[:, None])
                out_key += [mine, both[ok]]
                out_fp += [fp, np.repeat(fp, ok.sum(axis=1))]
                out_filed += [np.ones(len(fp), bool), np.zeros(int(ok.sum()), bool)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_key).astype(np.int32)), pa.array(np.concatenate(out_fp)), pa.array(np.concatenate(out_filed))], ["key", "fp", "filed"])


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= DISTANCE


def forest(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links among a few distinct fingerprints, fewer than there are of these."""
    a, b, left = [], [], np.unique(fp)
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            hit = near(left, np.broadcast_to(front[0], left.shape).copy())
            a.append(np.full(int(hit.sum()), front[0]))
            b.append(left[hit])
            front, left = np.concatenate([front[1:], left[hit]]), left[~hit]
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def _out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])


def _small(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs among the rows of each key, for keys with few rows."""
    a, b, at, k = [], [], np.arange(len(key)), 1
    while True:
        at = at[at + k < len(key)]
        at = at[key[at] == key[at + k]]
        if not len(at):
            break
        x, y = fp[at], fp[at + k]
        hit = near(x, y) & (x != y)
        a.append(x[hit])
        b.append(y[hit])
        k += 1
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def links(arrived):
    """Edges (a, b) of the fingerprints under each key of sorted rows (key, fp); (fp, fp) where a key has too many."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, over = 0, None

    def work(final: bool):
        nonlocal held, size, over
        key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        if not final and sizes[-1] <= CAP and key[-1] != over:  # its rows may go on
            held, size = [(key[starts[-1] :], fp[starts[-1] :])], int(sizes[-1])
            starts, sizes = starts[:-1], sizes[:-1]
        else:
            held, size = [], 0
        a, b = [], []
        few = (sizes <= 16) & (key[starts] != over if over is not None else True)  # the rest of a crowded key is not few
        small = np.repeat(few, sizes)
        x, y = _small(key[: len(small)][small], fp[: len(small)][small])
        a.append(x), b.append(y)
        for s, n in zip(starts[~few], sizes[~few], strict=True):
            if n > CAP or key[s] == over:
                over = key[s]
                a.append(fp[s : s + n]), b.append(fp[s : s + n])
            else:
                x, y = forest(fp[s : s + n])
                a.append(x), b.append(y)
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
        return _out(pairs[0], pairs[1])

    for batch in arrived:
        if batch.num_rows:
            held.append((batch.column("key").to_numpy(), batch.column("fp").to_numpy()))
            size += batch.num_rows
            if size >= WINDOW:
                yield work(False)
    if held:
        yield work(True)


def _ball_rows(arrived):
    """For each fingerprint all words within 1 bit (near) and at 2 bits (far)."""
    one = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
    i, j = np.triu_indices(64, 1)
    two = (np.uint64(1) << i.astype(np.uint64)) | (np.uint64(1) << j.astype(np.uint64))
    flips, far = np.concatenate([one, two]), np.concatenate([np.zeros(65, bool), np.ones(len(two), bool)])
    for b in arrived:
        for start in range(0, b.num_rows, 100):
            fp = b.column("fp").to_numpy()[start : start + 100]
            yield pa.RecordBatch.from_arrays([pa.array((fp.view(np.uint64)[:, None] ^ flips).view(np.int64).ravel()), pa.array(np.tile(far, len(fp))), pa.array(np.repeat(fp, len(flips)))], ["word", "far", "fp"])


def _balls(fps: DataFrame) -> DataFrame:
    """Edges that connect all of ``fps`` (distinct) that link, however many are close to each other.

    Two fingerprints that differ in at most 3 bits have a word that is at most 1 bit from the one
    and 2 from the other; any that share a word in this way do link. Under each word all are tied
    to one that is near, so edges are no more than rows.
    """
    rows = fps.mapInArrow(_ball_rows, "word long, far boolean, fp long")
    hub = rows.where("not far").groupBy("word").agg(F.min("fp").alias("a"))
    return rows.join(hub, "word").where("a <> fp").select(F.greatest("a", "fp").alias("a"), F.least("a", "fp").alias("b"))


def linked(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all links among distinct fingerprints ``fp``."""
    ship(fps.sparkSession)
    filed = fps.mapInArrow(keys, "key int, fp long, filed boolean").select("key", "fp")
    edges = stored(filed.repartition(partitions(fps.sparkSession), "key").sortWithinPartitions("key").mapInArrow(links, "a long, b long"), "links")
    over = edges.where("a = b").select(F.col("a").alias("fp")).distinct()
    return edges.where("a <> b") if over.isEmpty() else edges.where("a <> b").unionAll(stored(_balls(over), "balls"))


def _linked(docs: DataFrame, shingle: int, similar: float | None) -> tuple[DataFrame, DataFrame]:
    """Stored fingerprints (row, doc_id, fp) of all rows, and (fp, root) of those that link with others."""
    fps = stored(sketches(docs, shingle) if similar else fingerprints(docs, shingle), "fingerprints")
    edges = linked(fps.select("fp").distinct())
    if similar:
        edges = similar_links(docs, fps, edges, shingle, similar)
    return fps.select("row", "doc_id", "fp"), components(edges).withColumnRenamed("node", "fp")


def near_groups(docs: DataFrame, shingle: int = 3, similar: float | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp and component_id, the smallest doc_id that links reach.

    Texts link whose fingerprints differ in at most 3 of 64 bits or, where ``similar`` is told, whose
    sets of shingles have that Jaccard similarity; ``docs`` should then read the same again. Null and empty texts have the
    fingerprint zero, which links like any other; texts with fewer words than a shingle hash all
    of them as one. Repeated rows share a fingerprint. A null doc_id is never the smallest unless
    its component has no other. An empty table gives no rows; other columns are not read.
    """
    fps, roots = _linked(docs, shingle, similar)
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of_root = least.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stored(least.join(of_root, "root").select("fp", "component_id"), "classes")
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, shingle: int = 3, similar: float | None = None) -> DataFrame:
    """The rows of ``docs`` that stay: of each group one, that with the smallest doc_id, of several such rows the first.

    Groups are those of ``near_groups``: repeated rows are one group, rows that only share a doc_id are
    not. A row without a doc_id stays if its group has no other. Null and empty texts are one group. An
    empty table gives no rows; all columns stay, whatever their names. ``docs`` should be a table that
    reads the same again.
    """
    fps, roots = _linked(docs, shingle, similar)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    least = fps.groupBy("fp").agg(first).join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    kept = stored(least.select(F.col("first.row").alias("kept_row")), "kept")
    rows = docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).withColumn("row", F.monotonically_increasing_id())
    return rows.join(kept, F.col("row") == F.col("kept_row"), "left_semi").drop("row").toDF(*docs.columns)
