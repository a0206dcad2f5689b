"""Near duplicates by Order MinHash.

A text becomes its lower-case word sequence and the sequence of its 5-word shingles; a shingle that comes again is told
apart by its occurrence number. Every one of ``sketches`` hash functions picks the ``taken`` smallest of these labelled
shingles and keeps them *in text order*, so two texts agree on a sketch with a chance that falls with their edit
distance, not just with the overlap of their sets. The smallest shingle of a sketch is a key of its own beside them:
scattered edits that leave a similarity of 0.8 leave a fifth of the shingles, and two of them seldom agree at once (32 single
ones all miss such a pair with a chance of 0.8^32 = 0.0008).
Texts that agree on any sketch are candidates; those that lengths and word histograms do not rule out are linked if a
banded alignment of their words finds an edit similarity (1 - distance / longer length) of 0.8 or more. Classes are the
connected components of the links.

Equal word sequences are one node, named by a 63-bit hash, so copies never meet in pairs. Inside a bucket every node is
first compared with the bucket's smallest and largest node: a class of any size is found in a number of comparisons that
grows with its texts. Buckets with the same smallest node, one for each of its keys at most, are one group, as their nodes
are mostly the same. The nodes of a group that are then still in several classes are compared across these, all of them,
so two texts that share a bucket are linked, or in one class by others, or were found unlike. A pair that shares several
groups is given by the first of them. In a large group of strangers only those meet that share one of their rarest words,
as texts so near must: of ``n`` words ``least * n`` or more are common, so the rarest ``(1 - least) * n + 1`` of the two
have one in common, whatever the order of rarity.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import hashlib
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from regiotally.llm.rows import fresh, pieces_of, text_or_empty, written

WORD = re.compile(r"\w+")
SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 32
TAKEN = 2
#: Cells of the word histogram that rules pairs out before their words are fetched, and of its folded form that is looked
#: at first; powers of two.
BINS = 1_024
FOLDED = 256
#: Cells for texts of more than ``LONG`` words, as in few cells all long texts look alike.
FINE = 4_096
LONG = 2_048
#: Nodes of one side of a comparison inside a task.
TILE = 2_048
#: Groups with more comparisons than this meet by rare words; which way is taken decides about the work, not about the links.
DIRECT = 60_000_000
#: Cells of the count that says which words are rare; a power of two.
CELLS = 65_536
#: Numbers of 64 bits in the bitmap of wanted nodes; a power of two.
SLOTS = 131_072
#: Word hashes kept per worker; the table is emptied when it is full.
CACHED = 150_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    values = [int.from_bytes(hashlib.blake2b(f"sketch {k}".encode(), digest_size=16).digest(), "little") for k in range(n)]
    return np.array([v >> 64 for v in values], dtype=np.uint64), np.array([(v | 1) & 0xFFFFFFFFFFFFFFFF for v in values], dtype=np.uint64)


class WordHashes:
    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def of(self, words: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.array([known[w] for w in words], dtype=np.uint32)
        except KeyError:
            if len(known) > CACHED:
                known.clear()
            known.update((w, zlib.crc32(w.encode("utf-8", "surrogatepass"))) for w in set(words) if w not in known)
            return np.array([known[w] for w in words], dtype=np.uint32)


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles; a shorter text is one shingle."""
    size = min(size, len(words))
    out = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for k in range(size):
        out = (out ^ words[k : len(words) - size + 1 + k].astype(np.uint64)) * _MIX
        out ^= out >> np.uint64(29)
    return out


def labelled(grams: np.ndarray) -> np.ndarray:
    """Shingle hashes mixed with their occurrence number."""
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    if len(starts) == len(grams):
        return grams
    number = np.empty(len(grams), dtype=np.uint64)
    number[order] = np.arange(len(grams)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(grams)]])))
    return grams ^ (number * np.uint64(0xC2B2AE3D27D4EB4F))


def sketch(grams: np.ndarray, sketches: int = SKETCHES, taken: int = TAKEN, firsts: np.ndarray | None = None) -> np.ndarray:
    """One 64-bit bucket key per sketch; ``firsts`` is filled with those of the same sketches with one shingle."""
    own = labelled(grams)
    own = own ^ (own >> np.uint64(32))
    seeds, factors = _seeds(sketches)
    taken = min(taken, len(own))
    keys = np.empty(sketches, dtype=np.uint64)
    rows = max(1, 2_000_000 // len(own))  # a few megabytes at a time, whatever the length
    for at in range(0, sketches, rows):
        values = (own[None, :] ^ seeds[at : at + rows, None]) * factors[at : at + rows, None]
        places = np.empty((len(values), taken), dtype=np.int64)
        every = np.arange(len(values))
        for t in range(taken):
            places[:, t] = values.argmin(axis=1)
            values[every, places[:, t]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        start = np.arange(at, at + len(values), dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        if firsts is not None:
            firsts[at : at + rows] = _key(start, grams, places[:, :1])
        places.sort(axis=1)
        keys[at : at + rows] = _key(start, grams, places)
    return keys


def _key(key: np.ndarray, grams: np.ndarray, places: np.ndarray) -> np.ndarray:
    for t in range(places.shape[1]):
        key = (key ^ grams[places[:, t]]) * _MIX
        key = key ^ (key >> np.uint64(31))
    return key


def bucket_keys(grams: np.ndarray, sketches: int = SKETCHES) -> np.ndarray:
    """Keys of the sketches in text order, then those of one shingle each: the smallest of each sketch alone."""
    singles = np.empty(sketches, dtype=np.uint64)
    return np.concatenate([sketch(grams, sketches, firsts=singles), singles ^ _MIX])


def histogram(words: np.ndarray) -> bytes:
    """Words by the low bits of their hash, counts above 255 as 255: what two texts need at least to become equal."""
    cells = FINE if len(words) > LONG else BINS
    return np.minimum(np.bincount(words & np.uint32(cells - 1), minlength=cells), 255).astype(np.uint8).tobytes()


def packed_bins(bins: bytes, squeeze: zstandard.ZstdCompressor) -> bytes:
    """A histogram compressed, or as it is where that is no shorter: only those have ``BINS`` or ``FINE`` bytes."""
    out = squeeze.compress(bins)
    return out if len(out) < len(bins) and len(out) != BINS else bins


class Histograms:
    """The histograms of a column: ``bins`` with ``BINS`` cells of all, ``fine`` with ``FINE`` cells of long texts."""

    def __init__(self, column: pa.ChunkedArray | pa.Array, expand: zstandard.ZstdDecompressor) -> None:
        whole = [b if len(b) in (BINS, FINE) else expand.decompress(b) for b in column.to_pylist()]
        large = [k for k, b in enumerate(whole) if len(b) == FINE]
        self.place = np.full(len(whole), -1, dtype=np.int64)  # row of ``fine``, -1 without
        self.place[large] = np.arange(len(large))
        self.fine = np.frombuffer(b"".join(whole[k] for k in large), dtype=np.uint8).reshape(-1, FINE)
        for k, cells in zip(large, folded(self.fine, BINS)):
            whole[k] = cells.tobytes()
        self.bins = np.frombuffer(b"".join(whole), dtype=np.uint8).reshape(-1, BINS)


def folded(bins: np.ndarray, cells: int = FOLDED) -> np.ndarray:
    """Histograms of fewer cells, in which two texts differ by no more than in all of them."""
    return np.minimum(bins.reshape(len(bins), bins.shape[1] // cells, cells).sum(axis=1, dtype=np.int64), 255).astype(np.uint8)


def may_align(n_a: np.ndarray, n_b: np.ndarray, bins_a: np.ndarray, bins_b: np.ndarray, least: float) -> np.ndarray:
    """Whether pairs can reach the similarity: neither the lengths nor the words that one side has more of forbid it."""
    most = ((1 - least) * np.maximum(n_a, n_b) + 1e-9).astype(np.int64)
    both = np.maximum(bins_a, bins_b).sum(axis=1, dtype=np.int64)
    more, less = both - bins_b.sum(axis=1, dtype=np.int64), both - bins_a.sum(axis=1, dtype=np.int64)
    return (np.abs(n_a - n_b) <= most) & (np.maximum(more, less) <= most)


def long_may_align(n_a: np.ndarray, n_b: np.ndarray, a: Histograms, b: Histograms, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """The same of rows ``i`` of ``a`` and ``j`` of ``b`` by the finer histograms, where both have one."""
    may = np.ones(len(i), dtype=bool)
    both = np.flatnonzero((a.place[i] >= 0) & (b.place[j] >= 0))
    for at in range(0, len(both), 2_000):  # some megabytes at a time
        own = both[at : at + 2_000]
        may[own] = may_align(n_a[own], n_b[own], a.fine[a.place[i[own]]], b.fine[b.place[j[own]]], least)
    return may


def banded(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance if it is at most ``most``, from the band of cells that lie at most so far from the diagonal.

    A column of the band is a number of ``2 * most + 1`` bits in each of the bit vectors of Myers (1999), which slide down
    one row with every word of ``b`` as in Hyyroe (2003). The distance is followed along the lowest diagonal to the last
    row, and then along that row.
    """
    m, n, k = len(a), len(b), most
    if abs(m - n) > k:
        return None
    places: dict[int, int] = {}
    for i, word in enumerate(a.tolist()):
        places[word] = places.get(word, 0) | (1 << i)
    top, mask = 2 * k, (1 << (2 * k + 1)) - 1
    plus, minus, score = mask & ~((1 << k) - 1), 0, min(k, m)  # rows from 1 on grow by one down the first column
    hopeless = most + n - m + k
    for j, word in enumerate(b.tolist(), 1):
        found, start = places.get(word, 0), j - k - 1
        if found:
            found = (found >> start if start >= 0 else found << -start) & mask
            same = ((((found & plus) + plus) & mask) ^ plus) | found | minus
        else:
            same = minus
        right, left = minus | (mask ^ (same | plus)), same & plus
        if j + k <= m:
            score += 1 - (same >> top & 1)
            if score > hopeless:
                return None
        else:
            row = m - j + k
            if row < 0:
                return None
            score += (right >> row & 1) - (left >> row & 1)
        same >>= 1
        plus, minus = left | (mask ^ (same | right)), same & right
    return score if score <= most else None


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float | None:
    """Edit similarity of two word sequences, or None where it is under ``least``."""
    longer = max(len(a), len(b))
    most = int((1 - least) * longer + 1e-9)
    if longer == 0 or abs(len(a) - len(b)) > most:
        return None
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(a[len(a) - short + head :][::-1] != b[len(b) - short + head :][::-1])
    tail = int(differ[0]) if len(differ) else short - head
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if most < max(len(a), len(b)):
        # words that only one side has must be edited
        values, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        spare = np.bincount(place[: len(a)], minlength=len(values)) - np.bincount(place[len(a) :], minlength=len(values))
        if max(spare[spare > 0].sum(), -spare[spare < 0].sum()) > most:
            return None
    distance = banded(a, b, most)
    return None if distance is None else 1 - distance / longer


def node_rows(docs: DataFrame, id_column: str, text_column: str, sketches: int = SKETCHES) -> DataFrame:
    """Per document: id, a hash of the raw text, its node, bucket keys, packed words, their number and histogram. No shuffle."""
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_or_empty(text_column)).alias("raw"), F.col(text_column).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, squeeze = WordHashes(), zstandard.ZstdCompressor(level=2)
        for batch in pieces_of(batches):
            nodes, keys, packed, sizes, bins = [], [], [], [], []
            for raw, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = WORD.findall((text or "").lower())
                own = "\n".join(words) if words else f" {raw}"  # without words only equal texts are one node
                nodes.append(int.from_bytes(hashlib.blake2b(own.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1)
                if words:
                    ids = hashes.of(words)
                    keys.append(bucket_keys(shingles(ids), sketches).view(np.int64))
                    packed.append(squeeze.compress(ids.tobytes()))
                    bins.append(packed_bins(histogram(ids), squeeze))
                else:
                    keys.append(np.zeros(0, dtype=np.int64))
                    packed.append(b"")
                    bins.append(b"")
                sizes.append(len(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(packed, pa.binary()), pa.array(sizes, pa.int32()), pa.array(bins, pa.binary())],
                ["id", "raw", "node", "keys", "words", "n_words", "bins"],
            )

    return rows.mapInArrow(build, f"id {kind}, raw long, node long, keys array<long>, words binary, n_words int, bins binary")


def buckets(nodes: DataFrame) -> DataFrame:
    """``key, low, high, node``: the nodes of every bucket but its smallest one, beside the smallest and the largest.

    The keys are shuffled once, for the ends and for the join back. A task streams over its buckets, 16 bytes a node, and
    holds none of them. Both sides of the join grow with the data, so it is asked to sort both.
    """
    # without the filter the join asks one more of its side, and the shuffle would come twice
    flat = nodes.select("node", F.explode("keys").alias("key")).filter("node IS NOT NULL AND key IS NOT NULL").repartition("key")
    ends = flat.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high")
    return flat.hint("merge").join(ends, "key").filter("node <> low").select("key", "low", "high", "node")


def candidates(met: DataFrame) -> DataFrame:
    """Pairs of nodes ``a < b`` that share a bucket; one of them is the bucket's smallest or largest node."""
    return (
        met.select("node", F.explode(F.array("low", "high")).alias("end"))
        .filter("node <> end")
        .select(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b"))
        .distinct()
    )


def rarest(words: np.ndarray, common: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """The words, told apart by their occurrence, of which two texts with the similarity share one: rare ones first."""
    order = np.lexsort((words, common[words & np.uint32(CELLS - 1)]))
    ranked = words[order].astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    number = np.arange(len(ranked)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(ranked)]])))
    return (ranked | number << 32)[: int((1 - least) * len(words) + 1e-9) + 1]


def rare_words(texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``node, tokens`` of rows ``node, words``: the rarest words of each, by counts over all of them."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand, sums = zstandard.ZstdDecompressor(), np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                sums[np.unique(np.frombuffer(expand.decompress(packed), dtype=np.uint32) & np.uint32(CELLS - 1))] += 1
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(sums[some], pa.int64())], ["cell", "n"])

    common = np.zeros(CELLS, dtype=np.int64)
    for cell, n in texts.select("words").mapInArrow(counted, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect():  # one row a cell
        common[cell] = n

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            found = [rarest(np.frombuffer(expand.decompress(packed), dtype=np.uint32), common, least) for packed in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "tokens"])

    return texts.select("node", "words").mapInArrow(chosen, "node long, tokens array<long>")


def across(rows: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Pairs of nodes of different classes of a group that lengths and word histograms do not rule out.

    Rows ``key, token, node, root, main, strangers, size, before, n_words, bins``: a group (key, token) has ``size`` nodes,
    and ``strangers`` of them are not of its class ``main``. These are compared with all, cut into parts of ``TILE`` nodes.
    Nodes that share a key of ``before``, the smaller keys of a node, meet there; without that column every group counts.
    """
    if "before" not in rows.columns:
        rows = rows.withColumn("before", F.array().cast("array<long>"))
    parts = lambda n: F.ceil(F.col(n) / TILE).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    tile = lambda side, x, y: F.struct(F.lit(side).alias("side"), x.alias("x"), y.alias("y"))
    one = F.array(tile(2, F.lit(0), F.lit(0)))
    as_stranger = F.when(F.col("root") != F.col("main"), F.transform(every(parts("size")), lambda y: tile(0, own(parts("strangers")), y))).otherwise(F.array().cast("array<struct<side:int,x:int,y:int>>"))
    as_any = F.transform(every(parts("strangers")), lambda x: tile(1, x, own(parts("size"))))
    tiles = F.when(F.col("size") <= TILE, one).otherwise(F.concat(as_stranger, as_any))

    def compare(table: pa.Table) -> pa.Table:
        side, node, root, main, n = (table.column(c).to_numpy() for c in ("side", "node", "root", "main", "n_words"))
        shapes = Histograms(table.column("bins"), zstandard.ZstdDecompressor())
        before = [frozenset(keys) for keys in table.column("before").to_pylist()]
        x, y = np.flatnonzero((side != 1) & (root != main)), np.flatnonzero(side != 0)
        coarse = folded(shapes.bins)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(x), 16):
            i, j = np.meshgrid(x[at : at + 16], y, indexing="ij")
            i, j = i.ravel(), j.ravel()
            keep = (root[i] != root[j]) & ((root[j] == main[j]) | (node[i] < node[j])) & (np.abs(n[i] - n[j]) <= (1 - least) * np.maximum(n[i], n[j]) + 1e-9)
            i, j = i[keep], j[keep]
            for cells in (coarse, shapes.bins):
                keep = may_align(n[i], n[j], cells[i], cells[j], least)
                i, j = i[keep], j[keep]
            keep = long_may_align(n[i], n[j], shapes, shapes, i, j, least)
            i, j = i[keep], j[keep]
            keep = np.fromiter((before[p].isdisjoint(before[q]) for p, q in zip(i.tolist(), j.tolist())), dtype=bool, count=len(i))
            found.append((node[i[keep]], node[j[keep]]))
        a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, dtype=np.int64) for k in (0, 1))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    dealt = rows.withColumn("tile", F.explode(tiles)).select("key", "token", "tile.*", "node", "root", "main", "before", "n_words", "bins")
    return dealt.groupBy("key", "token", "x", "y").applyInArrow(compare, "a long, b long").distinct()


def between(met: DataFrame, roots: DataFrame, nodes: DataFrame, forms: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Pairs ``a < b`` that share a bucket, are not in one class by ``roots`` and were not met by ``candidates``.

    Buckets with the same smallest node are one group, named by it, so pairs that share no bucket may come too. Only pairs
    that lengths, word histograms or, in large groups, the rarest words rule out are left out. Groups of the same nodes are
    one. The class with the most nodes in a group is compared with the others but never with itself, so a large class beside
    a few strangers costs few comparisons for each of its nodes. What a node brings is joined to it once, not once a group.
    """
    inner = met.filter("node <> high").select(F.col("low").alias("key"), "node").distinct()
    placed = written(inner.hint("merge").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "inner")
    by_class = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("own"))
    several = by_class.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("size"), F.sum("own").alias("own"), F.count(F.lit(1)).alias("classes"))
    open_ones = several.filter("classes > 1").groupBy("main", "most", "size", "own").agg(F.min("key").alias("key"))
    held = placed.hint("merge").join(open_ones.select("key", "main", "size", (F.col("size") - F.col("most")).alias("strangers")), "key")
    # a node is in no more groups than it has keys
    groups = written(held.groupBy("node", "root").agg(F.collect_list(F.struct("key", "main", "size", "strangers")).alias("groups")), "open")

    def each(df: DataFrame) -> DataFrame:
        """A row per node and group, with the smaller ones of the node's groups."""
        rows = df.withColumn("group", F.explode("groups"))
        return rows.select("group.*", F.expr("transform(filter(groups, g -> g.key < group.key), g -> g.key)").alias("before"), *[c for c in df.columns if c != "groups"])

    direct = F.col("strangers").cast("double") * F.col("size") <= DIRECT
    spread = each(groups.hint("merge").join(forms, "node")).filter(direct).withColumn("token", F.lit(0).cast("long"))
    wanted = each(groups).filter(~direct).select("node").distinct()
    if not wanted.isEmpty():
        tokens = written(rare_words(written(words_of(nodes, wanted), "words"), least), "tokens")
        by_word = each(groups.hint("merge").join(tokens, "node")).filter(~direct).drop("size", "strangers").withColumn("token", F.explode("tokens")).drop("tokens")
        stranger = F.sum(F.when(F.col("root") != F.col("main"), 1).otherwise(0))
        sizes = by_word.groupBy("key", "token").agg(F.count(F.lit(1)).alias("size"), stranger.alias("strangers")).filter("size > 1 AND strangers > 0")
        spread = spread.unionByName(by_word.hint("merge").join(sizes, ["key", "token"]).hint("merge").join(forms, "node"))
    return across(spread, least)


def shapes(nodes: DataFrame) -> DataFrame:
    """``node, n_words, bins`` of every node with words, some hundred bytes each."""
    return nodes.select("node", "n_words", "bins").filter("n_words > 0").dropDuplicates(["node"])


def possible(pairs: DataFrame, forms: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The candidate pairs that lengths and word histograms do not rule out."""

    def rule_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            if batch.num_rows:
                n_a, n_b, a, b = batch.column(2).to_numpy(), batch.column(3).to_numpy(), *(Histograms(batch.column(c), expand) for c in (4, 5))
                every = np.arange(batch.num_rows)
                keep = may_align(n_a, n_b, a.bins, b.bins, least) & long_may_align(n_a, n_b, a, b, every, every, least)
                yield batch.select([0, 1]).filter(pa.array(keep))

    left = forms.select(F.col("node").alias("a"), F.col("n_words").alias("n_a"), F.col("bins").alias("bins_a"))
    right = forms.select(F.col("node").alias("b"), F.col("n_words").alias("n_b"), F.col("bins").alias("bins_b"))
    both = pairs.hint("merge").join(left, "a").hint("merge").join(right, "b").select("a", "b", "n_a", "n_b", "bins_a", "bins_b")
    return both.mapInArrow(rule_out, "a long, b long")


def words_of(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, words`` of the ``wanted`` nodes, one row each.

    A bitmap of the wanted rows, of a fixed size, goes to all tasks and leaves out most others before the shuffle. Words
    are shuffled once, by node: a join by node needs no other shuffle.
    """
    # copies have the same words: the first id's row stands for the node
    one = written(nodes.groupBy("node").agg(F.min("id").alias("id")).hint("merge").join(wanted, "node"), "wanted")
    mark = F.xxhash64("node", "id")
    slot, bit = F.shiftright(mark, 6).bitwiseAND(SLOTS - 1), F.expr("shiftleft(1L, CAST(xxhash64(node, id) & 63 AS INT))")
    marks = one.groupBy(slot.alias("slot")).agg(F.bit_or(bit).alias("marks"))  # one row a slot
    own = nodes.select("node", "id", "words", slot.alias("slot")).join(F.broadcast(marks), "slot").filter(F.col("marks").bitwiseAND(bit) != 0)
    # an inner join: a semi join would be moved below the bitmap; ids are compared so that they are no part of its key
    first = F.expr("CASE WHEN i IS NULL THEN id IS NULL ELSE coalesce(id = i, false) END")
    own = own.select("node", "id", "words").hint("merge").join(one.withColumnsRenamed({"node": "n", "id": "i"}), (F.col("node") == F.col("n")) & first)
    return own.select("node", "words").dropDuplicates(["node"])


def links(pairs: DataFrame, nodes: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The candidate pairs whose words align, with their similarity."""
    texts = words_of(nodes, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        last: dict[bytes, np.ndarray] = {}

        def unpacked(packed: bytes) -> np.ndarray:
            if packed not in last:
                if len(last) > 64:
                    last.clear()
                last[packed] = np.frombuffer(expand.decompress(packed), dtype=np.uint32)
            return last[packed]

        for batch in batches:
            for piece in pieces_of(iter([batch])):
                found = [similarity(unpacked(x), unpacked(y), least) for x, y in zip(piece.column(2).to_pylist(), piece.column(3).to_pylist())]
                keep = pa.array([s is not None for s in found])
                out = pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(found, pa.float64())], ["a", "b", "similarity"])
                yield out.filter(keep)

    left = texts.select(F.col("node").alias("a"), F.col("words").alias("words_a"))
    right = texts.select(F.col("node").alias("b"), F.col("words").alias("words_b"))
    both = pairs.hint("merge").join(left, "a").hint("merge").join(right, "b").select("a", "b", "words_a", "words_b")
    return both.mapInArrow(align, "a long, b long, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b); the root is the smallest node of the component.

    Alternates two steps until nothing changes: each node hangs its larger neighbours, then its smaller ones, under the
    smallest node it sees. Each round is written to the shared folder. Only minima are aggregated, so a node with very
    many neighbours is no burden.
    """
    own = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    state = None
    while True:
        both = own.unionByName(own.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        own = written(small.select("e.*").filter("u <> v").distinct(), "edges")
        now = own.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return own.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(own.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: id, raw text hash, ``root`` node, ``class_id`` (smallest id of its class), ``class_size``.

    Ids that are null have a class too; a class of null ids only has a null ``class_id``. Texts without words are in a
    class with equal texts only, null counts as empty. Repeated rows are copies of each other.
    """
    nodes = written(node_rows(docs, id_column, text_column), "sketches")
    forms = shapes(nodes)
    met = written(buckets(nodes), "buckets")
    first = written(possible(candidates(met), forms, least), "possible")
    roots = written(components(links(first, nodes, least)), "classes")
    rest = written(between(met, roots, nodes, forms, least).hint("merge").join(first, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = components(known.unionByName(links(rest, nodes, least).select("a", "b")))
    per_node = nodes.groupBy("node").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
    rooted = written(per_node.hint("merge").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "low", "n"), "roots")
    whole = rooted.groupBy("root").agg(F.min("low").alias("class_id"), F.sum("n").alias("class_size"))
    named = rooted.select("node", "root").hint("merge").join(whole, "root").select("node", "root", "class_id", "class_size")
    return nodes.select("id", "raw", "node").hint("merge").join(named, "node").select(F.col("id").alias(id_column), "raw", "root", "class_id", "class_size")


def one_per_class(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each class, that of the smallest id (nulls last), with all its columns."""
    found = classes(docs, id_column, text_column)
    # of each class the row that bears its smallest id, told apart by its text
    bearing = found.filter(F.col(id_column).eqNullSafe(F.col("class_id")))
    kept = written(bearing.groupBy("root").agg(F.min(id_column).alias(id_column), F.min("raw").alias("raw"), F.count(F.lit(1)).alias("n")), "kept")
    raw, own = fresh(docs, "_raw"), fresh(docs, "_id")
    rows = docs.withColumn(raw, F.xxhash64(text_or_empty(text_column)))
    kept = kept.select(F.col(id_column).alias(own), F.col("raw").alias(f"{raw}_"), "n")
    same = F.col(id_column).eqNullSafe(F.col(own)) & (F.col(raw) == F.col(f"{raw}_"))
    out = rows.join(kept.drop("n"), same, "left_semi")
    if not kept.filter("n > 1").isEmpty():  # repeated ids or rows: the first of equal ones
        out = out.dropDuplicates([id_column, raw])
    return out.drop(raw)
