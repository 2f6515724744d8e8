"""Operator 6: similarity self-join of word-shingle sets with signature trees.

Equal sets are one class. Similar sets differ in few shingles, so when the shingles are dealt
into somewhat more parts than that, some part is the same in both sets; classes with an
equal part are candidates. Connected candidates form a cluster, which goes to one task.
There the sets hang in a signature tree: a node holds the OR-combined bitmap and the size
range of the sets below it, and pairs of nodes are walked together, cut off where the
bitmaps and sizes leave no room for enough overlap, or where both nodes lie in one
component already: components come out, not all links. What is left is verified on the whole sets.
Chance candidates chain sets that are not alike into clusters that outgrow the table's
own growth, so a cluster too large for a task is taken apart into stars: a centre with all
classes that share a part with it that it is the first of. Stars too large for a task are
cut into blocks with common pivots, and only sets that these leave apart are compared across blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.llm._components import components
from tastemill.llm._jobs import NO_ID, among, id_key, parts, without, written
from tastemill.llm._text import Words, distinct_by_row, mix, pieces, release_memory, shingles

CLASSES = "doc long, n long, set long, check long"
PARTS = "part long, set long, doc long"
LINKS = "a long, b long"
FANOUT = 16


def _sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle) without repeats, by row and shingle, and the set sizes."""
    rows, hashed = distinct_by_row(*shingles(Words(column, lower=True), k, short=True))
    return rows, hashed, np.bincount(rows, minlength=len(column)) if len(rows) else np.zeros(len(column), np.int64)


def _prints(rows: np.ndarray, hashed: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set: sums of differently scrambled shingles."""
    cuts = np.concatenate([[0], np.cumsum(n)])
    out = []
    for seed in (11, 12):
        sums = np.zeros(len(hashed) + 1, dtype=np.uint64)
        np.cumsum(mix(hashed, seed), out=sums[1:])
        out.append(mix((sums[cuts[1:]] - sums[cuts[:-1]]) + n.astype(np.uint64), seed).astype(np.int64))
    return out[0], out[1]


def _classes(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text"):
        rows, hashed, n = _sets(piece.column(1), k)
        one, two = _prints(rows, hashed, n)
        yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n), pa.array(one), pa.array(two)], names=["doc", "n", "set", "check"])


def _frequent(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Shingles of many sets in a piece, with their numbers of sets; key null: all sets."""
    for piece in pieces(batches, "text"):
        _, hashed, _ = _sets(piece.column(1), k)
        keys, n = np.unique(hashed, return_counts=True)
        often = n >= max(4, piece.num_rows / 500)
        key = pa.array(np.append(keys[often].astype(np.int64), 0), mask=np.append(np.zeros(int(often.sum()), bool), True))
        yield pa.RecordBatch.from_arrays([key, pa.array(np.append(n[often], piece.num_rows).astype(np.int64))], names=["key", "n"])


class Parting:
    """Into how many parts sets of a size are dealt, so that similar sets have an equal part.

    Sizes lie in classes, such that similar sets are in one class or in neighbouring ones;
    every set is dealt once with the class above and once with the one below. Two similar
    sets of a pair of classes differ in at most ``differ`` shingles, so of ``parts`` parts at
    least parts - differ are equal. Parts with fewer than ``strong`` shingles say little. A
    set with at least differ + 1 strong parts can leave them out: one of its equal parts
    is strong. It also needs no more than its first differ + 1 strong parts: the first one
    that is equal in both sets has at most ``differ`` others before it in either. ``parts`` is chosen so that sets usually can.
    """

    def __init__(self, share: tuple[int, int], largest: int):
        p, q = share
        self.bounds = [1, 2]
        while self.bounds[-1] <= largest:
            self.bounds.append(max(self.bounds[-1] + 1, (self.bounds[-1] - 1) * q // p + 1))
        self.bounds.append(max(self.bounds[-1] + 1, (self.bounds[-1] - 1) * q // p + 1))
        differ, parts, strong = [], [], []
        for c in range(len(self.bounds) - 2):
            x = self.bounds[c + 1] - 1
            y = min(self.bounds[c + 2] - 1, x * q // p)
            differ.append((q - p) * (x + y) // (q + p))
            n, s = self._choose(self.bounds[c], differ[-1])
            parts.append(n)
            strong.append(s)
        self.differ, self.parts, self.strong = np.array(differ), np.array(parts), np.array(strong)

    @staticmethod
    def _choose(size: int, differ: int) -> tuple[int, int]:
        if differ == 0:
            return 0, 1  # such sets are similar only if they are equal: they are one class already
        for strong in (4, 3, 2, 1):
            n = np.arange(differ + 1, 4 * differ + 8)
            mean = size / n
            weak = sum(np.exp(-mean) * mean**i / (1, 1, 2, 6)[i] for i in range(strong))
            enough = n * (1 - weak) - 2 * np.sqrt(n * weak * (1 - weak)) > differ
            if enough.any() and size / n[enough.argmax()] >= strong:
                return int(n[enough.argmax()]), strong
        return differ + 1, 1

    @property
    def weakest(self) -> int:
        """The least evidence that large sets are candidates by."""
        return int(self.strong[self.differ > 8].min(initial=4))


def _part_keys(batches: Iterator[pa.RecordBatch], k: int, parting: Parting, hot: np.ndarray, share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Keys of the parts of each set. Very frequent shingles belong to no part: what sets differ by gets no more.

    A set with few strong parts sends all that hold a shingle. Two such sets may be equal in
    empty parts alone, which say nothing: a set that has one also sends its first shingles,
    as many as similar sets need to share one, in an order with very frequent ones last.
    """
    bounds = np.array(parting.bounds)
    for piece in pieces(batches, "text", 2 << 20):
        rows, hashed, n = _sets(piece.column(1), k)
        one, _ = _prints(rows, hashed, n)
        doc = piece.column(0).to_numpy()
        # equal sets of a piece are sent once, for the smallest id
        order = np.lexsort((doc, one))
        first = np.ones(len(order), dtype=bool)
        first[1:] = one[order][1:] != one[order][:-1]
        sent = np.zeros(len(doc), dtype=bool)
        sent[order[first]] = True
        sent &= n > 0
        own = sent[rows]
        common = np.zeros(len(hashed), dtype=bool)
        if len(hot):
            common = hot[np.minimum(np.searchsorted(hot, hashed), len(hot) - 1)] == hashed
        every_row, every_shingle, last = rows[own], hashed[own], common[own]
        rows, hashed = rows[own & ~common], hashed[own & ~common]
        place, value = mix(hashed, 21) >> np.uint64(32), mix(hashed, 22)
        upper = np.searchsorted(bounds, n, "right") - 1
        keys, sets, docs = [], [], []
        for pair in (upper, upper - 1):
            number = np.where(sent & (pair >= 0), parting.parts[np.maximum(pair, 0)], 0)
            base = np.cumsum(number) - number
            total = int(number.sum())
            if not total:
                continue
            mine = number[rows] > 0
            at = base[rows[mine]] + ((place[mine] * number[rows[mine]].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            sums = np.zeros(total, dtype=np.uint64)
            np.add.at(sums, at, value[mine])
            row = np.repeat(np.arange(len(n)), number)
            held = np.bincount(at, minlength=total)
            strong = held >= parting.strong[pair[row]]
            least = parting.differ[np.maximum(pair, 0)] + 1
            plenty = np.bincount(row, strong, minlength=len(n)) >= least
            count = np.concatenate([[0], np.cumsum(strong)])
            early = count[1:] - count[base[row]] <= least[row]
            emit = np.flatnonzero(strong & early | ~plenty[row] & (held > 0))
            name = (pair[row[emit]] << 32).astype(np.uint64) + (emit - base[row[emit]]).astype(np.uint64)
            empty = (np.bincount(row, held == 0, minlength=len(n)) > 0) & ~plenty
            first_row, first_shingle = _first_shingles(every_row, every_shingle, last, np.where(empty, n - (-(-share[0] * n // share[1])) + 1, 0))
            first_name = (pair[first_row] << 32).astype(np.uint64) + np.uint64(1 << 31)
            keys += [mix(sums[emit] + mix(name, 23), 24).astype(np.int64), mix(mix(first_shingle, 22) + mix(first_name, 23), 24).astype(np.int64)]
            sets += [one[row[emit]], one[first_row]]
            docs += [doc[row[emit]], doc[first_row]]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (keys, sets, docs)], names=["part", "set", "doc"])


def _first_shingles(rows: np.ndarray, hashed: np.ndarray, last: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of the first ``wanted`` shingles of each row, those marked ``last`` at the end, the others by a hash."""
    own = wanted[rows] > 0
    rows, hashed, last = rows[own], hashed[own], last[own]
    order = np.lexsort((mix(hashed, 25), last, rows))
    rows, hashed = rows[order], hashed[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    first = place < wanted[rows]
    return rows[first], hashed[first]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (centre, other) from the first class of each part to its others; the input is sorted by (part, set, doc).

    A class is named by its smallest id, which is that of the first of its rows. Stars, not
    chains: the component search then takes few steps, and a centre and its others hold all classes of a part.
    """
    part, last_set, centre = None, None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        parts_, sets, docs = (batch.column(i).to_numpy() for i in range(3))
        new_part = np.append(part is None or parts_[0] != part, parts_[1:] != parts_[:-1])
        at = np.flatnonzero(new_part | np.append(last_set is None or sets[0] != last_set, sets[1:] != sets[:-1]))
        if len(at):
            names, first = docs[at], np.maximum.accumulate(np.where(new_part[at], np.arange(len(at)), -1))
            centres = np.where(first >= 0, names[first], centre)  # a part may go on from the batch before
            pairs = np.stack([centres, names], axis=1)[centres != names]
            pairs = np.unique(pairs, axis=0)
            centre = centres[-1]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
        part, last_set = parts_[-1], sets[-1]


def _members(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(unit, doc, label, shingles) of rows (doc, text, units): a text's set is made once and goes to each of its units."""
    for piece in pieces(batches, "text"):
        rows, hashed, n = _sets(piece.column(1), k)
        cuts = np.concatenate([[0], np.cumsum(n)]).tolist()
        sets = [hashed[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        docs, units = piece.column(0).to_pylist(), piece.column(2).to_pylist()
        out, size = [], 0
        for doc, own, shingle_set in zip(docs, units, sets, strict=True):
            for u in own:
                out.append((u["unit"], doc, u["label"], shingle_set))
                size += len(shingle_set)
                if size > 8 << 20:
                    yield _member_batch(out)
                    out, size = [], 0
        yield _member_batch(out)


def _member_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["unit", "doc", "label", "shingles"])


class Unions:
    def __init__(self, labels: list[int]):
        self.parent = list(range(len(labels)))
        first: dict[int, int] = {}
        for i, label in enumerate(labels):
            self.parent[i] = first.setdefault(label, i)

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, i: int, j: int) -> None:
        self.parent[max(i, j)] = min(i, j)

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.parent))])


class SignatureTree:
    """Sets in the order of their smallest shingle; every node covers FANOUT nodes of the level below."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        n = np.array([len(s) for s in sets])
        bits = 1 << int(np.clip(4 * int(n.max()) - 1, 255, (1 << 16) - 1)).bit_length()
        maps = np.zeros((len(sets), bits // 8), dtype=np.uint8)
        row = np.repeat(np.arange(len(sets)), n)
        bit = (np.concatenate(sets) & np.uint64(bits - 1)).astype(np.int64)
        np.bitwise_or.at(maps, (row, bit >> 3), (1 << (bit & 7)).astype(np.uint8))
        maps = maps.view(np.uint64)
        #: by level, leaves first: bitmaps, smallest and largest size, most shingles that share a bit with another
        self.levels = [(maps, n, n, n - np.bitwise_count(maps).sum(axis=1, dtype=np.int64))]
        while len(self.levels[-1][0]) > 1:
            m, lo, hi, extra = self.levels[-1]
            at = np.arange(0, len(m), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(m, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(extra, at)))

    def possible(self, level: int, i: np.ndarray, j: np.ndarray, share: tuple[int, int]) -> np.ndarray:
        """Whether sets below nodes i and j can be similar, by size and by overlap of the bitmaps."""
        maps, lo, hi, extra = self.levels[level]
        p, q = share
        ok = (q * hi[i] >= p * lo[j]) & (q * hi[j] >= p * lo[i])
        at = np.flatnonzero(ok)
        step = max(1, (1 << 20) // maps.shape[1])
        for a in range(0, len(at), step):
            own = at[a : a + step]
            x, y = i[own], j[own]
            overlap = np.bitwise_count(maps[x] & maps[y]).sum(axis=1, dtype=np.int64) + np.minimum(extra[x], extra[y])
            ok[own] = (p + q) * np.minimum(overlap, np.minimum(hi[x], hi[y])) >= p * (lo[x] + lo[y])
        return ok

    def pairs(self, share: tuple[int, int], wanted: Callable[[int, np.ndarray, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs i < j of sets that may be similar, in bounded portions; pairs of nodes that ``wanted`` denies are not walked."""

        def walk(level: int, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for a in range(0, len(i), 4096):
                x, y = i[a : a + 4096], j[a : a + 4096]
                keep = x < y if level == 0 else x <= y
                if wanted:
                    keep = keep & wanted(level, x, y)
                x, y = x[keep], y[keep]
                keep = self.possible(level, x, y, share)
                x, y = x[keep], y[keep]
                if level == 0:
                    yield x, y
                elif len(x):
                    below, last = np.arange(FANOUT), len(self.levels[level - 1][0])
                    u = (x[:, None] * FANOUT + below).repeat(FANOUT, axis=1).ravel()
                    v = np.tile(y[:, None] * FANOUT + below, (1, FANOUT)).ravel()
                    keep = (u < last) & (v < last) & (u <= v)
                    yield from walk(level - 1, u[keep], v[keep])

        return walk(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))

    def similar(self, i: int, j: int, share: tuple[int, int]) -> bool:
        x, y = self.sets[i], self.sets[j]
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        both = int((y[at] == x).sum())
        return share[1] * both >= share[0] * (len(x) + len(y) - both)


def links(docs: list[int], labels: list[int], sets: list[np.ndarray], share: tuple[int, int]) -> list[tuple[int, int]]:
    """Links that join the components of some sets; sets with one label count as joined already."""
    order = sorted(range(len(docs)), key=lambda i: (int(sets[i][0]), len(sets[i]), docs[i]))
    docs, labels, sets = [docs[i] for i in order], [labels[i] for i in order], [sets[i] for i in order]
    tree, unions, out = SignatureTree(sets), Unions(labels), []

    def settle(i: np.ndarray, j: np.ndarray) -> None:
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            x, y = unions.find(a), unions.find(b)
            if x != y and tree.similar(a, b, share):
                unions.join(x, y)
                out.append((docs[a], docs[b]))

    near = np.arange(len(docs) - 1)  # neighbours first: copies lie side by side, and joined nodes need no walk
    near = near[tree.possible(0, near, near + 1, share)]
    settle(near, near + 1)

    def apart(level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        root = unions.roots()
        at = np.arange(0, len(root), FANOUT**level)
        least, most = np.minimum.reduceat(root, at), np.maximum.reduceat(root, at)
        return ~((least[i] == most[i]) & (least[j] == most[j]) & (least[i] == least[j]))

    for i, j in tree.pairs(share, apart):
        settle(i, j)
    return out


def _join(batches: Iterator[pa.RecordBatch], share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Links of each unit; the input is sorted by unit."""

    def rows() -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("unit", "doc", "label", "shingles")), strict=True)

    found: list[tuple[int, int]] = []
    for _, own in groupby(rows(), key=lambda r: r[0]):
        members = {(r[1], r[3]): r for r in own if r[3]}
        if len(members) > 1:
            own = list(members.values())
            found += links([r[1] for r in own], [r[2] for r in own], [np.frombuffer(r[3], np.uint64) for r in own], share)
        if len(found) > 10_000:
            yield _links(found)
            found = []
    release_memory()
    yield _links(found)


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])


def _tree_join(texts: DataFrame, units: DataFrame, k: int, share: tuple[int, int], name: str) -> DataFrame:
    """Links of units (unit, member, label, n): one task holds the sets of a unit.

    Texts that are in no unit are not shuffled; the others are once, and their sets go on to their units.
    """
    spark = texts.sparkSession
    own = units.groupBy("member").agg(F.collect_set(F.struct("unit", "label")).alias("units"))
    rows = among(texts, ["doc"], own, ["member"]).select("doc", "text", "units")
    sets = rows.mapInArrow(lambda b: _members(b, k), "unit long, doc long, label long, shingles binary")
    n = parts(spark, 8 * (units.agg(F.sum("n")).first()[0] or 0), 48 << 20)
    return written(sets.repartition(n, "unit").sortWithinPartitions("unit", "doc").mapInArrow(lambda b: _join(b, share), LINKS), name)


def _candidates(docs: DataFrame, k: int, share: tuple[int, int]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The rows' sets (doc, n, set, check), their classes (n, set, check, rep, copies), clusters of reps (node, root) that may be similar, and the stars (a, b) that make them."""
    rows = written(docs.mapInArrow(lambda b: _classes(b, k), CLASSES), "join-classes")
    classes = rows.where("n > 0").groupBy("n", "set", "check").agg(F.min("doc").alias("rep"), F.count("*").alias("copies"))

    largest, tokens = rows.agg(F.max("n"), F.sum("n")).first()
    parting = Parting(share, int(largest or 1))
    hot = _hot(docs, k, rows) if parting.weakest < 3 else np.zeros(0, np.uint64)
    keys = docs.mapInArrow(lambda b: _part_keys(b, k, parting, hot, share), PARTS)
    n = parts(docs.sparkSession, 24 * (tokens or 0) * 5 * (share[1] - share[0]) / share[1] / 2)
    stars = written(keys.repartition(n, "part").sortWithinPartitions("part", "set", "doc").mapInArrow(_neighbours, LINKS).distinct(), "join-stars")
    return rows, classes, components(stars), stars


def _bounded(members: DataFrame, most: int, memory: int) -> tuple[DataFrame, DataFrame]:
    """Members (cluster, member, n) of clusters that a task holds, as units, and those of the others, with a number of blocks."""
    loads = members.groupBy("cluster").agg(F.count("*").alias("sets"), F.sum("n").alias("load"))
    large = loads.where((F.col("sets") > most) | (8 * F.col("load") > memory)).select(F.col("cluster").alias("large"), F.ceil(F.greatest(2 * F.col("sets") / most, 16 * F.col("load") / memory)).cast("long").alias("blocks"))
    marked = members.join(large, F.col("cluster") == F.col("large"), "left")
    small = marked.where("large is null").select(F.col("cluster").alias("unit"), "member", F.col("member").alias("label"), "n")
    return small, written(marked.where("large is not null").select("cluster", "member", "n", "blocks"), "join-large")


def _star_members(stars: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, member, n): each centre of some members with its others. Classes of one part are all in the star of its centre."""
    sizes = members.select("member", "n")
    centres = stars.select("a").distinct().select(F.col("a").alias("cluster"), F.col("a").alias("other"))
    return stars.select(F.col("a").alias("cluster"), F.col("b").alias("other")).unionByName(centres).join(sizes, F.col("other") == F.col("member")).select("cluster", "member", "n")


def similar_groups(df: DataFrame, k: int = 3, share: tuple[int, int] = (9, 10), most: int = 2048, memory: int = 24 << 20) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of (doc_id, text).

    A row's set holds the distinct ``k``-word shingles of its whole text, A-Z lower-cased,
    words being runs of bytes other than ``[\\x20\\x09-\\x0D]``; with fewer words, their whole
    sequence. Rows link if the Jaccard similarity of their sets is at least
    share[0] / share[1]; component_id is the smallest doc_id that links lead to, itself
    included. Shingles are compared by 64-bit hashes. ``most`` sets or ``memory`` bytes of
    shingles are the most that one task holds at a time.

    Null, empty and blank texts have no shingles and link with nothing, themselves included.
    Null doc_id is smaller than any other; it shows as null. Rows that repeat an id are one
    document, with the links of all of them. Empty table: no rows. Other columns are ignored.
    """
    spark = df.sparkSession
    docs = df.select(id_key().alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows, classes, clusters, stars = _candidates(docs, k, share)
    sizes = classes.select("rep", "n").groupBy("rep").agg(F.sum("n").alias("n"))
    members = written(clusters.join(sizes, F.col("node") == F.col("rep")).select(F.col("root").alias("cluster"), F.col("node").alias("member"), "n"), "join-members")
    small, large = _bounded(members, most, memory)
    found = _tree_join(docs, small, k, share, "join-links")
    if not large.isEmpty():
        small, large = _bounded(written(_star_members(stars, large), "join-star-members"), most, memory)
        found = found.unionByName(_tree_join(docs, small, k, share, "join-star-links"))
    if not large.isEmpty():
        found = found.unionByName(_large_clusters(docs, large, k, share))
    roots = components(found)
    labels = classes.join(roots, F.col("rep") == F.col("node"), "left").select(F.col("n").alias("n_"), F.col("set").alias("set_"), F.col("check").alias("check_"), F.coalesce("root", "rep").alias("component"))
    out = rows.join(labels, (F.col("n") == F.col("n_")) & (F.col("set") == F.col("set_")) & (F.col("check") == F.col("check_")), "left")
    out = out.select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(F.coalesce("component", "doc"), F.lit(NO_ID)).alias("component_id"))
    return out


def _hot(docs: DataFrame, k: int, rows: DataFrame) -> np.ndarray:
    """Shingles of more than a thousandth of all documents, the most frequent 65,536 at most: which ones they are changes no link."""
    counted = docs.mapInArrow(lambda b: _frequent(b, k), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    often = counted.where(F.col("key").isNotNull() & (F.col("n") > max(8, rows.count() // 1000))).orderBy(F.desc("n"), "key").limit(1 << 16).select("key").collect()
    return np.sort(np.array([r[0] for r in often], dtype=np.int64).astype(np.uint64))


def _large_clusters(docs: DataFrame, large: DataFrame, k: int, share: tuple[int, int], pivots: int = 8) -> DataFrame:
    """Links of clusters beyond one task.

    First, blocks by hash are joined within, each together with the cluster's pivots (about
    ``pivots`` members). Sets that then lie outside their cluster's largest
    component are joined with every block.
    """
    # pivots: members whose hash lies below a bound that about ``pivots`` of them pass
    bound = large.groupBy(F.col("cluster").alias("c")).agg((F.lit(-(2.0**63)) + F.lit(2.0**64) * pivots / F.count("*")).alias("bound"))
    chosen = large.join(bound, F.col("cluster") == F.col("c")).where(F.xxhash64("member").cast("double") <= F.col("bound"))
    block = lambda b: F.xxhash64("cluster", b)
    own = large.select(block(F.pmod(F.xxhash64("member"), F.col("blocks"))).alias("unit"), "member", F.col("member").alias("label"), "n")
    everywhere = chosen.select("cluster", "member", "n", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b")).select(block(F.col("b")).alias("unit"), "member", F.col("member").alias("label"), "n")
    found = _tree_join(docs, own.unionByName(everywhere).distinct(), k, share, "join-blocks")
    roots = components(found)
    now = written(large.join(roots, F.col("member") == F.col("node"), "left").select("cluster", "member", "n", "blocks", F.coalesce("root", "member").alias("label")), "join-labels")
    parts_ = now.groupBy("cluster", "label").count().groupBy(F.col("cluster").alias("c")).agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count("*").alias("components"))
    apart = now.join(parts_.where("components > 1"), F.col("cluster") == F.col("c")).drop("c", "components")
    open_ = written(apart.select("cluster", "member", "n", "blocks", "label", (F.col("label") != F.col("main")).alias("lone")), "join-apart")
    # what is joined already goes on as one link a member, not as all links found
    found = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    if open_.isEmpty():
        return found
    # sets outside the main component, in groups of a block's size, meet every block of their cluster
    groups = open_.where("lone").groupBy(F.col("cluster").alias("c")).agg(F.count("*").alias("lones"))
    sizes = open_.groupBy(F.col("cluster").alias("c2")).agg(F.count("*").alias("all"))
    both = open_.join(groups.join(sizes, F.col("c") == F.col("c2")), F.col("cluster") == F.col("c")).withColumn("g", F.ceil(F.col("lones") * F.col("blocks") / F.col("all")))
    unit = F.xxhash64("cluster", "i", "j")
    lone = both.where("lone").withColumn("i", F.pmod(F.xxhash64("member"), F.col("g"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    every = both.withColumn("j", F.pmod(F.xxhash64("member"), F.col("blocks"))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g").cast("long") - 1)))
    columns = [unit.alias("unit"), "member", "label", "n"]
    crossed = _tree_join(docs, lone.select(*columns).unionByName(every.select(*columns)).distinct(), k, share, "join-cross")
    return found.unionByName(crossed)


def _named_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(doc, set, check, shingles) of rows (doc, text)."""
    for piece in pieces(batches, "text"):
        rows, hashed, n = _sets(piece.column(1), k)
        one, two = _prints(rows, hashed, n)
        cuts = np.concatenate([[0], np.cumsum(n)]).tolist()
        sets = pa.array([hashed[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(one), pa.array(two), sets], names=["doc", "set", "check", "shingles"])


def _tally(batches: Iterator[pa.RecordBatch], share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """(set, check, links): the copies of the sets that a set is similar to in its unit; the input is sorted by unit.

    Sets of side 2 meet all of their unit, sets of sides 0 and 1 only each other.
    """

    def rows() -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("unit", "side", "set", "check", "copies", "shingles")), strict=True)

    for _, own in groupby(rows(), key=lambda r: r[0]):
        members = list({(r[2], r[3]): r for r in own}.values())
        sets = [np.frombuffer(r[5], np.uint64) for r in members]
        order = sorted(range(len(sets)), key=lambda i: (int(sets[i][0]), len(sets[i])))
        members, sets = [members[i] for i in order], [sets[i] for i in order]
        side, copies, found = np.array([r[1] for r in members]), [r[4] for r in members], [0] * len(members)
        tree = SignatureTree(sets)
        for i, j in tree.pairs(share):
            meet = (side[i] != side[j]) | (side[i] == 2)
            for a, b in zip(i[meet].tolist(), j[meet].tolist(), strict=True):
                if tree.similar(a, b, share):
                    found[a] += copies[b]
                    found[b] += copies[a]
        yield pa.RecordBatch.from_arrays([pa.array([r[2] for r in members], pa.int64()), pa.array([r[3] for r in members], pa.int64()), pa.array(found, pa.int64())], names=["set", "check", "links"])
    release_memory()


def link_counts(df: DataFrame, k: int = 3, share: tuple[int, int] = (9, 10), most: int = 2048, memory: int = 24 << 20) -> DataFrame:
    """(doc_id, n_shingles, n_links) of each row of (doc_id, text): the number of other rows that it links with.

    Sets, links and bounds are those of similar_groups, but every pair of a cluster that the
    signature trees leave is verified, also where both are in one component already; no pair
    is sent out. Clusters beyond a task are cut into blocks, and each block meets each: that
    is quadratic in a cluster's different sets, as the links themselves are. Equal sets are
    one set with a number of copies.

    Null, empty and blank texts link with nothing: 0. Rows that repeat an id or a text count
    one by one. Null doc_id shows as null. Empty table: no rows. Other columns are ignored.
    """
    spark = df.sparkSession
    docs = df.select(id_key().alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows, classes, clusters, _ = _candidates(docs, k, share)
    members = written(classes.join(clusters, F.col("rep") == F.col("node")).select(F.col("root").alias("cluster"), "rep", "set", "check", "n", "copies"), "links-members")
    blocks = F.when((F.count("*") > most) | (8 * F.sum("n") > memory), F.ceil(F.greatest(2 * F.count("*") / most, 16 * F.sum("n") / memory))).otherwise(1).cast("long")
    loads = members.groupBy(F.col("cluster").alias("c")).agg(F.count("*").alias("sets"), blocks.alias("blocks")).where("sets > 1")
    own = F.pmod("set", "blocks")
    units = members.join(loads, F.col("cluster") == F.col("c")).withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    units = units.select(F.xxhash64("cluster", F.least("block", "other"), F.greatest("block", "other")).alias("unit"), side.alias("side"), F.col("rep").alias("member"), F.col("set").alias("set_"), F.col("check").alias("check_"), "copies", "n")
    sets = among(docs, ["doc"], members.select("rep").distinct(), ["rep"]).select("doc", "text").mapInArrow(lambda b: _named_sets(b, k), "doc long, set long, check long, shingles binary")
    dealt = sets.join(units, (F.col("doc") == F.col("member")) & (F.col("set") == F.col("set_")) & (F.col("check") == F.col("check_")))
    n = parts(spark, 8 * (units.agg(F.sum("n")).first()[0] or 0), 48 << 20)
    dealt = dealt.select("unit", "side", "set", "check", "copies", "shingles").repartition(n, "unit").sortWithinPartitions("unit", "set", "check")
    counted = dealt.mapInArrow(lambda b: _tally(b, share), "set long, check long, links long").groupBy("set", "check").agg(F.sum("links").alias("links"))
    counted = classes.join(counted, ["set", "check"], "left").select(F.col("n").alias("n_"), F.col("set").alias("set_"), F.col("check").alias("check_"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    out = rows.join(counted, (F.col("n") == F.col("n_")) & (F.col("set") == F.col("set_")) & (F.col("check") == F.col("check_")), "left")
    return out.select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("links", F.lit(0).cast("long")).alias("n_links"))


def drop_similar(df: DataFrame, k: int = 5, share: tuple[int, int] = (8, 10)) -> DataFrame:
    """The rows of ``df``, all columns, whose doc_id is the smallest of its group of similar rows (see similar_groups).

    Null, empty and blank texts are similar to nothing and stay. Null doc_id is smaller than
    any other. Rows that repeat an id stay or go together. Empty table: no rows. Columns may
    have any names.
    """
    groups = similar_groups(df.select("doc_id", "text"), k, share)
    gone = groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("gone")).distinct()
    return without(df, written(gone, "join-dropped"), {"gone": id_key()})


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END) AS x FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
edge AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
root AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM root LEFT JOIN n USING (doc_id)
"""
