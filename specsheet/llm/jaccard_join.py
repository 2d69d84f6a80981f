"""N-gram Jaccard join: token-combination prefixes, then exact verification.

A document's tokens are the distinct shingles of ``n`` words as 64-bit hashes, in hash order.
Documents with equal sets are one class and take part once. If ``x`` links with ``y``, at most
``t = floor((1 - similarity) * |x|)`` tokens of ``x`` are missing from ``y``. A token is frequent if
more than ``frequent`` classes have it in their prefix. The prefix of ``x`` is extended until
its rare tokens, plus for each subclass of frequent tokens one less than it has of them, exceed
``t``: two linked classes then share a rare token or two frequent tokens of one subclass, so rare
tokens are indexed alone and frequent ones in pairs within their subclass. The number of
subclasses grows with set size by levels of four; a class near the next level is indexed for both.

A class whose size fits no class of another component in an entry leaves that entry. Classes that share an index
entry are compared in units of two blocks of at most ``block`` classes, whatever an entry's size. In entries
of several blocks all classes first meet a few leaders, so near copies of one template become one
component in linear time; later its blocks are compared with the entry's other classes alone, never with
each other.
Inside a unit, sizes and parity bitmaps (the bits that differ never exceed
the tokens that differ) discard pairs that cannot link. Three rounds hand on what remains: a
spanning forest, closest pairs first, from a few entries of each class; one between components from
all entries; then, in units of which the second round left pairs out, every pair between different
components. Each round's pairs are verified on their texts, and components follow from the verified links, so a group's pairs are never written in
full and no link between components is lost. An entry of many blocks repeats its classes in many units, and many pairs repeat their
texts: both are dealt out in turns of a bounded number of rows a document, so the disk in use grows with the input.

Cases: null and wordless texts have an empty set and link with nothing; a text of fewer than ``n``
words has one token; repeated rows and equal ids are equal sets; a null id takes no part and
has no component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch, own_names
from .words import HashedText, Runs, hashed_texts, joint_codes, mix, text_bytes

_SETS = "doc_id long, text_hash long, n long, low long, high long, prefix array<long>, bits binary"
PAIRS = 1 << 18  # pairs of a unit held at a time
UNIT_ROWS, TEXT_PAIRS = 1 << 16, 1 << 12  # of a turn, at least


def shingles(text: HashedText, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct token hashes of a text, and an independent second hash of each."""
    if not len(text.one):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    starts = np.arange(max(1, len(text.one) - n + 1))
    ends = np.minimum(starts + n, len(text.one))
    tokens, first = np.unique(Runs(text.one).hashes(starts, ends), return_index=True)
    return tokens, Runs(text.two).hashes(starts[first], ends[first])


def texts_link(a: bytes, b: bytes, n: int, percent: int) -> bool:
    """Whether two texts with words link, by their shingles themselves."""
    x, y = joint_codes([a, b], n)
    if isinstance(x, tuple) or isinstance(y, tuple):  # fewer than n words: one shingle, equal to none but its like
        return isinstance(x, tuple) and isinstance(y, tuple) and x == y
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def level(size: int) -> int:
    """0 below 16 tokens, then one more for every factor of four."""
    return 0 if size < 16 else (size.bit_length() - 3) // 2


def levels(size: int, percent: int) -> list[int]:
    """The levels at which a class of this size is indexed: its own and that of its largest partner."""
    return sorted({level(size), level(100 * size // percent)})


def subclass(tokens: np.ndarray, at_level: int) -> np.ndarray:
    """Subclass of each token at a level; as many as a sixteenth of the level's least size."""
    return (tokens >> np.uint64(7)) % np.uint64(4 ** max(0, at_level - 1))


def prefix_length(tokens: np.ndarray, frequent: np.ndarray, missing: int, at_level: int) -> int:
    """The shortest prefix whose index entries cannot all be lost with ``missing`` tokens; ``frequent``
    says which tokens are frequent."""
    groups = subclass(tokens, at_level)
    first = np.zeros(len(tokens), bool)
    at = np.flatnonzero(frequent)
    first[at[np.unique(groups[at], return_index=True)[1]]] = True  # a subclass's first token adds nothing
    worth = np.cumsum(~first)
    return min(len(tokens), int(np.searchsorted(worth, missing + 1)) + 1)


def longest_prefix(tokens: np.ndarray, percent: int) -> int:
    """A prefix long enough whichever of its tokens are frequent."""
    missing = len(tokens) * (100 - percent) // 100
    return max(prefix_length(tokens, np.ones(len(tokens), bool), missing, at) for at in levels(len(tokens), percent))


def bitmap(tokens: np.ndarray) -> bytes:
    """Parity of the tokens that fall on each bit. Never fewer bits than tokens: sets that share nothing differ in
    nearly half of the bits, and linked ones must differ in fewer."""
    size = 1024
    while size < len(tokens):
        size *= 4
    counts = np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits(counts.astype(np.uint8) & 1).tobytes()


def token_sets(rows: DataFrame, n: int, percent: int) -> DataFrame:
    def build(batches):
        for batch in (whole.slice(at, 1 << 11) for whole in batches for at in range(0, whole.num_rows, 1 << 11)):
            out: list[list] = [[] for _ in range(5)]
            for text in hashed_texts(batch.column(2), lower=True):
                tokens, second = shingles(text, n)
                sums = [int(np.add.reduce(v)) if len(v) else 0 for v in (mix(tokens), second)]
                prefix = tokens[: longest_prefix(tokens, percent)].copy() if len(tokens) else tokens  # the others are let go
                for column, value in zip(out, (len(tokens), *np.array(sums, np.uint64).view(np.int64).tolist(),
                                               prefix.view(np.int64), bitmap(tokens))):
                    column.append(value)
            types = [pa.int64()] * 3 + [pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(c, t) for c, t in zip(out, types)]], names=names)

    names = [c.split()[0] for c in _SETS.split(", ")]
    return rows.mapInArrow(build, _SETS)


def index_entries(shared: DataFrame, percent: int) -> DataFrame:
    """Index entries of each class from its shared prefix tokens (``place`` in the prefix, ``token``,
    ``frequent``)."""

    def index(batches):
        for frame in batches:
            ids, sizes, entries = [], [], []
            for doc_id, size, tokens in zip(frame["id"].tolist(), frame["n"].tolist(), frame["tokens"]):
                tokens = sorted((t["place"], t["token"], t["frequent"]) for t in tokens)
                place = np.array([t[0] for t in tokens])
                token = np.array([t[1] for t in tokens], np.int64).view(np.uint64)
                often = np.array([t[2] for t in tokens], bool)
                missing = size * (100 - percent) // 100
                found = []
                for at in levels(size, percent):
                    groups = subclass(token, at)
                    first = np.zeros(len(token), bool)
                    some = np.flatnonzero(often)
                    first[some[np.unique(groups[some], return_index=True)[1]]] = True
                    # tokens of no other class are not here, but they have places and are rare
                    inside = place - (np.cumsum(first) - first) <= missing
                    found.append(mix(token[inside & ~often] ^ np.uint64(11)))
                    some = np.flatnonzero(inside & often)
                    some = some[np.argsort(groups[some], kind="stable")]
                    for members in np.split(some, np.flatnonzero(np.diff(groups[some])) + 1):
                        i, j = np.triu_indices(len(members), 1)
                        found.append(mix(mix(token[members[i]] + np.uint64(at)) ^ token[members[j]]))
                got = np.unique(np.concatenate(found))
                ids.append(np.full(len(got), doc_id, np.int64))
                sizes.append(np.full(len(got), size, np.int64))
                entries.append(got.view(np.int64))
            parts = {"id": ids, "n": sizes, "entry": entries}
            yield pd.DataFrame({c: np.concatenate(v) if v else [] for c, v in parts.items()})

    return shared.mapInPandas(index, "id long, n long, entry long")


def with_partners(rows: DataFrame, percent: int) -> DataFrame:
    """``rows`` (``unit, id, n, root`` and others) without the classes whose size fits no class of
    another component in their entry. In order of size the nearest such classes fit best; they lie
    beside the run of one component. For entries of one block, which are bounded."""
    for side, order in (("below", ["n", "id"]), ("above", [F.desc("n"), F.desc("id")])):
        by_size = Window.partitionBy("unit").orderBy(*order)
        before = F.struct(F.lag("n").over(by_size).alias("n"), F.lag("root").over(by_size).alias("root"))
        rows = rows.withColumn("before", before)
        nearest = F.last(F.when(F.col("before.root") != F.col("root"), F.col("before.n")), ignorenulls=True).over(by_size)
        rows = rows.withColumn(side, nearest).drop("before")
    fits = (100 * F.col("below") >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.col("above"))
    return rows.where(fits).drop("below", "above")


class Bitmaps:
    """The bitmaps of many rows as one matrix per size; longer ones are also there folded."""

    def __init__(self, bits: list[bytes]):
        self.length = np.array([len(x) for x in bits])
        self.rows, self.maps = {}, {}
        folded, have = np.zeros((0, 0), np.uint64), np.zeros(0, np.int64)
        for size in sorted(set(self.length.tolist()), reverse=True):
            own = np.flatnonzero(self.length == size)
            matrix = np.frombuffer(b"".join([bits[i] for i in own.tolist()]), np.uint64).reshape(len(own), -1)
            if len(have):
                folded = np.bitwise_xor.reduce(folded.reshape(len(have), -1, size // 8), axis=1)
                matrix, own = np.concatenate([folded, matrix]), np.concatenate([have, own])
            folded, have = matrix, own
            place = np.zeros(len(bits), np.int64)
            place[own] = np.arange(len(own))
            self.rows[size], self.maps[size] = place, matrix

    def within(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs differ in at most ``most`` bits, and in how many. A quarter of the bits is
        enough to discard most pairs."""
        kept, differing = [], []
        least = np.minimum(self.length[a], self.length[b])
        for size in np.unique(least).tolist():
            rows, maps, quarter = np.flatnonzero(least == size), self.maps[size], size // 32
            step = max(1, (1 << 22) // size)  # as many bytes whatever the size
            for cut in range(0, len(rows), step):
                some = rows[cut : cut + step]
                p, q = self.rows[size][a[some]], self.rows[size][b[some]]
                part = np.bitwise_count(maps[p, :quarter] ^ maps[q, :quarter]).sum(axis=1, dtype=np.int64)
                near = part <= most[some]
                some, p, q = some[near], p[near], q[near]
                part = part[near] + np.bitwise_count(maps[p, quarter:] ^ maps[q, quarter:]).sum(axis=1, dtype=np.int64)
                near = part <= most[some]
                kept.append(some[near])
                differing.append(part[near])
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *kept]), np.concatenate([none, *differing])


def spanning_forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray, nodes: int) -> np.ndarray:
    """Edges of a minimum spanning forest: every component takes its lightest edge, round by round."""
    order = np.lexsort((b, a, weight))
    root, kept = np.arange(nodes), []
    while len(order):
        p, q = root[a[order]], root[b[order]]
        order, p, q = order[p != q], p[p != q], q[p != q]
        if not len(order):
            break
        ends = np.stack([p, q], axis=1).ravel()  # edges are sorted: the first one of a node is its lightest
        node, first = np.unique(ends, return_index=True)
        edge = first // 2
        kept.append(order[np.unique(edge)])
        parent = np.arange(nodes)
        parent[node] = p[edge] + q[edge] - node
        both = parent[parent[node]] == node  # two that took the same edge: the smaller is the root
        parent[node[both & (node < parent[node])]] = node[both & (node < parent[node])]
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        root = parent[root]
    return np.concatenate([np.zeros(0, np.int64), *kept])


class Forest:
    """A running minimum spanning forest of weighted links between nodes; ``met`` counts the links seen per
    unit (the node's), and links beyond ``PAIRS`` are folded in as they come."""

    def __init__(self, nodes: int):
        self.nodes, self.kept, self.new, self.waiting = nodes, np.zeros((5, 0), np.int64), [], 0

    def add(self, links: np.ndarray) -> None:
        """``links``: first node, second node, weight and the two ends, one row each."""
        self.new.append(links)
        self.waiting += links.shape[1]
        if self.waiting > PAIRS:
            self.fold()

    def fold(self) -> np.ndarray:
        links = np.concatenate([self.kept, *self.new], axis=1)
        self.kept = links[:, spanning_forest(links[0], links[1], links[2], self.nodes)]
        self.new, self.waiting = [], 0
        return self.kept


def unit_pairs(frame: pd.DataFrame, percent: int, every: bool) -> Iterator[pd.DataFrame]:
    """Pairs of different components that can link from whole units, rows sorted by unit: ``every``
    one, or those of a spanning forest of a unit's components; then also a row for each ``unit`` that
    has more. Never more than about ``PAIRS`` pairs are held."""
    new = np.any([frame[c].to_numpy()[1:] != frame[c].to_numpy()[:-1] for c in ("unit", "i", "j")], axis=0)
    first = np.flatnonzero(np.append(True, new))
    size = np.diff(np.append(first, len(frame)))
    last = np.repeat(first + size, size)
    n, block, root = (frame[c].to_numpy() for c in ("n", "block", "root"))
    two = frame["i"].to_numpy() != frame["j"].to_numpy()
    bitmaps, ids = Bitmaps(frame["bits"].tolist()), frame["id"].to_numpy()
    unit = np.searchsorted(first, np.arange(len(frame)), side="right") - 1
    node = np.unique(np.stack([unit, root]), axis=1, return_inverse=True)[1].ravel()  # a component in a unit
    forest, met = Forest(len(frame)), np.zeros(len(first), np.int64)

    def rows(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        found = pd.DataFrame({"a": np.minimum(ids[a], ids[b]), "b": np.maximum(ids[a], ids[b])}, dtype="Int64")
        return found.drop_duplicates().assign(unit=pd.NA).astype("Int64")

    at, step = np.arange(len(frame)), 0
    while len(at):
        step += 1
        at = at[at + step < last[at]]
        for cut in range(0, len(at), PAIRS):
            some = at[cut : cut + PAIRS]
            other = some + step
            n_a, n_b = n[some], n[other]
            can = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
            can &= (root[some] != root[other]) & (~two[some] | (block[some] != block[other]))
            a, b = some[can], other[can]
            least = -(-percent * (n[a] + n[b]) // (100 + percent))  # of tokens that linked sets share
            good, differ = bitmaps.within(a, b, n[a] + n[b] - 2 * least)
            a, b = a[good], b[good]
            if not every:
                met += np.bincount(unit[a], minlength=len(first))
                forest.add(np.stack([node[a], node[b], differ, a, b]))
            elif len(a):
                yield rows(a, b)
    if not every:
        _, _, _, a, b = forest.fold()
        left_out = met > np.bincount(unit[a], minlength=len(first))
        yield rows(a, b)
        more = frame["unit"].to_numpy()[first[left_out]]
        yield pd.DataFrame({"a": pd.NA, "b": pd.NA, "unit": more}).astype("Int64")


def possible_pairs(units: DataFrame, percent: int, every: bool) -> DataFrame:
    """``unit_pairs`` of all units; a task reads sorted units and holds a batch and one unit at most."""

    def pairs(batches):
        rest = None
        for frame in batches:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            end = frame.iloc[-1] if len(frame) else None
            if end is None:
                continue
            tail = ((frame["unit"] == end["unit"]) & (frame["i"] == end["i"]) & (frame["j"] == end["j"])).to_numpy()
            rest, frame = frame[tail], frame[~tail].reset_index(drop=True)
            if len(frame):
                yield from unit_pairs(frame, percent, every)
        if rest is not None:
            yield from unit_pairs(rest.reset_index(drop=True), percent, every)

    keys = ["unit", "i", "j"]
    return units.repartition(*keys).sortWithinPartitions(*keys, "id").mapInPandas(pairs, "a long, b long, unit long").distinct()


def turns_of(df: DataFrame, keys: list[str], rows: int, most: int) -> list[DataFrame]:
    """``df``, of about ``rows`` rows, in as few parts as leave each about ``most``; rows with equal ``keys`` stay together."""
    turns = max(1, -(-rows // max(1, most)))
    if turns == 1:
        return [df]
    turn = F.pmod(F.xxhash64(*keys, F.lit(23)), F.lit(turns))
    return [df.where(turn == k) for k in range(turns)]


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs of classes whose texts link, by their shingles as written; ``texts``: one per class."""

    def verify(batches):
        for batch in batches:
            a, b = (text_bytes(batch.column(c)) for c in (2, 3))
            keep = [texts_link(a[0][a[1][i] : a[1][i + 1]].tobytes(), b[0][b[1][i] : b[1][i + 1]].tobytes(), n, percent) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    left = texts.select(F.col("id").alias("a_id"), F.col("text").alias("a_text"))
    right = texts.select(F.col("id").alias("b_id"), F.col("text").alias("b_text"))
    both = pairs.join(left, F.col("a") == F.col("a_id")).join(right, F.col("b") == F.col("b_id"))
    return both.select("a", "b", "a_text", "b_text").mapInArrow(verify, "a long, b long")


def link_documents(docs: DataFrame, n: int = 3, percent: int = 90, frequent: int = 40, block: int = 1024, leaders: int = 32,
                   broadcast_ids: int = 1_000_000, turn_rows: float = 6, turn_pairs: float = 0.25) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles`` and ``component_id``. At a time at most about ``turn_rows`` rows of units
    and ``turn_pairs`` pairs with their texts are shuffled per document."""
    scratch = Scratch(docs.sparkSession, "jaccard-join")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    key = ["n", "low", "high"]
    sets = scratch.table(token_sets(rows, n, percent), "sets")
    size = sets.count()
    members = scratch.table(sets.select("doc_id", *key), "members", size)
    classes = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy(*key).agg(
        F.min(F.struct("doc_id", "text_hash")).alias("of"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    classes = scratch.table(classes.withColumn("id", F.monotonically_increasing_id()), "classes", 8 * size)  # a name per written row
    scratch.drop("sets")

    tokens = classes.select("id", "n", F.posexplode("prefix").alias("place", "token"))
    common = scratch.table(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1").select(
        F.col("token").alias("shared"), (F.col("classes") > frequent).alias("frequent")), "common", 8 * size)
    shared = tokens.join(common, F.col("token") == F.col("shared")).groupBy("id", "n").agg(
        F.collect_list(F.struct("place", "token", "frequent")).alias("tokens"))  # bounded by a document
    entries = scratch.table(index_entries(shared, percent), "entries", 8 * size)
    scratch.drop("common")
    # Entries with the same classes would compare the same pairs: one of them stays.
    counts = entries.groupBy("entry").agg(
        F.count(F.lit(1)).alias("m"), F.expr("bit_xor(xxhash64(id))").alias("who"), F.expr("bit_xor(xxhash64(id, 7))").alias("also")
    ).where("m > 1").groupBy("m", "who", "also").agg(F.min("entry").alias("unit"))
    counts = scratch.table(counts.select("unit", F.ceil(F.col("m") / block).cast("int").alias("blocks")), "counts", 4 * size)
    found = entries.join(counts, F.col("entry") == F.col("unit")).select("unit", "id", "n", "blocks", F.col("id").alias("root"))
    found = with_partners(found.where("blocks = 1"), percent).unionByName(found.where("blocks > 1")).drop("root")
    found = scratch.table(found.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("unit"))), "found", 8 * size)
    scratch.drop("entries", "counts")
    sketch = classes.select(F.col("id").alias("own"), "bits")

    def units(rows: DataFrame) -> DataFrame:
        """Classes, once per pair of blocks that theirs belongs to. An entry's largest component has blocks of its
        own, which are not compared with each other."""
        mark, major = F.xxhash64("id", "unit"), F.col("root").eqNullSafe(F.col("major"))
        own = F.when(major, F.pmod(mark, F.col("major_blocks"))).otherwise(F.col("major_blocks") + F.pmod(mark, F.col("minor_blocks"))).cast("int")
        first = F.when(major, F.col("major_blocks")).otherwise(F.lit(0))
        others = F.sequence(first, F.col("major_blocks") + F.col("minor_blocks") - 1)
        return in_units(rows.select("unit", "id", "n", "root", own.alias("block"), F.explode(others).alias("with")))

    def in_units(blocks: DataFrame) -> DataFrame:
        return blocks.select("unit", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "id", "n", "root")

    def with_sketch(blocks: DataFrame) -> DataFrame:
        return blocks.join(sketch, F.col("id") == F.col("own")).select("unit", "i", "j", "block", "id", "n", "bits", "root")

    def met(blocks: DataFrame, every: bool, name: str, rows: int) -> DataFrame:
        """The written pairs of units of about ``rows`` rows in all, found in turns; the sketches join a turn's rows alone."""
        parts = turns_of(blocks, ["unit", "i", "j"], rows, max(int(turn_rows * size), UNIT_ROWS))
        found = [scratch.table(possible_pairs(with_sketch(p), percent, every), f"{name}-pairs-{k}" if len(parts) > 1 else f"{name}-pairs", 4 * size)
                 for k, p in enumerate(parts)]
        return found[0] if len(found) == 1 else scratch.table(reduce(DataFrame.unionByName, found).distinct(), f"{name}-pairs", 4 * size)

    def leader_units(large: DataFrame) -> DataFrame:
        """The classes of large entries in blocks, each along with a few leaders of the entry."""
        by_hash = Window.partitionBy("unit").orderBy(F.xxhash64("id", "unit"), "id")  # limited in each task before the shuffle
        lead = large.withColumn("turn", F.row_number().over(by_hash)).where(F.col("turn") <= leaders)
        lead = lead.select("unit", "id", "n", "root", F.lit(-1).alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
        own = F.pmod(F.xxhash64("id", "unit"), F.col("blocks")).cast("int")
        return in_units(large.select("unit", "id", "n", "root", own.alias("block"), F.lit(-1).alias("with")).unionByName(lead))

    def check(handed: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """The verified pairs of a written table, and the units that have more pairs."""
        pairs = handed.where("unit IS NULL").select("a", "b")
        parts = turns_of(pairs, ["a"], pairs.count(), max(int(turn_pairs * size), TEXT_PAIRS))
        links = [linked(p, f"{name}-{k}" if len(parts) > 1 else name) for k, p in enumerate(parts)]
        return reduce(DataFrame.unionByName, links), handed.where("unit IS NOT NULL").select(F.col("unit").alias("left"))

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs whose texts link, written."""
        ids = pairs.select(F.explode(F.array("a", "b")).alias("own")).distinct()
        ids = scratch.table(ids.join(classes.select("id", "of"), F.col("own") == F.col("id")).select(
            "id", F.col("of.doc_id").alias("of_id"), F.col("of.text_hash").alias("of_hash")), f"{name}-ids", size)
        few = ids.count() <= broadcast_ids
        same = (F.col("doc_id") == F.col("of_id")) & (F.col("text_hash") == F.col("of_hash"))
        texts = rows.join(F.broadcast(ids) if few else ids, same).select("id", "text").dropDuplicates(["id"])
        return scratch.table(verified(pairs, texts, n, percent), f"{name}-links", 16 * size)

    def still_open(rows: DataFrame, roots: DataFrame | None, name: str) -> tuple[DataFrame, int]:
        """Rows of the entries whose classes lie in two components or more; of entries of one block
        those with a partner. With the numbers of blocks of an entry's largest component and of its others, and
        the most rows that ``units`` makes of them."""
        rooted = rows.withColumn("root", F.col("id"))
        if roots is not None:
            rooted = rows.join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id")).drop("node")
        rooted = scratch.table(rooted, f"{name}-rooted", 8 * size)
        in_blocks = lambda c: F.ceil(c / block).cast("int")
        some = rooted.where("blocks > 1").groupBy("unit", "root").agg(F.count(F.lit(1)).alias("c")).groupBy(F.col("unit").alias("open")).agg(
            F.max_by("root", F.struct("c", "root")).alias("major"), F.max("c").alias("most"), F.sum("c").alias("m")).where("most < m")
        some = some.select("open", "major", in_blocks(F.col("most")).alias("major_blocks"), in_blocks(F.col("m") - F.col("most")).alias("minor_blocks"), "m", "most")
        some = scratch.table(some, f"{name}-open", size)
        repeats = some.agg(F.sum(F.expr("most * minor_blocks + (m - most) * (major_blocks + minor_blocks)"))).first()[0] or 0
        large = rooted.where("blocks > 1").join(some.drop("m", "most"), F.col("unit") == F.col("open")).drop("open")
        small = rooted.where("blocks = 1")
        repeats += small.count()
        small = small if roots is None else with_partners(small, percent)  # found has them without roots
        return small.withColumns({"major": F.lit(None).cast("long"), "major_blocks": F.lit(0), "minor_blocks": F.lit(1)}).unionByName(large), repeats

    def merged(roots: DataFrame | None, more: DataFrame, name: str) -> DataFrame:
        """Components of the links so far: those of ``roots``, joined by ``more`` links. Only links between two
        components are followed, from root to root."""
        if roots is None:
            return components(more, scratch, f"{name}-roots")
        for end in ("a", "b"):
            rooted = roots.select(F.col("node").alias("own"), F.col("root").alias("up"))
            more = more.join(rooted, F.col(end) == F.col("own"), "left").withColumn(end, F.coalesce("up", end)).select("a", "b")
        new = components(scratch.table(more.where("a <> b").distinct(), f"{name}-lifted", size), scratch, f"{name}-roots")
        up = new.select(F.col("node").alias("own"), F.col("root").alias("up"))
        old = roots.join(up, F.col("root") == F.col("own"), "left").select("node", F.coalesce("up", "root").alias("root"))
        return scratch.table(old.unionByName(new.join(roots.select("node"), "node", "left_anti").select("node", "root")), f"{name}-merged", size)

    large, roots = found.where("blocks > 1").withColumn("root", F.col("id")), None
    many = large.count()
    if many:
        links, _ = check(met(leader_units(large), False, "leaders", many * (block + leaders) // block), "leaders")
        roots = merged(None, links, "leader")
    some, repeats = still_open(found.where(F.col("place") <= 4), roots, "few")
    links, _ = check(met(units(some), False, "few", repeats), "few")
    roots, open_rows = merged(roots, links, "few"), found
    for name, every in (("forest", False), ("rest", True)):
        some, repeats = still_open(open_rows, roots, name)
        more, left = check(met(units(some), every, name, repeats), name)
        if more.limit(1).count():
            roots = merged(roots, more, name)
        open_rows = found.join(left, F.col("unit") == F.col("left"), "left_semi")
    scratch.drop("found")

    rooted = classes.select(*key, "id", F.col("of.doc_id").alias("least")).join(roots, F.col("id") == F.col("node"), "left").select(
        *key, "least", F.coalesce("root", "id").alias("root"))
    rooted = scratch.table(rooted, "named", size)
    names = rooted.groupBy(F.col("root").alias("component")).agg(F.min("least").alias("component_id"))
    named = rooted.join(names, F.col("root") == F.col("component")).select(*[F.col(c).alias(f"own_{c}") for c in key], "component_id")
    named = scratch.table(named, "components", size)
    joined = members.join(named, [members[c] == named[f"own_{c}"] for c in key], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One document of each component: the one with the smallest id, and one row of it. Documents are
    told apart by id and text, so those with null or repeated ids take part by their texts; a null id
    comes after all others. Documents without words are kept, repeated rows of one id once."""
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    key = F.xxhash64("doc_id", "text")
    linked = link_documents(docs.select(key.alias("doc_id"), "text"), **options).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("times"), F.first("n_shingles").alias("n"), F.first("component_id").alias("component"))
    own = docs.groupBy(key.alias("key")).agg(F.min("doc_id").alias("own"))
    linked = scratch.table(linked.join(own, F.col("doc_id") == F.col("key")).drop("doc_id"), "linked")
    size = linked.count()
    worded = linked.where("n > 0")
    stays = scratch.table(worded.groupBy("component").agg(
        F.min(F.struct(F.col("own").isNull().alias("none"), "own", "key"))["key"].alias("stays")).select("stays"), "stays", size)
    name, = own_names("near_duplicate")
    gone = worded.join(stays, F.col("key") == F.col("stays"), "left_anti").select(F.col("key").alias(name))
    more = linked.where("times > 1 AND (n > 0 OR own IS NOT NULL)").select(F.col("key").alias(name))
    # All rows of the others, and one of each repeated document that stays.
    kept = docs.join(scratch.lookup(gone.unionByName(more).distinct(), "gone"), key == F.col(name), "left_anti")
    again = scratch.lookup(more.join(gone, name, "left_anti"), "again")
    if again.limit(1).count():
        rows = docs.join(again, key == F.col(name))
        kept = kept.unionByName(rows.dropDuplicates([name]).drop(name))
    return kept
