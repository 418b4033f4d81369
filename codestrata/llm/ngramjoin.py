"""Op 7, n-gram Jaccard join: documents whose sets of word shingles are alike, exactly, by a universe partition.

Sets. Words of the lower-cased text; every five in a row are a shingle (fewer words: all of them are one), held as
64-bit hashes. Documents with equal sets are one class (a 64-bit hash of the set; where two sets share that, a
second one tells them apart), so copies are joined once, however many they are.

Candidates. Two sets of sizes x and y that are alike differ in at most (x + y)(1 - t)/(1 + t) shingles. Sizes are
in bands (4**(j-1), 4**j]; a band's scheme hashes the universe into a few more segments than the most that its
largest sets may differ by, so that those have about three shingles in each. A set has to spend a budget of one more than
the most it may differ by from any allowed partner (and an eighth: alike sets then share that many entries more, and pairs that
share fewer are no candidates). It spends along one sequence of steps, the same for every set of the
band: index the segments whose lists are short, cheapest first; index their one-deletion neighbourhoods too,
cheapest first; then the segments with long lists, and their one-deletion neighbourhoods. A segment is worth one step, or
two with its neighbourhood (one, if it holds one shingle), and empty ones nothing. Of two alike sets, the one that stops first has taken no
step that the other hasn't, and shingles that differ spoil at most as many steps as there are such shingles; so they
meet. The cost of a segment is how many documents hold frequent shingles that fall in it, over the whole corpus; it orders
steps only. A set whose segments are used up also indexes single shingles. A set near the top of its
band is also indexed under the next scheme. Nothing is left out, whatever the frequency.

Links. Each entry's leader is the set whose shingles are most frequent (the centre of a family of near copies rather than
its rim). Sets are compared with their entries' leaders, and components of these links are found. Entries that
still hold several components are left, by class of sizes, without the sets that share too few of them: those of at most
`few` sets give pairs of sets that share enough entries; sets of larger ones are gathered by leader and class, cut into
parts by number and size, and each two parts meet in one task, which counts
all their intersections as a product of matrices and hands on only the links that join components. Comparing is exact, on whole sets.
Pairs within a component aren't expanded: they can't change a component.

Null, empty and wordless texts: no shingles, own component. Repeated rows and copies: one result a row. Ids may
repeat; a null id is never the smallest. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, MUL, mix, pieces, stored, table, text_bytes, word_hashes, word_spans
from .graph import components

N, T100 = 5, 75
BLOCK = 2_000_000
BROADCAST_IDS = 1_000_000
#: Sets and shingles in a part of a leader's group; two parts meet in one task.
PART_SETS, PART_SHINGLES = 1024, 300_000


def shingles(column: pa.Array, n: int = N) -> list[np.ndarray]:
    """The sorted set of each text's shingle hashes."""
    data, at = text_bytes(column)
    data = LOWER[data]
    starts, ends, text = word_spans(data, at)
    words = word_hashes(data, starts, ends)
    first = np.searchsorted(text, np.arange(len(at)))
    whole = np.zeros(0, np.uint64)
    if len(words) >= n:
        whole = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            whole = mix(whole * MUL + words[k : len(words) - n + 1 + k])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(whole[a : b - n + 1]))
        else:
            h = np.uint64(b - a)
            for w in words[a:b]:
                h = mix(np.array([h]) * MUL + w)[0]
            out.append(np.array([h] if b > a else [], np.uint64))
    return out


def fingerprints(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set."""
    mixed = mix(s)
    total, other = mixed.sum(dtype=np.uint64, keepdims=True), mix(mixed + MUL).sum(dtype=np.uint64, keepdims=True)
    size = np.uint64(len(s))
    return int(mix(total * MUL + size).view(np.int64)[0]), int(mix(other * MUL + size).view(np.int64)[0])


class Naming:
    """Names of sets: the first hash, cut to `bits`; the second for names in `clash`, which stand for several sets."""

    def __init__(self, bits: int = 64, clash: frozenset[int] = frozenset()):
        self.bits, self.clash = bits, clash

    def of(self, s: np.ndarray) -> int:
        first, second = fingerprints(s)
        first = first & (1 << self.bits) - 1 if self.bits < 64 else first
        return second if first in self.clash else first


def scan(docs: DataFrame, naming: Naming, t100: int, least: int = 4) -> DataFrame:
    """(row, doc_id, n, set, check, least, shingle, docs): a row for each document, and rows with shingles that several documents of a block share. row: null if docs has none."""

    def run(batches):
        held, size = [], 0
        for batch in pieces(batches):
            sets = shingles(batch.column("text"))
            n = np.array([len(s) for s in sets])
            ids = batch.column("doc_id").cast(pa.int64())
            names = [(naming.of(s), fingerprints(s)[1]) if len(s) else (None, None) for s in sets]
            yield rows(batch.column("row"), ids, pa.array(n), *(pa.array([x[k] for x in names], pa.int64()) for k in (0, 1)), pa.array([shared_least(len(s), t100) for s in sets], pa.int64()), None, None)
            held += sets
            size += int(n.sum())
            if size >= BLOCK:
                yield common(held)
                held, size = [], 0
        if held:
            yield common(held)

    def common(held):
        found, counts = np.unique(np.concatenate(held), return_counts=True)
        keep = counts >= least
        return rows(None, None, None, None, None, None, pa.array(found[keep].view(np.int64)), pa.array(counts[keep]))

    def rows(*columns):
        n = next(len(c) for c in columns if c is not None)
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()) if c is None else c.cast(pa.int64()) for c in columns], ["row", "doc_id", "n", "set", "check", "least", "shingle", "docs"])

    row = F.col("row") if "row" in docs.columns else F.lit(None).cast("long").alias("row")
    return docs.select(row, "doc_id", "text").mapInArrow(run, "row long, doc_id long, n long, set long, check long, least long, shingle long, docs long")


def schemes(n: int, t100: int) -> list[tuple[int, int]]:
    """(band, most differing shingles) of the schemes that index a set of n shingles."""
    band = 0
    while 4**band < n:
        band += 1
    top, partner = 4**band, n * 100 // t100
    out = [(band, (n + min(partner, top)) * (100 - t100) // (100 + t100))]
    if partner > top:
        out.append((band + 1, (n + partner) * (100 - t100) // (100 + t100)))
    return out


def shared_least(n: int, t100: int) -> int:
    """How many entries a set of n shingles asks two alike sets to share."""
    return min((1 + most // 8 for _, most in schemes(n, t100)), default=1)


def segments(band: int, t100: int) -> int:
    """How many segments a band's scheme has: a fifth more than its largest sets may differ by."""
    return max(4, (2 * 4**band * (100 - t100) // (100 + t100) + 1) * 6 // 5)


def segment_of(s: np.ndarray, band: int, t100: int) -> tuple[np.ndarray, np.uint64]:
    salt = np.uint64((band + 1) * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1)
    return ((mix(s ^ salt) >> np.uint64(33)) % np.uint64(segments(band, t100))).astype(np.int64), salt


class Costs:
    """The order of a band's segments by cost, and which of them have long lists; from shingles that are frequent in the corpus and their numbers of documents."""

    def __init__(self, shingles_: np.ndarray, docs: np.ndarray, t100: int):
        self.shingles, self.docs, self.t100, self.bands = shingles_, docs, t100, {}

    def of(self, band: int) -> tuple[np.ndarray, np.ndarray]:
        if band not in self.bands:
            m = segments(band, self.t100)
            cost = np.bincount(segment_of(self.shingles, band, self.t100)[0], weights=self.docs, minlength=m) if len(self.shingles) else np.zeros(m)
            rank = np.empty(m, np.int64)
            rank[np.argsort(cost, kind="stable")] = np.arange(m)
            self.bands[band] = rank, cost > 2 * np.median(cost) + 64
        return self.bands[band]

    def frequency(self, s: np.ndarray) -> float:
        """In how many documents a shingle of the set is on average, as far as known."""
        if not len(self.shingles):
            return 0.0
        at = np.minimum(np.searchsorted(self.shingles, s), len(self.shingles) - 1)
        return float(np.where(self.shingles[at] == s, self.docs[at], 0).mean())


def entries(s: np.ndarray, costs: Costs, t100: int = T100) -> tuple[np.ndarray, int, int]:
    """Index entries of a set, how many of them it shares at least with any that is alike (if that one asks for no fewer; shared_least(), or 1 if the set hasn't enough), and how many one-deletion neighbourhoods it indexes."""
    out, short_of, neighbourhoods = [], False, 0
    mixed = mix(s)
    for band, most in schemes(len(s), t100):
        segment, salt = segment_of(s, band, t100)
        rank, long = costs.of(band)
        # short lists first, by cost
        place = rank[segment] + np.where(long[segment], len(rank), 0)
        order = np.argsort(place, kind="stable")
        begin = np.flatnonzero(np.diff(place[order], prepend=-1))
        size = np.diff(np.append(begin, len(s)))
        name = mix(segment[order][begin].astype(np.uint64) ^ salt)
        sums = np.add.reduceat(mixed[order], begin)
        every, short = np.arange(len(begin)), int((~long[segment[order][begin]]).sum())
        of = np.concatenate((every[:short], every[:short], every[short:], every[short:]))  # the segment of each step
        more = np.repeat([False, True, False, True], [short, short, len(every) - short, len(every) - short])  # its neighbourhood
        worth = np.cumsum(np.where(more, size[of] > 1, True))
        wanted = most + 1 + most // 8
        steps = np.searchsorted(worth, wanted) + 1
        short_of |= worth[-1] < wanted
        of, more = of[:steps], more[:steps]
        out.append(mix(sums ^ name)[of[~more]])
        also = np.zeros(len(begin), bool)
        also[of[more]] = True
        also &= size > 1
        neighbourhoods += int(also.sum())
        inside = np.repeat(np.arange(len(begin)), size)
        at = np.flatnonzero(also[inside])
        out.append(mix((sums[inside[at]] - mixed[order][at]) ^ name[inside[at]]))
        if worth[-1] <= most:
            out.append(mix(mixed ^ ~salt))
    # 48 bits: two entries that fall together only make more candidates, and rows are smaller
    return np.unique(np.concatenate(out) >> np.uint64(16)), 1 if short_of else shared_least(len(s), t100), neighbourhoods


#: Low bits of a set's name that stand for it in the index; above them, whether it asks for one shared entry only, and how frequent its shingles are.
NAME = 51


def reference(name: int, alone: bool, frequency: float) -> int:
    return min(int(math.log2(1 + frequency) * 100), 2047) << NAME + 1 | int(alone) << NAME | name & (1 << NAME) - 1


def index(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], naming: Naming, t100: int) -> DataFrame:
    """(entry, ref), ref: reference() of the set; copies in one task give theirs once. Two sets with one reference only make more candidates."""
    spread = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        costs = Costs(*spread.value, t100)
        seen: set[int] = set()
        for batch in pieces(batches):
            found, refs = [], []
            for s in shingles(batch.column("text")):
                if not len(s) or (own := naming.of(s)) in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(own)
                e, least, _ = entries(s, costs, t100)
                found.append(e)
                refs.append(reference(own, least < shared_least(len(s), t100), costs.frequency(s)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(np.array(refs, np.int64), [len(e) for e in found]))], ["entry", "ref"])

    return docs.select("text").mapInArrow(run, "entry long, ref long")


def fetched(docs: DataFrame, classes: DataFrame, wanted: DataFrame, naming: Naming, unique: bool) -> DataFrame:
    """wanted(set, ...) with the set's `shingles`. classes(set, doc_id): a document of each. unique: no id stands for two texts."""
    ids = stored(wanted.select("set").distinct().join(classes, "set").select("doc_id").distinct())
    few = ids.count() <= BROADCAST_IDS
    text = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    if ids.where("doc_id is null").limit(1).count():  # a class with null ids only: its text is among those without an id
        text = text.unionAll(docs.select("doc_id", "text").where("doc_id is null"))

    def sets(batches):
        for batch in pieces(batches):
            found = [s for s in shingles(batch.column("text")) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([naming.of(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.large_binary()).cast(pa.binary())], ["set", "shingles"])

    held = text.mapInArrow(sets, "set long, shingles binary")
    held = held if unique else held.dropDuplicates(["set"])
    return held.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "set")


def links(docs: DataFrame, classes: DataFrame, pairs: DataFrame, t100: int, naming: Naming, unique: bool, part: int = 256) -> DataFrame:
    """The pairs(a, b) of sets that are alike: a leader's members come in salted parts of about `part`, each with the leader's set at its head."""
    pairs = stored(pairs.select("a", "b"))
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    members = pairs.join(many, "a").select(F.col("b").alias("set"), F.col("a").alias("leader"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt"), F.lit(False).alias("leads"))
    leads = many.select(F.col("a").alias("set"), F.col("a").alias("leader"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(True).alias("leads"))
    wanted = stored(members.unionAll(leads))
    dealt = fetched(docs, classes, wanted, naming, unique).repartition("leader", "salt").sortWithinPartitions("leader", "salt", F.desc("leads"))

    def compare(batches):
        key, own = None, None
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                a, b = [], []
                for set_, leader, salt, leads, raw in zip(*(batch.column(c).to_pylist() for c in ("set", "leader", "salt", "leads", "shingles")), strict=True):
                    s = np.frombuffer(raw, np.uint64)
                    if leads:
                        key, own = (leader, salt), s
                    elif key == (leader, salt) and alike(own, s, t100):
                        a.append(leader)
                        b.append(set_)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.select("set", "leader", "salt", "leads", "shingles").mapInArrow(compare, "a long, b long")


def meetings(docs: DataFrame, classes: DataFrame, members: DataFrame, t100: int, naming: Naming, unique: bool, part_sets: int = PART_SETS, part_shingles: int = PART_SHINGLES) -> DataFrame:
    """(a, b): links that join the components of members(leader, class, set, n, label) of each group of a leader and class which hold alike sets."""
    groups_ = members.groupBy("leader", "class").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / part_sets), F.ceil(F.sum("n") / part_shingles)).cast("int").alias("parts"))
    own, part, j = F.pmod(F.xxhash64("set"), F.col("parts")).cast("int"), F.col("part"), F.col("j")
    dealt = members.join(groups_, ["leader", "class"]).withColumn("part", own).withColumn("j", F.explode(F.when(F.col("parts") <= 2, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))).where(part != j)
    meeting = F.when(j < 0, F.lit(0).cast("long")).otherwise(F.least(part, j).cast("long") * F.col("parts") + F.greatest(part, j))
    keys = ["leader", "class", "meeting"]
    wanted = stored(dealt.select("leader", "class", meeting.alias("meeting"), "set", "label"))
    dealt = fetched(docs, classes, wanted, naming, unique).repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        key, held = None, []
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                for *own_key, set_, label, raw in zip(*(batch.column(c).to_pylist() for c in (*keys, "set", "label", "shingles")), strict=True):
                    if own_key != key:
                        yield from joined(held)
                        key, held = own_key, []
                    held.append((set_, label, np.frombuffer(raw, np.uint64)))
        yield from joined(held)

    def joined(held):
        names, labels, sets = [x[0] for x in held], np.unique([x[1] for x in held], return_inverse=True)[1] if held else [], [x[2] for x in held]
        if len(set(labels)) > 1 and (found := joins(sets, labels, t100)):
            yield pa.RecordBatch.from_arrays([pa.array([names[x[k]] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return dealt.select(*keys, "set", "label", "shingles").mapInArrow(run, "a long, b long")


def joins(sets: list[np.ndarray], labels: np.ndarray, t100: int) -> list[tuple[int, int]]:
    """Pairs of places in sets, as few as join all labels (numbers from 0) that alike sets join."""
    n = np.array([len(s) for s in sets])
    shared = intersections(sets)
    close = (100 * shared >= t100 * (n[:, None] + n[None, :] - shared)) & (labels[:, None] != labels[None, :])
    rows = np.flatnonzero(close.any(1))
    if not len(rows):
        return []
    close = close[np.ix_(rows, rows)]
    own, of = labels[rows], np.arange(labels.max() + 1)
    while True:
        near = np.where(close, of[own][None, :], len(of)).min(1)
        new = of.copy()
        np.minimum.at(new, own, near)
        np.minimum.at(new, of[own], near)  # the whole tree hooks on
        new = np.minimum(new, new[new])
        if (new == of).all():
            break
        of = new
    first = np.full(labels.max() + 1, -1)
    first[labels[::-1]] = np.arange(len(labels))[::-1]
    return [(int(first[of[k]]), int(first[k])) for k in np.flatnonzero(of != np.arange(len(of)))]


def intersections(sets: list[np.ndarray], dense: int = 32, cells: int = 1 << 22) -> np.ndarray:
    """Sizes of the intersections of all sets: shingles of many sets by a product of matrices, those of few by their pairs."""
    k = len(sets)
    owner = np.repeat(np.arange(k), [len(s) for s in sets])
    _, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(which, kind="stable")
    owner, count = owner[order], np.repeat(count, count)
    out = np.zeros((k, k), np.float32)
    many = owner[count > dense]
    column = np.cumsum(np.diff(which[order][count > dense], prepend=-1) > 0) - 1
    width = max(1, cells // k)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, (a, a + width))
        m = np.zeros((k, width), np.float32)
        m[many[lo:hi], column[lo:hi] - a] = 1
        out += m @ m.T
    pairs = np.zeros(k * k, np.int64)
    for c in range(2, dense + 1):
        few = owner[count == c].reshape(-1, c)
        for a in range(0, len(few), max(1, cells // (c * c))):
            x = few[a : a + max(1, cells // (c * c))]
            i, j = np.triu_indices(c, 1)
            pairs += np.bincount((x[:, i] * k + x[:, j]).ravel(), minlength=k * k)
    pairs = pairs.reshape(k, k)
    out = out.astype(np.int64) + pairs + pairs.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def alike(x: np.ndarray, y: np.ndarray, t100: int = T100) -> bool:
    if 100 * min(len(x), len(y)) < t100 * max(len(x), len(y)):
        return False
    both = np.concatenate((x, y))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= t100 * (len(both) - shared)


def fits(x, y, t100: int):
    return 100 * F.least(x, y) >= t100 * F.greatest(x, y)


def classed(docs: DataFrame, t100: int, common_least: int, most_common: int, few: int = 8, name_bits: int = 64, part_sets: int = PART_SETS) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, n, set) for every row of docs(doc_id, text[, row]), and (set, doc_id, label) for every set; label: the smallest set of its component."""
    naming = Naming(name_bits)
    seen = stored(scan(docs, naming, t100))
    documents = seen.where(F.col("n").isNotNull()).select("row", "doc_id", "n", "set", "check", "least")
    twice = documents.where(F.col("set").isNotNull()).groupBy("set").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high")
    if clash := frozenset(r[0] for r in twice.select("set").collect()):  # of 64 bits: none is likely below billions of sets
        naming = Naming(name_bits, clash)
        documents = documents.join(F.broadcast(twice.select("set", F.lit(True).alias("twice"))), "set", "left").withColumn("set", F.when(F.col("twice"), F.col("check")).otherwise(F.col("set")))
    # Only the order of steps and the choice of leaders depend on these; so their number may be bounded for broadcast.
    frequent = seen.where(F.col("shingle").isNotNull()).groupBy("shingle").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= common_least).orderBy(F.desc("docs"), "shingle").limit(most_common).toArrow()
    known = frequent.column("shingle").to_numpy().view(np.uint64)
    by = np.argsort(known)
    common = (known[by], frequent.column("docs").to_numpy()[by])
    classes = stored(documents.where(F.col("set").isNotNull()).groupBy("set").agg(F.min("doc_id").alias("doc_id"), F.min("n").cast("int").alias("n"), F.min("least").cast("int").alias("least")))
    unique = documents.groupBy("doc_id").count().where("count > 1").limit(1).count() == 0

    same = Window.partitionBy("entry")
    shared = index(docs, common, naming, t100).withColumns({"top": F.max("ref").over(same), "low": F.min("ref").over(same)}).where("top <> low").drop("low").distinct()
    bits = lambda c: F.col(c).bitwiseAND(F.lit((1 << NAME) - 1))
    asks = lambda c, least: F.when(F.getbit(c, F.lit(NAME)) == 1, 1).otherwise(F.col(least))
    member = classes.select(bits("set").alias("name"), "set", "n", "least")
    leader = member.select(F.col("name").alias("top_name"), F.col("set").alias("leader"), F.col("n").alias("m"), F.col("least").alias("least_m"))
    shared = shared.withColumns({"name": bits("ref"), "top_name": bits("top")}).join(member, "name").join(leader, "top_name")
    shared = stored(shared.select("entry", "set", "n", asks("ref", "least").alias("least"), "leader", "m", asks("top", "least_m").alias("least_m")))
    met = shared.where((F.col("set") != F.col("leader")) & fits(F.col("n"), F.col("m"), t100))
    met = met.groupBy(F.col("leader").alias("a"), F.col("set").alias("b")).agg(F.count("*").alias("k"), F.min(F.least("least", "least_m")).alias("least")).where("k >= least")
    found = stored(links(docs, classes, met, t100, naming, unique))
    labels = components(found)

    # Alike sizes are in one class of sizes or in neighbouring ones; a set is in its own class and in the next, and two sets meet in the larger one's.
    own = F.floor(F.log("n") / F.log(F.lit(100.01 / t100))).cast("int")
    labelled = shared.join(labels.withColumnRenamed("node", "set"), "set", "left").select("entry", "set", "n", "least", "leader", F.coalesce("label", "set").alias("label"), own.alias("own"))
    label = F.col("label")
    several = labelled.repartition("entry").withColumn("several", F.min("label").over(same) != F.max("label").over(same)).where("several").drop("several")
    classed_ = several.withColumn("class", F.explode(F.array("own", F.col("own") + 1)))
    here, of_set = Window.partitionBy("entry", "class"), Window.partitionBy("set", "class")
    larger = F.when(F.col("own") == F.col("class"), label)  # of two sets that meet here one is of this class at least
    classed_ = classed_.withColumns({"a": F.min("label").over(here), "b": F.max("label").over(here), "c": F.min(larger).over(here), "d": F.max(larger).over(here), "low": F.min("least").over(here)})
    meets = F.when(F.col("own") == F.col("class"), F.col("a") != F.col("b")).otherwise((F.col("c") != label) | (F.col("d") != label))
    mixed = classed_.where(meets).drop("a", "b", "c", "d")
    # A set that shares fewer entries with sets of other components than any of them asks for is alike to none of those.
    enough = mixed.withColumns({"k": F.count("*").over(of_set), "asked": F.min("low").over(of_set)}).where("k >= asked").drop("k", "asked", "low")
    left = stored(enough.withColumn("size", F.count("*").over(here)).where("size > 1"))
    small = left.where(F.col("size") <= few)
    other = small.select("entry", "class", F.col("set").alias("b"), F.col("n").alias("m"), F.col("label").alias("label_b"), F.col("least").alias("least_b"), F.col("own").alias("own_b"))
    met_here = (F.col("a") < F.col("b")) & (F.col("label") != F.col("label_b")) & (F.col("class") == F.greatest("own", "own_b")) & fits(F.col("n"), F.col("m"), t100)
    rest = small.withColumnRenamed("set", "a").join(other, ["entry", "class"]).where(met_here)
    rest = rest.groupBy("a", "b").agg(F.count("*").alias("k"), F.min(F.least("least", "least_b")).alias("least")).where("k >= least").select("a", "b")
    members = left.where(F.col("size") > few).groupBy("leader", "class", "set").agg(F.min("n").alias("n"), F.min("label").alias("label"))
    more = stored(links(docs, classes, rest, t100, naming, unique).unionAll(meetings(docs, classes, stored(members), t100, naming, unique, part_sets)))
    if more.limit(1).count():
        labels = components(found.unionAll(more))

    named = classes.join(labels.withColumnRenamed("node", "set"), "set", "left").select("set", "doc_id", F.coalesce("label", "set").alias("label"))
    return documents.select("row", "doc_id", "n", "set"), named


def groups(docs: DataFrame, t100: int = T100, common_least: int = 64, most_common: int = 200_000) -> DataFrame:
    """(row, doc_id, label) for every row of docs(row, doc_id, text) with words."""
    documents, named = classed(docs, t100, common_least, most_common)
    return documents.where(F.col("set").isNotNull()).join(named.select("set", "label"), "set").select("row", "doc_id", "label")


def join(docs: DataFrame, t100: int = T100, common_least: int = 64, most_common: int = 200_000, few: int = 8, name_bits: int = 64, part_sets: int = PART_SETS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs(doc_id, text)."""
    documents, named = classed(docs.select("doc_id", "text"), t100, common_least, most_common, few, name_bits, part_sets)
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = named.join(smallest, "label").select("set", "component_id")
    joined = documents.where(F.col("set").isNotNull()).join(named, "set").select("doc_id", "n", "component_id")
    alone = documents.where(F.col("set").isNull()).select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return joined.unionAll(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
