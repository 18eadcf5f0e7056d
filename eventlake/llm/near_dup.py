"""MinHash near-duplicates on SetSketch registers.

A document's set is its distinct k-word shingles. Its sketch keeps, for each of
``REGISTERS`` hash functions, the minimum over the set, seen as an exponential
variate and truncated to a power of ``BASE``: registers of two sets merge by a
maximum and agree about as often as the sets do. Four registers make a band;
documents meet that agree in a band. In the first turns a member meets a few
others of its bucket (heads of blocks, and neighbours under several orders), which
brings nearly all that link into one component; in the last one those outside a
bucket's largest component meet all others that they may link with, so that no pair
of a bucket stays undecided. Where a bucket holds many of both, its members are
split by their rarest shingles: sets that are similar enough share one within a short
prefix of both, so only those that do meet. A pair goes on to the exact test unless the
joint likelihood of its registers all but excludes the wanted similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .shared import crowd, join_crowded, need_columns, written
from .words import mix, shingle_hashes, word_hashes

REGISTERS, ROWS = 128, 4
BANDS = REGISTERS // ROWS
BASE, RATE = 1.02, 20.0
#: A pair is dropped untested when the likelihood of the wanted similarity is below exp(-SURE) of the best one.
SURE = 9.0
#: Turns in which a member meets a few others of a bucket, and how many bands on the order of each one begins.
TURNS, TURN = 2, 7
#: Members that one head of a block meets, and up to which all of a bucket meet as rows in the end.
CROWD = 64
#: Members outside of a bucket's largest component, up to which they meet all others as rows in the end.
FEW = 8
#: Slots that shingles are counted in, to put rare ones first; a power of two.
SLOTS = 1 << 16
_rng = np.random.default_rng(20)
_FLIP = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)[:, None]
_TIMES = (_rng.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * 2 + 1).astype(np.uint32)[:, None]


def minima(elements: np.ndarray) -> np.ndarray:
    """Each hash function's minimum over the set, in slices of bounded size."""
    x = (elements >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        y = (x[None, i : i + 4096] ^ _FLIP) * _TIMES
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        np.minimum(least, y.min(axis=1), out=least)
    return least


def registers(least: np.ndarray) -> np.ndarray:
    """SetSketch registers of minima: floor(1 - log_b of the exponential variate), as 16 bits."""
    x = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 65535).astype("<u2")


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def log_likelihood(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-likelihood of Jaccard similarities ``at`` (one row a pair) given registers and set sizes."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - more - less
    u = (na / (na + nb))[:, None]
    v = 1 - u
    at = np.minimum(at, np.minimum(u / v, v / u))
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * at), p(v - u * at)
    log = lambda x: np.log(np.maximum(x, 1e-9))
    return more * log(up) + less * log(down) + same * log(1 - up - down)


def _sketch(k: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                words, bound = word_hashes([(t or "").encode().lower() for t in part.column(1).to_pylist()])
                out = []
                for i in range(part.num_rows):
                    s = np.unique(shingle_hashes(words[bound[i] : bound[i + 1]], k))
                    if len(s):
                        h = [int(mix(s ^ np.uint64(c)).sum()) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
                        out.append((len(s), *np.array(h, np.uint64).view(np.int64).tolist(), registers(minima(s)).tobytes()))
                    else:
                        out.append((0, None, None, None))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary())))],
                    ["id", "n", "h1", "h2", "regs"],
                )

    return run


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4) -> DataFrame:
    """(id, n, h1, h2, regs): set size, a 128-bit hash of the set, and its registers."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _sketch(k), "id long, n long, h1 long, h2 long, regs binary"
    )


def _worth(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Places of the pairs whose registers and set sizes don't all but exclude the wanted similarity."""
    grid = np.linspace(0, 1, 81)[None, :]
    keep = np.flatnonzero((a == b).sum(1) >= _agreeing(percent))
    a, b, na, nb = a[keep], b[keep], na[keep], nb[keep]
    wanted = log_likelihood(a, b, na, nb, np.full((1, 1), percent / 100))[:, 0]
    curve = log_likelihood(a, b, na, nb, grid)
    sure = (wanted < curve.max(1) - SURE) & (grid[0][curve.argmax(1)] < percent / 100)
    return keep[~sure]


def _agreeing(percent: int) -> float:
    """Equal registers that any pair worth a test has: six deviations and more below the expected number."""
    return REGISTERS * (percent / 100 - 0.25)


def _read_registers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, REGISTERS)


def _likely(percent: int):
    """Pairs (a, b) whose registers (ra, rb) and set sizes (na, nb) don't all but exclude the wanted similarity."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                na, nb = (part.column(c).to_numpy().astype(float) for c in ("na", "nb"))
                a, b = (_read_registers(part.column(c)) for c in ("ra", "rb"))
                yield part.select(["a", "b"]).take(pa.array(_worth(a, b, na, nb, percent)))

    return run


def _likely_in_band(percent: int):
    """Of pairs (see _likely) those that agree in a whole band and are worth a test."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def met(part: pa.RecordBatch) -> pa.RecordBatch:
            a, b = (_read_registers(part.column(c)) for c in ("ra", "rb"))
            return part.filter(pa.array((a == b).reshape(-1, BANDS, ROWS).all(2).any(1)))

        yield from _likely(percent)(met(batch.slice(at, 4000)) for batch in rows for at in range(0, batch.num_rows, 4000))

    return run


def _sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, in pieces of bounded size."""
    for at in range(0, len(texts), 500):
        words, bound = word_hashes([t.encode().lower() for t in texts.slice(at, 500).to_pylist()])
        yield from (np.unique(shingle_hashes(words[bound[i] : bound[i + 1]], k)) for i in range(len(bound) - 1))


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def _slot_counts(k: int):
    """(slot, n): how many shingles of a partition's sets fall into each slot."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in rows:
            for s in _sets(batch.column(0), k):
                total += np.bincount(_slot(s), minlength=SLOTS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["slot", "n"])

    return run


def _prefixes(shared, k: int, percent: int):
    """(shingle, id, n, component, place, short): the first places of each set in the order of slots' counts, as far as prefix filtering needs them."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = shared.value
        for batch in rows:
            ids, components = (batch.column(c).to_pylist() for c in (0, 2))
            for id_, component, s in zip(ids, components, _sets(batch.column(1), k)):
                n = len(s)
                count = met[_slot(s)]
                long, short = n - -(-percent * n // 100) + 1, n - -(-2 * percent * n // (100 + percent)) + 1
                first = np.lexsort((s, count))[:long]
                place = np.arange(1, len(first) + 1)
                kept = count[first] > 1  # alone in its slot: in no other set
                columns = [s[first].view(np.int64), np.full(len(first), id_), np.full(len(first), n), np.full(len(first), component), place]
                yield pa.RecordBatch.from_arrays([*(pa.array(c[kept], pa.int64()) for c in columns), pa.array((place <= short)[kept])], ["shingle", "id", "n", "component", "place", "short"])

    return run


def sharing_rare(members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of members in different components whose sets can reach the similarity, by prefix filtering.

    Shingles are put in one order, the rare ones first: by the number of shingles in their
    slot, one of ``SLOTS`` that hashes fall into (any order is right; this one needs no
    more than the slots' counts on the driver). Two sets of sizes m <= n that reach
    the similarity share at least p / (100 + p) * (m + n) shingles, so one that both have
    stands within the first m - 2 p m / (100 + p) + 1 of the smaller set and the first
    n - p n / 100 + 1 of the larger one: only such places are joined, and of those only where
    enough shingles follow in both sets, as they do behind the first that both have. No pair is left out.
    """
    held = texts.join(members.select("id", "component").dropDuplicates(["id"]).hint("merge"), "id").select("id", "text", "component")
    counts = held.select("text").mapInArrow(_slot_counts(k), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    met = np.zeros(SLOTS, np.int64)
    for r in counts:
        met[r.slot] = r.n
    shared = held.sparkSession.sparkContext.broadcast(met)
    rows = held.mapInArrow(_prefixes(shared, k, percent), "shingle long, id long, n long, component long, place long, short boolean")
    rows = written(rows, "prefixes")
    x, y = (rows.select("shingle", F.struct("n", "id", "component", "place").alias(c), *more) for c, more in (("x", ["short"]), ("y", [])))
    pairs = x.where("short").drop("short").join(y.hint("merge"), "shingle")
    pairs = pairs.where((F.struct("x.n", "x.id") < F.struct("y.n", "y.id")) & (F.col("x.component") != F.col("y.component")) & (100 * F.col("x.n") >= percent * F.col("y.n")))
    needed = F.ceil(percent * (F.col("x.n") + F.col("y.n")) / (100 + percent))
    pairs = pairs.where(F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) + 1 >= needed)
    return pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _verify(k: int, percent: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in rows:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                a, b, ta, tb = (part.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))
                texts = {t: None for t in [*ta, *tb]}
                words, bound = word_hashes([t.encode().lower() for t in texts])
                known = dict(zip(texts, (np.unique(shingle_hashes(words[bound[i] : bound[i + 1]], k)) for i in range(len(texts)))))
                linked = []
                for x, y in zip(ta, tb):
                    x, y = known[x], known[y]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(100 * both >= percent * (len(x) + len(y) - both))
                yield part.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def _met(x: Column, y: Column, percent: int) -> Column:
    """Whether two members may be worth a look: of different components, and with sizes that allow the similarity."""
    return y.isNotNull() & (x["component"] != y["component"]) & (100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"]))


def _pair(x: Column, y: Column) -> list[Column]:
    """a, b, na, nb, ra, rb of two members, the smaller id first."""
    turned = x["id"] > y["id"]
    pick = lambda f, p, q: F.when(turned, q[f]).otherwise(p[f])
    return [pick(f, *o).alias(name) for name, f, o in (("a", "id", (x, y)), ("b", "id", (y, x)), ("na", "n", (x, y)), ("nb", "n", (y, x)), ("ra", "regs", (x, y)), ("rb", "regs", (y, x)))]


def candidates(members: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb, ra, rb) of a bucket's members, a few for each member however large the bucket is.

    members: (key, salt, band, id, n, rank, component, regs). The members of a
    bucket, or of each part (salt) of a crowded one, stand in an order: at first
    by how many others they meet over all bands, in later turns by all registers,
    from one on that differs by turn, so that neighbours agree in as many more as
    any do. A member meets the head of its block of ``CROWD`` members and the one
    before it, in later turns the two before it; a block's head that of the
    bucket's part, and those of a bucket's parts each other in a row and the
    first. Members of one component don't meet, nor do sets whose sizes rule out
    the similarity.
    """
    part = Window.partitionBy("key", "salt")
    by = [F.desc("rank"), F.col("id")]
    if turn:
        start = (F.lit(1) + 2 * ROWS * F.pmod(F.col("band") + F.lit(TURN * turn), F.lit(BANDS))).cast("int")
        by = [F.col("regs").substr(start, F.lit(2 * REGISTERS)), F.col("regs"), *by]
    order, who = part.orderBy(*by), F.struct("id", "component", "n", "regs")
    placed = members.select("key", "salt", "rank", "band", *(["regs", "id"] if turn else ["id"]), who.alias("me"), (F.row_number().over(order) - 1).alias("place"), F.lag(who).over(order).alias("met0"), F.first(who).over(order).alias("head"))
    placed = placed.withColumn("block", F.floor(F.col("place") / CROWD))
    so_far = Window.partitionBy("key", "salt", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = [F.first("me").over(so_far), F.when(F.col("place") % CROWD == 0, F.col("head"))]
    if turn:
        met.append(F.lag("me", 2).over(Window.partitionBy("key", "salt").orderBy("place")))
    mates = placed.select("me", "met0", *(m.alias(f"met{i}") for i, m in enumerate(met, 1)))
    mates = mates.select("me", F.explode(F.array("met0", *(f"met{i}" for i, _ in enumerate(met, 1)))).alias("other"))
    across = Window.partitionBy("key").orderBy("salt")
    heads = placed.where("place = 0 and salt is not null").select("key", "salt", "me")
    heads = heads.select("me", F.lag("me").over(across).alias("before"), F.first("me").over(across).alias("first")).select("me", F.explode(F.array("before", "first")).alias("other"))
    pairs = mates.unionByName(heads)
    return pairs.where(_met(F.col("me"), F.col("other"), percent)).select(*_pair(F.col("me"), F.col("other")))


def remaining(members: DataFrame, texts: DataFrame, k: int, percent: int, most: int) -> DataFrame:
    """Pairs (a, b) worth a test of a bucket's members that aren't in one component yet, all of them.

    A member outside of its bucket's largest component is an outsider. Outsiders
    meet every member of other components as rows where the bucket has up to
    ``FEW`` outsiders or ``CROWD`` members, so many pairs a member at most; in other
    buckets those with which they share a rare shingle (see sharing_rare). The
    parts (salts) of a crowded bucket are met one by one.
    """
    each = members.groupBy("key", "component").agg(F.count("*").alias("n_own"))
    main = each.groupBy("key").agg(F.max_by("component", F.struct("n_own", "component")).alias("main"), F.max("n_own").alias("n_main"), F.sum("n_own").alias("size")).where("size > n_main")
    open_ = written(join_crowded(members, main, ["key"], F.col("size") > most), "open")
    few = (F.col("size") - F.col("n_main") <= FEW) | (F.col("size") <= CROWD)
    whole = F.struct("id", "component", "n", "regs")
    salts = F.when(F.col("salt").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("salts") - 1))
    some = open_.where(few & (F.col("component") != F.col("main"))).select("key", whole.alias("me"), F.explode(salts).alias("salt"))
    others = open_.where(few).select("key", F.coalesce("salt", F.lit(-1)).alias("salt"), "main", whole.alias("other"))
    pairs = some.join(others.hint("merge"), ["key", "salt"])
    once = (F.col("other.component") == F.col("main")) | (F.col("me.id") < F.col("other.id"))
    pairs = pairs.where(once & _met(F.col("me"), F.col("other"), percent)).select(*_pair(F.col("me"), F.col("other"))).mapInArrow(_likely(percent), "a long, b long")

    many = open_.where(~few).select("id", "component", "n", "regs").distinct()
    if many.isEmpty():
        return pairs
    many = written(many, "crowded")
    near = sharing_rare(many, texts, k, percent)
    a, b = (many.select(F.col("id").alias(i), F.col("n").alias(f"n{i}"), F.col("regs").alias(f"r{i}")) for i in "ab")
    near = near.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", "na", "nb", "ra", "rb")
    return pairs.union(near.mapInArrow(_likely_in_band(percent), "a long, b long"))


def links(docs: DataFrame, sets: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """Classes of equal sets, and (node, component) of the classes' first ids that link."""
    classes = sets.where("n > 0 and id is not null").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("regs").alias("regs"), F.count("*").alias("copies"))
    classes = written(classes, "classes")
    most = crowd(classes.count(), 1000)
    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.col("regs").substr(1 + 2 * ROWS * i, F.lit(2 * ROWS)))))
    keyed = classes.select("id", band.alias("band", "key"))
    shared = join_crowded(keyed, keyed.groupBy("key").agg(F.count("*").alias("met")).where("met > 1"), ["key"], F.col("met") > most)
    salts = F.when(F.col("met") > most, F.ceil(F.col("met") / most).cast("int"))
    shared = written(shared.withColumn("salts", salts).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")), "buckets")
    if shared.isEmpty():
        return classes, None
    rank = shared.groupBy("id").agg(F.sum("met").alias("rank"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    info = written(classes.select("id", "n", "regs").join(rank, "id"), "met")
    # the ids grow with the documents: no broadcast, at no size
    texts = written(texts.join(info.select("id").distinct().hint("merge"), "id", "left_semi"), "texts")

    def members(comp: DataFrame | None) -> DataFrame:
        all_ = shared.join(info, "id")
        if comp is None:
            return all_.withColumn("component", F.col("id"))
        return all_.join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))

    def verified(likely: DataFrame, tested: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """The pairs that weren't tested yet, and those of them that link."""
        likely = likely.distinct()
        likely = written(likely if tested is None else likely.join(tested.hint("merge"), ["a", "b"], "left_anti"), "pairs")
        ta, tb = (texts.select(F.col("id").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
        linked = likely.join(ta.hint("merge"), "a").join(tb.hint("merge"), "b").select("a", "b", "ta", "tb").mapInArrow(_verify(k, percent), "a long, b long")
        return likely, written(linked.distinct(), "links")

    tested, comp = None, None
    for turn in range(TURNS + 1):
        last = turn == TURNS
        pairs = remaining(members(comp), texts, k, percent, most) if last else candidates(members(comp), turn, percent).mapInArrow(_likely(percent), "a long, b long")
        likely, new = verified(pairs, tested)
        tested = likely if tested is None else tested.union(likely)
        if not new.isEmpty():
            found = new if comp is None else comp.select(F.col("component").alias("a"), F.col("node").alias("b")).union(new)
            comp = written(components(found), "components")
    return classes, comp


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 80) -> DataFrame:
    """Every row's (id_col, n_shingles, component_id, kept): near-duplicate groups of documents.

    Words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased, a set holds the
    distinct k-word shingles; two documents link if 100 * intersection >=
    percent * union. Null or wordless text: an empty set, linked with nothing,
    kept. Fewer words than k: the whole sequence is the one shingle. Rows with
    equal sets are one class, whatever their number. Rows that share an id count
    as one document, linked if any of their texts is; each row is returned. A
    null id is grouped by equal sets only and isn't kept then. Other columns are
    ignored. An empty table gives no rows.
    """
    need_columns(docs, id_col, text_col)
    sets = written(sketches(docs, id_col, text_col, k), "sketches")
    classes, comp = links(docs, sets, id_col, text_col, k, percent)
    group = classes.select("h1", "h2", "id", "copies")
    if comp is None:
        group = group.select("h1", "h2", "copies", F.col("id").alias("component_id"))
    else:
        group = group.join(comp.withColumnRenamed("node", "id"), "id", "left").select("h1", "h2", "copies", F.coalesce("component", "id").alias("component_id"))
    full = sets.where("n > 0").select("id", "n", "h1", "h2")
    lone = full.where("id is null").join(group, ["h1", "h2"], "left").select("id", "n", "component_id")
    some = join_crowded(full.where("id is not null"), group, ["h1", "h2"], F.col("copies") > crowd(sets.count(), 1000)).select("id", "n", "component_id").union(lone)
    none = sets.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return some.union(none).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without near-duplicates: of each group the row of the smallest id.

    Rows that repeat a kept id are one document and leave one row; rows without
    an id have no place in a group and stay.
    """
    need_columns(docs, id_col, text_col)
    kept = near_duplicates(docs, id_col, text_col, k, percent).where("kept").select(id_col).distinct()
    found = docs.where(F.col(id_col).isNotNull()).join(kept, id_col, "left_semi").dropDuplicates([id_col])
    return found.select(*docs.columns).union(docs.where(F.col(id_col).isNull()))
