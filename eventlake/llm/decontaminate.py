"""Benchmark decontamination by template windows, in DataFrame functions only.

Texts become tokens; numbers, names and units become typed placeholders, so a
question that was given other numbers or names keeps its template. Windows of
``WINDOW`` canonical tokens are hashed and hash-joined between documents and
benchmark items. Matches of an item along one offset are read side by side: the
values behind the placeholders must follow one consistent renaming, else the
texts only share a form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import need_columns, unused, written

WINDOW = 8
#: A window needs so many tokens that aren't placeholders, or it says too little.
LITERALS = 4
#: Benchmark windows up to this many are broadcast (about 250 bytes each), more are joined by a shuffle.
BROADCAST_WINDOWS = 200_000
# Unit words, placeholders only behind a number.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons lb lbs pound pounds ounce ounces ml l liter liters litre litres "
    "gallon gallons second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros usd eur degree degrees percent "
    "mph kmh watt watts volt volts byte bytes kb mb gb"
).split()
#: Marks a name's first letter: a capital behind a small letter, digit or comma and one space (not at a sentence's start).
_NAME = "\u0002"
_TOKEN = rf"{_NAME}?[\p{{L}}\p{{M}}]++|[0-9]++(?:[.,:/][0-9]++)*+"


def tokens(text: Column) -> Column:
    """The text's words and numbers in order, names marked."""
    # the space is looked for first: a pattern that begins with a look behind is tried at every place
    marked = F.regexp_replace(F.replace(text, F.lit(_NAME), F.lit(" ")), r" (?=\p{Lu})(?<=[\p{Ll}\p{N},;] )", f" {_NAME}")
    return F.regexp_extract_all(marked, F.lit(_TOKEN), F.lit(0))


def kinds(toks: Column) -> Column:
    """Each token's canonical form: <num>, <name>, <unit> or the word in lower case."""

    def number(t: Column) -> Column:
        return (t >= "0") & (t < ":")  # the colon stands right behind the digits

    def one(t: Column, i: Column) -> Column:
        behind = (i > 0) & F.coalesce(number(F.get(toks, i - 1)), F.lit(False))
        return F.when(number(t), "<num>").when(t.startswith(_NAME), "<name>").when(behind & F.lower(t).isin(UNITS), "<unit>").otherwise(F.lower(t))

    return F.transform(toks, one)


def _slot(kind: Column) -> Column:
    return kind.isin("<num>", "<name>", "<unit>")


def _windows(hashes: Column, size: int = WINDOW) -> Column:
    """Hash of each window of so many token hashes; a size other than WINDOW is part of the hash."""
    n, own = F.size(hashes) - size, [] if size == WINDOW else [F.lit(size)]
    made = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.xxhash64(F.slice(hashes, i + 1, size), *own))
    return F.when(n >= 0, made).otherwise(F.array().cast("array<bigint>"))


def _places(tokens: Column, k: Column, sizes: list[int]) -> Column:
    """Where the k-th window of so many tokens begins, of all windows of the sizes, one size behind the other."""
    place, before = F.when(F.lit(False), k), F.lit(0)
    for size in sizes:
        n = F.greatest(tokens - size + 1, F.lit(0))
        place, before = place.when(k < before + n, k - before), before + n
    return place


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(hash, item, ipos, itoks, ikinds, size, n_item): every window of every item that has enough literal tokens.

    Each item comes twice: with names as placeholders, and with names as words
    in lower case, since a copy in one case shows no names. An item shorter than
    a window is one window of its own size. n_item is how many windows it has.
    Null items and texts, and those without tokens, give none; repeated rows
    count once; an empty table gives no rows.
    """
    t = benchmark.select(F.col(item_col).alias("item"), tokens(F.col(text_col).cast("string")).alias("toks")).where("item is not null and size(toks) > 0").distinct()
    plain = t.withColumn("toks", F.transform("toks", lambda x: F.regexp_replace(x, _NAME, "")))
    t = t.union(plain).distinct().withColumn("kinds", kinds(F.col("toks")))
    t = t.withColumn("hashes", F.transform("kinds", lambda k: F.xxhash64(k)))
    one = F.array(F.xxhash64("hashes", F.size("hashes")))
    t = t.select("item", "toks", "kinds", F.least(F.size("hashes"), F.lit(WINDOW)).alias("size"), F.posexplode(F.when(F.size("hashes") < WINDOW, one).otherwise(_windows(F.col("hashes")))).alias("ipos", "hash"))
    cut = lambda c: F.slice(c, F.col("ipos") + 1, F.col("size"))
    t = t.select("item", "ipos", "hash", "size", cut("toks").alias("itoks"), cut("kinds").alias("ikinds"))
    t = t.where(F.size(F.filter("ikinds", lambda k: ~_slot(k))) >= LITERALS)
    return t.join(t.groupBy("item").agg(F.countDistinct("ipos").alias("n_item")), "item")


def _key(id_col: str, text_col: str) -> Column:
    """What names a document: its id, or its text where that is null."""
    return F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text-"), F.md5(F.col(text_col).cast("string").cast("binary"))))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", run: int = 6, coverage: float = 0.8, consistent: float = 0.8) -> DataFrame:
    """One row for each document and benchmark item that it contains.

    Columns: key (the id as text, or text-<md5> for a null id), id_col, item_col,
    n_windows (distinct matching windows of the item), coverage (of the item's
    windows), longest (most windows along one offset), first_token (where the
    best offset's first match starts in the document), n_slots and consistency
    (share of the item's slot values along that offset that stand for one value
    each in the document; 1 without slots), verbatim (all slot values equal).

    An item counts as contained if ``run`` windows match along one offset (a run
    of 13 tokens) or ``coverage`` of its windows match, by offsets whose
    consistency is at least ``consistent``: no placeholder's value in the item
    stands for two in the document, nor the other way round. An item of 4 to 7
    tokens is one window. Null and empty texts contain nothing; an item or window
    with fewer than ``LITERALS`` tokens besides placeholders can't be found. A
    repeated item counts once. Rows with one id are one document. Both tables may
    be empty; other columns are ignored.
    """
    need_columns(docs, id_col, text_col)
    need_columns(benchmark, item_col, "text")
    items = written(benchmark_windows(benchmark, item_col), "benchmark-windows")
    n = items.count()
    sizes = [WINDOW, *sorted(r["size"] for r in items.select("size").distinct().collect() if r["size"] != WINDOW)]
    items = items.drop("size")
    text = F.col(text_col).cast("string")
    texts = docs.select(_key(id_col, text_col).alias("key"), F.xxhash64(text).alias("same"), F.col(id_col).alias("id"), text.alias("text")).where("text is not null")
    d = texts.select("key", "same", tokens(F.col("text")).alias("toks"))
    # a column of its own: within the windows' expression it would be made again for each of them
    d = d.select("key", "same", F.transform(kinds(F.col("toks")), lambda k: F.xxhash64(k)).alias("hashes"))
    if len(sizes) == 1:
        each = d.select("key", "same", F.posexplode(_windows(F.col("hashes"))).alias("pos", "hash"))
    else:
        each = d.withColumn("n", F.size("hashes")).select("key", "same", "n", F.posexplode(F.concat(*(_windows(F.col("hashes"), x) for x in sizes))).alias("k", "hash"))
        each = each.select("key", "same", _places(F.col("n"), F.col("k"), sizes).alias("pos"), "hash")
    # windows go without their texts, which only those with a hit need afterwards
    hit = written(each.join(F.broadcast(items) if n <= BROADCAST_WINDOWS else items.hint("merge"), "hash").distinct(), "hits")
    own = texts.join(hit.select("key", "same").distinct(), ["key", "same"], "left_semi").dropDuplicates(["key", "same"])
    hit = hit.join(own.withColumn("toks", tokens(F.col("text"))), ["key", "same"])
    hit = hit.select("key", "id", "item", "pos", "ipos", "n_item", (F.col("pos") - F.col("ipos")).alias("offset"), F.slice("toks", F.col("pos") + 1, F.size("itoks")).alias("dtoks"), "itoks", "ikinds")
    three = F.arrays_zip(F.col("ikinds").alias("k"), F.col("itoks").alias("i"), F.col("dtoks").alias("d"))
    pairs = F.transform(F.filter(three, lambda t: _slot(t["k"])), lambda t: F.struct(t["k"].alias("k"), F.lower(t["i"]).alias("i"), F.lower(t["d"]).alias("d")))
    along = hit.groupBy("key", "item", "offset").agg(
        F.max("id").alias("id"), F.max("n_item").alias("n_item"), F.collect_set("ipos").alias("iposes"), F.min("pos").alias("first_token"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs")
    )

    def values(side: str) -> Column:
        return F.array_distinct(F.transform("pairs", lambda p: F.struct(p["k"].alias("k"), p[side].alias("v"))))

    def single(side: str) -> Column:
        """Share of the values of one side that stand for one value of the other."""
        alone = F.filter(values(side), lambda v: F.size(F.filter("pairs", lambda p: (p["k"] == v["k"]) & (p[side] == v["v"]))) == 1)
        return F.size(alone) / F.size(values(side))

    along = along.withColumns({"n": F.size("iposes"), "n_slots": F.size(values("i")), "consistency": F.when(F.size("pairs") == 0, 1.0).otherwise(F.least(single("i"), single("d")))})
    along = along.where(F.col("consistency") >= consistent).withColumn("verbatim", F.forall("pairs", lambda p: p["i"] == p["d"]))
    best = F.struct("n", F.col("consistency").alias("c"), (-F.col("offset")).alias("o"), "first_token", "n_slots", "verbatim")
    found = along.groupBy("key", "item").agg(F.max("id").alias("id"), F.max("n_item").alias("n_item"), F.max(best).alias("best"), F.array_distinct(F.flatten(F.collect_set("iposes"))).alias("all"))
    share = F.size("all") / F.col("n_item")
    return found.where((F.col("best.n") >= run) | (share >= coverage)).select(
        "key", F.col("id").alias(id_col), F.col("item").alias(item_col), F.size("all").cast("long").alias("n_windows"), share.alias("coverage"), F.col("best.n").cast("long").alias("longest"),
        F.col("best.first_token").cast("long").alias("first_token"), F.col("best.n_slots").cast("long").alias("n_slots"), F.col("best.c").alias("consistency"), F.col("best.verbatim").alias("verbatim"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of docs without those that contain a benchmark item (see matches); a row without an id goes by its text."""
    (name,) = unused(docs, "_key")
    found = matches(docs, benchmark, id_col, text_col, item_col).select(F.col("key").alias(name)).distinct()
    return docs.withColumn(name, _key(id_col, text_col)).join(found, name, "left_anti").select(*docs.columns)
