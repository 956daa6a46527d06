"""Mixing sources to target weights by a low-discrepancy schedule.

Slots are numbered; the golden-ratio point of a slot falls into the interval of one source, whose
width is its share.  A slot's rank among the slots of its source names a block of that source's
shuffled text stream, cut into blocks of equally many words; after the last block the next pass
begins.  So every stretch of the schedule holds every source in nearly its share, reruns agree,
and no source is short by more than a few slots, which closing slots at the end make up for.
``interleaved`` gives the mix in this order, ``mixed_documents`` whole rows in the order of their first words.

Positions in streams and ranks of slots are running sums in two levels (sums of buckets, then
inside buckets), so a source that holds a third of all rows is never sorted in one task.
Only tables with one row per source, or per bucket of a source, pass through a single window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelathe.llm.common import WORD, materialize, plain

#: The golden-ratio multiplier for points k / 2^31 (odd, so a period visits every point once).
PERIOD, STEP = 1 << 31, 1327217885
CELLS, CHUNK = 4096, 1 << 16
_KEYS = ["doc_id", "source", "text_key", "size", "source_size", "target"]


def words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text if isinstance(text, Column) else F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], repeat: float) -> DataFrame:
    """From source, source_size to no (order by code point, null last), weight and target: the weights
    share all words, no source takes more than ``repeat`` times its size, the excess is reshared."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("no") % len(weights) + 1).cast("int"))
    rows = (sources.withColumn("no", F.row_number().over(order) - 1).withColumn("weight", w)
            .withColumn("cap", repeat * F.col("source_size")))
    # Sources are full in the order of cap / weight: the level is set by the first that stays below its cap.
    full = Window.orderBy(F.col("cap") / F.col("weight"), "no")
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = (rows.withColumn("__total", F.sum("source_size").over(everything))
            .withColumn("__left", F.col("__total") - (F.sum("cap").over(full) - F.col("cap")))
            .withColumn("__open", F.sum("weight").over(full.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
            .withColumn("__level", F.col("__left") / F.col("__open")))
    below = F.when(F.col("__level") <= F.col("cap") / F.col("weight"), F.col("__level"))
    rows = rows.withColumn("__share", F.coalesce(F.first(below, ignorenulls=True).over(full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(float("inf"))))
    return rows.select("source", "source_size", F.col("no").cast("long").alias("no"),
                       F.least("cap", F.col("__share") * F.col("weight")).alias("target"))


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """Slots (slot, no, rank): for each source as many as its target needs, ranked by their place ``slot`` in the schedule."""
    spark = sources.sparkSession
    by_no = Window.orderBy("no")
    whole = sources.withColumn("hi", F.sum("target").over(by_no)).withColumn("lo", F.col("hi") - F.col("target"))
    total = whole.agg(F.coalesce(F.max("hi"), F.lit(0.0))).head()[0]
    slots = int(-(-total // block))
    if not slots:
        return sources.filter("false").select(F.lit(0).cast("long").alias("slot"), "no", F.lit(0).cast("long").alias("rank"))
    cell = lambda x: F.least(F.floor(x * CELLS), F.lit(CELLS - 1))
    shares = (whole.filter("target > 0").select("no", (F.col("lo") / total).alias("lo"), (F.col("hi") / total).alias("hi"))
              .withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi"))))))
    point = ((F.col("id") % PERIOD) * STEP % PERIOD) / F.lit(float(PERIOD))
    drawn = (spark.range(slots).withColumn("point", point).withColumn("cell", cell(F.col("point")))
             .join(shares, "cell").filter("lo <= point AND point < hi")
             .select("no", "id", (F.col("id") / CHUNK).cast("long").alias("chunk")))
    before = (drawn.groupBy("no", "chunk").agg(F.count("*").alias("n"))
              .withColumn("before", F.sum("n").over(Window.partitionBy("no").orderBy("chunk")) - F.col("n")).drop("n"))
    inside = F.row_number().over(Window.partitionBy("no", "chunk").orderBy("id")) - 1
    ranked = (drawn.withColumn("inside", inside).join(before, ["no", "chunk"])
              .select(F.col("id").alias("slot"), "no", (F.col("before") + F.col("inside")).cast("long").alias("rank")))
    ranked = materialize(ranked, "slots")
    got = ranked.groupBy("no").agg(F.count("*").alias("got"))
    need = sources.join(got, "no", "left").withColumn("got", F.coalesce("got", F.lit(0).cast("long")))
    short = need.filter(F.col("got") < F.col("n_slots"))
    first = slots + F.sum(F.col("n_slots") - F.col("got")).over(by_no) - F.col("n_slots")  # of rank 0, were it a closing slot
    closing = (short.withColumn("first", first).withColumn("rank", F.explode(F.sequence(F.col("got"), F.col("n_slots") - 1)))
               .select((F.col("first") + F.col("rank")).alias("slot"), "no", "rank"))
    return ranked.unionByName(closing)


def _deal(df: DataFrame, weights: tuple[float, ...] = (5, 2, 1), repeat: float = 3, block: int = 64, doc_id: str = "doc_id",
          source: str = "source", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` by their places in their sources' streams, and their pieces by slots: a row per block
    that a row of ``df`` touches and slot that takes the block, or with a null slot where none does."""
    rows = materialize(df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                                 F.md5(F.coalesce(F.col(text), F.lit(""))).alias("text_key"), words(text).alias("size")), "sizes")
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeat)
    # A pass has n blocks, the last one shorter; the target ends inside a block of some pass.
    aim, size = F.floor(F.col("target") + 1e-6), F.greatest("source_size", F.lit(1))
    sources = materialize(sources.withColumn("aim", aim).withColumn("n_blocks", F.ceil(size / block))
                          .withColumn("n_slots", F.expr("aim DIV greatest(source_size, 1)") * F.col("n_blocks") + F.ceil((F.col("aim") % size) / block)), "sources")

    mixed = F.xxhash64("doc_id", "text_key")
    placed = (rows.join(sources.select(F.col("source").alias("__source"), "no", "source_size", "target"),
                        F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
              .withColumn("__order", mixed).withColumn("__bucket", F.shiftright("__order", 52)))
    sums = (placed.groupBy("no", "__bucket").agg(F.sum("size").alias("__sum"))
            .withColumn("__before", F.sum("__sum").over(Window.partitionBy("no").orderBy("__bucket")) - F.col("__sum")).drop("__sum"))
    inside = F.sum("size").over(Window.partitionBy("no", "__bucket").orderBy("__order", "doc_id", "text_key")
                                .rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    placed = (placed.withColumn("__inside", inside).join(sums, ["no", "__bucket"])
              .withColumn("begin", F.col("__before") + F.col("__inside")).drop("__before", "__inside", "__bucket", "__order"))
    placed = materialize(placed, "placed")

    slots = schedule(sources, block).join(sources.select("no", "source_size", "aim", "n_blocks"), "no")
    j = F.col("rank") % F.col("n_blocks")
    before = F.expr("rank DIV n_blocks") * F.col("source_size") + j * block
    length = F.least(F.lit(block), F.col("source_size") - j * block, F.col("aim") - before)
    turns = slots.select("slot", "no", F.expr("rank DIV n_blocks").alias("pass"), j.alias("block"), length.cast("long").alias("__length")).filter("__length > 0")

    pieces = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"begin DIV {block}"), F.expr(f"(begin + size - 1) DIV {block}"))))
    start, lead = F.greatest("begin", F.col("block") * block), F.col("block") * block
    length = F.greatest(F.lit(0), F.least(F.col("begin") + F.col("size"), lead + F.col("__length")) - start)
    dealt = (pieces.join(turns, ["no", "block"], "left")
             .select(*_KEYS, "no", F.col("begin").alias("place"), "slot", "pass", "block", (start - lead).alias("at"), (start - F.col("begin")).alias("begin"),
                     F.when(F.col("slot").isNotNull(), length).otherwise(0).cast("long").alias("length")))
    return placed, dealt


def interleaved(df: DataFrame, **options) -> DataFrame:
    """The mix: slot, at, doc_id, source, text_key (md5), block, begin, length.

    In the order of slot and at (the place within the slot), each row is ``length`` words of a document from its
    word ``begin`` on (from 0); they lie in ``block`` of the source's stream.  ``options`` are those of ``mix``."""
    return _deal(df, **options)[1].filter("length > 0").select("slot", "at", "doc_id", "source", "text_key", "block", "begin", "length")


def mix(df: DataFrame, weights: tuple[float, ...] = (5, 2, 1), repeat: float = 3, block: int = 64, doc_id: str = "doc_id",
        source: str = "source", text: str = "text") -> DataFrame:
    """Per row of ``df``: doc_id, source, text_key (md5), size, source_size, target, taken.

    size counts words (null text: 0); ``weights`` go round the sources in code-point order, null
    last; taken counts the words of the row that the mix takes, at most ``repeat`` (rounded up) times
    its size.  Rows without words take 0.  Repeated rows are rows of their own.  An empty table
    gives an empty table.
    """
    placed, dealt = _deal(df, weights, repeat, block, doc_id, source, text)
    taken = dealt.groupBy(*_KEYS, "no", "place").agg(F.sum("length").alias("taken"))
    return taken.select(*_KEYS, "taken").unionByName(placed.filter("size = 0").select(*_KEYS, F.lit(0).cast("long").alias("taken")))


def mixed_documents(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", part_words: int = 10_000_000,
                    most_parts: int = 100_000, **options) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it (taken / size, rounded), in the order of the
    slots that take their first words.  Rows without words are not taken.

    Only the document at the end of a source's target is taken in part; it comes whole where that leaves the
    smaller error.  A source with a target above 0 that would have no row by this gets its row of the size
    nearest to the target, in the place of its first slot, or at the end where it has none.

    Texts travel twice: to meet their places, and to the partition of their slot.  As slots hold equally many words, equal
    ranges of slots make equal partitions (of about ``part_words``, or ``most_parts`` larger ones), so nothing is sampled.  Rows equal in id, source and text are
    told apart by number; only those are stored in between.  An empty table gives an empty table; columns of ``df`` are kept as
    they are, whatever their names."""
    placed, dealt = _deal(df, doc_id=doc_id, source=source, text=text, **options)
    dealt = materialize(dealt.filter("length > 0").select("doc_id", "source", "text_key", "no", "size", "place", "pass", "slot", "at", "begin", "length"), "dealt")
    copies = (dealt.groupBy("doc_id", "source", "text_key", "size", "place", "pass")
              .agg(F.sum("length").alias("taken"), F.min(F.struct("slot", "at")).alias("__start")).filter("2 * taken >= size"))
    # A source's first row comes before all its others: it alone tells whether the source has a row.
    first = placed.filter("size > 0 AND begin = 0").select("no", F.col("size").alias("__size"), F.col("target").alias("__target"))
    first = first.filter("2 * floor(__target + 1e-6) < __size AND __target > 0").select("no")
    nearest = placed.filter("size > 0").join(first, "no").groupBy("no").agg(F.min(F.struct(
        F.abs(F.col("size") - F.col("target")).alias("error"), F.col("begin").alias("place"), "doc_id", "source", "text_key")).alias("it"))
    starts = dealt.filter("place = 0 AND begin = 0").groupBy("no").agg(F.min(F.struct("slot", "at")).alias("__start"))
    end = F.struct(F.lit(2**63 - 1).alias("slot"), F.col("no").alias("at"))
    nearest = nearest.join(starts, "no", "left").select("it.doc_id", "it.source", "it.text_key", "it.place", F.coalesce("__start", end).alias("__start"))
    copies = copies.select("doc_id", "source", "text_key", "place", "__start").unionByName(nearest)

    row = lambda *c: F.md5(F.to_json(F.struct(*[F.col(x).alias(f"c{k}") for k, x in enumerate(c)])))
    copies = copies.select(row("doc_id", "source", "text_key").alias("__row"), "place", "__start")
    recurring = placed.select(row("doc_id", "source", "text_key").alias("__row")).groupBy("__row").count().filter("count > 1").select("__row", F.lit(True).alias("__many"))
    copies = materialize(copies.join(recurring, "__row", "left"), "copies")
    rows = df.withColumn("__text_key", F.md5(F.coalesce(F.col(text), F.lit("")))).withColumn("__row", row(doc_id, source, "__text_key"))
    # One entry for each recurring row here, its copies below.
    once = copies.filter("__many IS NULL").select("__row", "__start", "__many")
    several = copies.filter("__many").select("__row", F.lit(None).cast(copies.schema["__start"].dataType).alias("__start"), "__many").distinct()
    rows = rows.join(once.unionByName(several).hint("merge"), "__row")
    if not copies.filter("__many").isEmpty():
        rows = materialize(rows, "mixed")
        nth = F.row_number().over(Window.partitionBy("__row").orderBy("__row"))
        places = copies.filter("__many").select("__row", F.dense_rank().over(Window.partitionBy("__row").orderBy("place")).alias("__nth"), "__start")
        numbered = rows.filter("__many").drop("__start").withColumn("__nth", nth).join(places.hint("merge"), ["__row", "__nth"])
        rows = rows.filter("__many IS NULL").unionByName(numbered.drop("__nth"))
    last = dealt.agg(F.coalesce(F.max("slot"), F.lit(0))).head()[0]
    parts = min(most_parts, max(1, round((last + 1) * options.get("block", 64) / part_words)))
    part = F.least(F.expr(f"__start.slot DIV {-(-(last + 1) // parts)}"), F.lit(parts - 1))
    return plain(rows.repartitionById(parts, part.cast("int")).sortWithinPartitions("__start"), "__row", "__text_key", "__start", "__many")
