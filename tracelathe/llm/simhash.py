"""Document fingerprints: SimHash of weighted terms, and search within a Hamming radius.

A term is a word (between white space) with the one before it.  Every occurrence of a term votes on the 64
bits of its hash, so a term weighs as often as it occurs; a bit is set where more than half of the
votes are.  All in Spark's own functions: the votes of a chunk of terms are summed for four bits at
once, in the quarters of a BIGINT, and only the chunks' sums are taken apart.

Search cuts the 64 bits into blocks.  Fingerprints within radius r differ in at most r blocks, so
with b blocks they agree on some b - r of them: one table per choice of b - r blocks, keyed by
these bits, finds them all.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelathe.llm.common import SPACES, materialize
from tracelathe.operators import carry

#: Four counters of 16 bits in one BIGINT; a chunk of this many terms fills none of them.
_LANES, _CHUNK = (1 << 48) | (1 << 32) | (1 << 16) | 1, 1 << 14
#: Identical rows given out together.
_COPIES = 1 << 16


def fingerprints(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and fingerprint (BIGINT), one row per distinct value of ``keys``, which must name the texts.

    Equal texts have equal fingerprints; null counts as empty; a text without words is one empty term."""
    # White space at either end would leave an empty word.
    words = df.select(*keys, F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SPACES), "").alias("__words"))
    words = words.select(*keys, "__words", F.posexplode_outer("__words").alias("__at", "__word"))
    before = F.when(F.col("__at") > 0, F.get("__words", F.col("__at") - 1)).otherwise(F.lit(""))
    terms = words.select(*keys, F.expr(f"__at DIV {_CHUNK}").alias("__chunk"), F.xxhash64(before, F.coalesce("__word", F.lit(""))).alias("__term"))
    packed = terms.groupBy(*keys, "__chunk").agg(F.count("*").alias("__n"), *[
        F.sum(F.shiftrightunsigned("__term", i).bitwiseAND(F.lit(_LANES))).alias(f"__p{i}") for i in range(16)])
    lane = lambda b: F.shiftrightunsigned(f"__p{b % 16}", b // 16 * 16).bitwiseAND(F.lit(0xFFFF))
    votes = packed.groupBy(*keys).agg(F.sum("__n").alias("__n"), *[F.sum(lane(b)).alias(f"__v{b}") for b in range(64)])
    bits = [F.shiftleft((2 * F.col(f"__v{b}") > F.col("__n")).cast("long"), b) for b in range(64)]
    return votes.select(*keys, reduce(Column.bitwiseOR, bits).alias("fingerprint"))


def as_hex(fingerprint: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def likeness(a: Column | str, b: Column | str) -> Column:
    """Share of equal bits."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64.0


def within_radius(queries: DataFrame, stored: DataFrame, radius: int = 3, blocks: int = 6, column: str = "fingerprint") -> DataFrame:
    """All pairs (query, found, distance) of distinct fingerprints at most ``radius`` bits apart, exactly.

    Equal fingerprints are one row on either side (join them with their documents as needed), so copies make
    no pairs.  Null fingerprints find nothing.  ``blocks`` trades the number of tables for their selectivity."""
    cut = [64 * i // blocks for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << (cut[k + 1] - cut[k])) - 1) << cut[k] for k in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)

    def tables(df: DataFrame, name: str) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(t).alias("table"), F.col(name).bitwiseAND(F.lit(m)).alias("bits")) for t, m in enumerate(masks)])
        return df.filter(F.col(column).isNotNull()).select(F.col(column).alias(name)).distinct().select(name, F.inline(keys))

    near = tables(queries, "query").join(tables(stored, "found").hint("merge"), ["table", "bits"])
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("found")))
    first = reduce(F.least, [F.when(F.col("query").bitwiseAND(F.lit(m)) == F.col("found").bitwiseAND(F.lit(m)), t).otherwise(len(masks)) for t, m in enumerate(masks)])
    # Several tables may find a pair; the first one reports it.
    return near.filter((distance <= radius) & (F.col("table") == first)).select("query", "found", distance.alias("distance"))


def count_within(prints: DataFrame, queries: DataFrame, radius: int = 3, column: str = "fingerprint") -> DataFrame:
    """How many rows of ``prints`` lie within ``radius`` bits of each distinct fingerprint of ``queries``:
    (fingerprint, n_within).  Equal fingerprints are counted before they are searched."""
    stored = prints.groupBy(column).agg(F.count("*").alias("__n"))
    found = within_radius(queries, stored, radius, column=column).join(stored.hint("merge"), F.col("found") == F.col(column)).drop(column)
    return found.groupBy("query").agg(F.sum("__n").alias("n_within")).withColumnRenamed("query", column)


#: What names a row up to identical ones, in the order of ids: null ids first, ties by the text's hash.
_KEYS = ["some", "key", "h1", "h2"]


def _named(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows with their names (``_KEYS``), doc_id (BIGINT) and text (null: empty)."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return docs.select(F.col("doc_id").isNotNull().cast("int").alias("some"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("key"),
                       F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "doc_id", "text")


def with_next(df: DataFrame, doc_id: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """Which row follows each, in descending order of ``doc_id``: some, key, h1, h2 (the row), next (these of the row
    after), n (rows identical to it), n_chars, stored as a table.  One row per distinct (id, text); the row after the last is the first.

    Only ids and hashes are ordered, by ranges cut anew as the table grows (``partitions`` fixes their number), and a row per range
    carries its neighbour over the seam: no range, and no number of them, is a bound.  Identical rows are counted first; of
    them all but the last are followed by their own text.  Rows of one id, or of null ids (which come last), are ordered by two
    64-bit hashes of their texts, so that ranges may cut among them."""
    rows = _named(df, doc_id, text).groupBy(*_KEYS).agg(F.count("*").alias("n"), F.max(F.char_length("text")).alias("n_chars"))
    cut = carry.range_chunks(rows.withColumn("all", F.lit(0)), _KEYS, "id-order", partitions)
    # Going up, the row before is the one that follows going down.
    seen = carry.with_previous(cut, ["all"], _KEYS, _KEYS, out="next")
    top = cut.agg(F.max(F.struct(*_KEYS)).alias("top")).head()["top"]
    if top is not None:
        seen = seen.withColumn("next", F.coalesce("next", F.struct(*[F.lit(top[k]).cast(rows.schema[k].dataType).alias(k) for k in _KEYS])))
    return materialize(seen.select(*_KEYS, "next", "n", "n_chars"), "next-ids")


def edited_likeness(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **order) -> DataFrame:
    """Per row of ``df``: doc_id, n_chars, edited_sha256, fingerprint and edited_fingerprint (BIGINT), near_edited, near_next.

    The edited text is the text with its last third (rounded down) replaced by the first as many
    characters of the next row's text.  Null texts are empty; repeated rows are rows of their own, each the next of the one
    before; null ids come last and stay null; a lone row is its own next; an empty table gives an empty table.

    Each distinct row's text is shuffled once, and from it only the part that goes into its predecessor's edited text."""
    links = with_next(df, doc_id, text, **order)
    texts = _named(df, doc_id, text).groupBy(*_KEYS).agg(F.first("text").alias("text"))
    # What a row lends to the one before it.
    lent = (links.select(*[F.col(k).alias(f"for_{k}") for k in _KEYS], *[F.col(f"next.{k}").alias(k) for k in _KEYS], "n_chars")
            .join(texts.hint("merge"), _KEYS)
            .select(*[F.col(f"for_{k}").alias(k) for k in _KEYS], F.substring("text", F.lit(1), F.expr("CAST(n_chars DIV 3 AS INT)")).alias("head")))
    rows = texts.hint("merge").join(links, _KEYS).join(lent.hint("merge"), _KEYS)
    kept = F.substring(F.col("text"), F.lit(1), F.expr("n_chars - CAST(n_chars DIV 3 AS INT)"))
    own = F.concat(kept, F.substring("text", F.lit(1), F.expr("CAST(n_chars DIV 3 AS INT)")))
    body = lambda which, c: F.struct(F.lit(which).alias("which"), c.alias("body"), F.sha2(c, 256).alias("sha"))
    bodies = F.array(body(0, F.col("text")), body(1, F.concat(kept, "head")))
    both = rows.select(*_KEYS, "next", "n", "n_chars", F.inline(F.when(F.col("n") > 1, F.array_append(bodies, body(2, own))).otherwise(bodies)))
    held = [*_KEYS, "next", "n", "n_chars"]
    prints = fingerprints(both, [*held, "which", "sha"], "body")
    of = lambda which, c: F.max(F.when(F.col("which") == which, F.col(c)))
    one = materialize(prints.groupBy(*held).agg(
        of(0, "fingerprint").alias("fingerprint"), *[of(w, c).alias(f"{c}{w}") for w in (1, 2) for c in ("fingerprint", "sha")]), "row-prints")
    after = one.select(*[F.col(k).alias(f"next_{k}") for k in _KEYS], F.col("fingerprint").alias("next_fingerprint"))
    last = one.join(after, [F.col(f"next.{k}") == F.col(f"next_{k}") for k in _KEYS])
    # Of n identical rows the last is followed by the next row, the others by their like: in blocks, dealt to tasks, however many.
    blocks = one.filter("n > 1").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 2) DIV {_COPIES}"))))
    size = F.least(F.lit(_COPIES).cast("long"), F.col("n") - 1 - F.col("block") * _COPIES).cast("int")
    likes = blocks.repartition(*_KEYS, "block").withColumn("copy", F.explode(F.array_repeat(F.lit(True), size)))

    def told(rows: DataFrame, which: int, beside: str) -> DataFrame:
        return rows.select(F.when(F.col("some") == 1, F.col("key")).alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"),
                           F.col(f"sha{which}").alias("edited_sha256"), "fingerprint", F.col(f"fingerprint{which}").alias("edited_fingerprint"),
                           likeness("fingerprint", f"fingerprint{which}").alias("near_edited"), likeness("fingerprint", beside).alias("near_next"))

    return told(last, 1, "next_fingerprint").unionByName(told(likes, 2, "fingerprint"))
