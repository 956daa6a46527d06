"""TF-IDF over register descriptions and over documents."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracelathe.operators import carry
from tracelathe.schema import CORPUS_VOCABULARY, RUN_VOCABULARY, TOP_REGISTERS, TOP_TERMS
from tracelathe.session import materialize

# Words that may be broadcast to tell which grams are worth counting: at most so many, of so many bytes together.
BROADCAST_WORDS, BROADCAST_BYTES = 200_000, 8 << 20

# Fixed value: words are runs of two or more letters, digits or underscores.
WORD = r"[\p{L}\p{N}_]{2,}"


def stop_words(spark: SparkSession) -> list[str]:
    """Spark's English stop words."""
    return list(StopWordsRemover.loadDefaultStopWords("english"))


def word_tokens(text: Column, stop: list[str]) -> Column:
    """Lower-cased words of two or more characters, stop words left out."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)),
                    lambda w: ~w.isin(stop))


def grams(docs: DataFrame, keys: list[str], tokens: Column, words: DataFrame | None = None) -> DataFrame:
    """(keys, term): one row per 1- to 3-gram of a token array, joined by single spaces; with ``words``
    (term, few enough to broadcast) only grams made of these."""
    t = F.col("_t")
    at = F.explode(F.arrays_zip(t.alias("a"), F.slice(t, 2, 1 << 30).alias("b"), F.slice(t, 3, 1 << 30).alias("c")))
    three = docs.select(*keys, tokens.alias("_t")).select(*keys, at.alias("_g")).select(*keys, "_g.*")
    if words is not None:
        for c, how in (("a", "inner"), ("b", "left"), ("c", "left")):
            known = F.broadcast(words.select(F.col("term").alias(f"_{c}")))
            three = three.join(known, F.col(c) == F.col(f"_{c}"), how)
        three = three.select(*keys, "a", F.col("_b").alias("b"), F.col("_c").alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    # Slices end early; the tokens missing there are null, and so are the grams.
    listed = F.array(a, F.concat(a, F.lit(" "), b), F.concat(a, F.lit(" "), b, F.lit(" "), c))
    return three.select(*keys, F.explode(listed).alias("term")).where("term is not null")


def vocabulary(found: DataFrame, corpus: list[str], cap: int) -> DataFrame:
    """The ``cap`` most frequent terms per corpus; ``found`` holds (corpus, term, n) with any
    number of rows per term."""
    terms = found.groupBy(*corpus, "term").agg(F.sum("n").alias("corpus_tf"))
    return carry.at_most(terms, corpus, [F.desc("corpus_tf"), F.asc("term")], cap, "term_no")


def tfidf(counted: DataFrame, sizes: DataFrame, corpus: list[str], doc: list[str]) -> DataFrame:
    """Unit-length TF-IDF weights (corpus, doc, mult, term, weight), idf = ln((1+n)/(1+df)) + 1.

    ``counted`` holds (corpus, doc, mult, term, tf) of vocabulary terms only; ``mult`` says how
    many equal rows a doc stands for; ``sizes`` holds (corpus, n_docs).
    """
    idf = (counted.groupBy(*corpus, "term").agg(F.sum("mult").alias("df")).join(sizes, corpus).select(
        *corpus, "term", (F.ln((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf")))
    weighed = carry.salted_join(counted, idf, [*corpus, "term"], doc).withColumn("_w", F.col("tf") * F.col("idf"))
    # One text's vocabulary terms: as many as the text has, and never more than the cap.
    per_doc = weighed.groupBy(*corpus, *doc, "mult").agg(
        F.sqrt(F.sum(F.col("_w") ** 2)).alias("_norm"), F.collect_list(F.struct("term", "_w")).alias("_terms"))
    return (per_doc.select(*corpus, *doc, "mult", "_norm", F.explode("_terms").alias("_e"))
            .select(*corpus, *doc, "mult", F.col("_e.term").alias("term"),
                    (F.col("_e._w") / F.col("_norm")).alias("weight")))


def frequent_words(words: DataFrame, cap: int) -> DataFrame | None:
    """Words (term) that a gram among the ``cap`` most frequent can hold, out of all (term, n); None where there
    are fewer words than ``cap`` or too many of these to broadcast.

    A gram is never more frequent than its rarest word, and ``cap`` words alone are as frequent as the last of
    the ``cap`` best words: grams with a rarer word are out.  Words that tie with the last one stay.
    """
    best = words.orderBy(F.desc("n")).limit(cap).agg(F.count("*").alias("k"), F.min("n").alias("least")).first()
    if best.k < cap or not cap:
        return None
    kept = words.where(F.col("n") >= best.least)
    size = kept.agg(F.count("*").alias("k"), F.sum(F.octet_length("term")).alias("bytes")).first()
    return kept.select("term") if size.k <= BROADCAST_WORDS and size.bytes <= BROADCAST_BYTES else None


def document_tfidf(docs: DataFrame, doc: str, text: str, cap: int = CORPUS_VOCABULARY) -> DataFrame:
    """TF-IDF of free texts against their whole corpus: (doc, term, weight).

    Words are counted over the corpus first, then the grams that the words' counts leave in question; only those
    of the vocabulary (at most ``cap`` rows, so it is broadcast) are then shuffled by document.
    """
    # Stored, as they are read three times and finding them is most of the work.
    told = materialize(docs.select(doc, word_tokens(F.col(text), stop_words(docs.sparkSession)).alias("_words")), "tokens")
    words = materialize(told.select(F.explode("_words").alias("term")).groupBy("term").agg(F.count("*").alias("n")),
                        "word-counts")
    found = grams(told, [doc], F.col("_words"), frequent_words(words, cap))
    vocab = (found.groupBy("term").agg(F.count("*").alias("n"))
             .orderBy(F.desc("n"), F.asc("term")).limit(cap).select("term"))
    counted = materialize(found.join(F.broadcast(vocab), "term").groupBy(doc, "term").agg(F.count("*").alias("tf")), "term-counts")
    return corpus_weights(counted, told, doc)


def corpus_weights(counted: DataFrame, docs: DataFrame, doc: str) -> DataFrame:
    """Weights of vocabulary counts (doc, term, tf) against one corpus; ``docs`` lists all documents."""
    one = F.lit(0).alias("_c")
    sizes = docs.agg(F.count("*").alias("n_docs")).select(one, "n_docs")
    return tfidf(counted.select(one, doc, F.lit(1).alias("mult"), "term", "tf"), sizes, ["_c"], [doc]).select(
        doc, "term", "weight")


def described(frame: DataFrame) -> DataFrame:
    """Distinct descriptions per run with multiplicity, first row and its address.

    The big aggregation keeps numbers only, so Spark hashes it; the address is a key of it and is
    chosen among the few per description afterwards.
    """
    at = F.expr(f"CAST(part AS DECIMAL(8, 0)) * CAST(1E27 AS DECIMAL(28, 0)) + ({carry.LOG_NUMBER})")
    few = frame.groupBy("test_id", "descr", "address").agg(F.count("*").alias("n"), F.min(at).alias("at"))
    return few.groupBy("test_id", "descr").agg(
        F.sum("n").alias("mult"), F.min("at").alias("first_at"), F.min_by("address", "at").alias("address"))


def term_scores(descriptions: DataFrame, k: int = TOP_TERMS) -> DataFrame:
    """Top terms per run by summed weight over its rows (test_id, term, score, rank)."""
    tokens = word_tokens(F.col("descr"), stop_words(descriptions.sparkSession))
    counted = (grams(descriptions, ["test_id", "descr", "mult"], tokens)
               .groupBy("test_id", "descr", "mult", "term").agg(F.count("*").alias("tf")))
    vocab = vocabulary(counted.withColumn("n", F.col("mult") * F.col("tf")), ["test_id"], RUN_VOCABULARY)
    kept = carry.salted_join(counted, vocab.select("test_id", "term"), ["test_id", "term"], ["descr"])
    sizes = descriptions.groupBy("test_id").agg(F.sum("mult").alias("n_docs"))
    weights = tfidf(kept, sizes, ["test_id"], ["descr"])
    scores = weights.groupBy("test_id", "term").agg(F.sum(F.col("mult") * F.col("weight")).alias("score"))
    # Scores equal up to summation noise are ties, which the term decides.
    return carry.at_most(scores, ["test_id"], [F.desc(F.round("score", 9)), F.asc("term")], k)


def important_registers(descriptions: DataFrame, terms: DataFrame, k: int | None = None) -> DataFrame:
    """The best term each description contains (case-sensitively), best registers first.

    A run's at most ``TOP_TERMS`` terms travel as one array to its descriptions.
    """
    listed = terms.groupBy("test_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "term", "score"))).alias("_terms"))
    hit = F.filter("_terms", lambda t: F.contains(F.col("descr"), t["term"]))
    found = (carry.salted_join(descriptions, listed, ["test_id"], ["descr"])
             .withColumn("_hit", F.try_element_at(hit, F.lit(1))).where("_hit is not null")
             .select("test_id", "descr", F.col("_hit.term").alias("term"), F.col("_hit.score").alias("score"),
                     F.col("_hit.rank").alias("term_rank"), "first_at", "address"))
    if k is None:
        return found
    return carry.at_most(found, ["test_id"], [F.asc("term_rank"), F.asc("first_at")], k)


def top_registers(frame: DataFrame, k: int | None = TOP_REGISTERS) -> DataFrame:
    descriptions = described(frame)
    return important_registers(descriptions, term_scores(descriptions), k)
