"""Language identification by unigram pieces, summed over all segmentations.

Every language has one probability per piece of a fixed public vocabulary, learned by expectation
maximisation from a bounded sample of its documents.  A word's probability under a language is
the sum over all ways to cut it into pieces (forward algorithm), a text's the product over its
words.  Words are runs of letters, lower-cased; as the vocabulary's pieces never span words,
each distinct word is scored once per worker and slice, for all languages at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelathe.llm.common import by_bytes, plain, small_batches, texts_of

LETTERS = re.compile(r"[^\W\d_]+")
MARK = "▁"  # fixed value: begins a word in the vocabulary
UNKNOWN = 1e-8  # of a character that no piece holds, in every language
_PIECES: dict = {}


def words(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def vocabulary(path: str) -> dict[str, int]:
    """Pieces of letters, with or without the word mark, numbered; loaded once per worker."""
    if path not in _PIECES:
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())
                 if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        names = [n for n in names if n == MARK or n.removeprefix(MARK).isalpha()]
        _PIECES[path] = {n: i for i, n in enumerate(names)}
    return _PIECES[path]


class Lattice:
    """Words of one length and the pieces that may stand at each of their places."""

    def __init__(self, strings: list[str], pieces: dict[str, int], longest: int):
        self.n, none, unknown = len(strings[0]), len(pieces) + 1, len(pieces)
        self.spans = [(i, j) for j in range(1, self.n + 1) for i in range(max(0, j - longest), j)]
        get = pieces.get
        flat = [get(s[i:j], unknown if j - i == 1 else none) for s in strings for i, j in self.spans]
        self.ids = np.array(flat, np.int32).reshape(len(strings), len(self.spans))

    def forward(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled alphas [place, word, language], the edges' probabilities, and the log-probabilities."""
        languages = table.shape[1]
        alpha = np.zeros((self.n + 1, len(self.ids), languages))
        alpha[0] = 1.0
        log, edges = np.zeros((len(self.ids), languages)), []
        for k, (i, j) in enumerate(self.spans):
            p = table[self.ids[:, k]]
            edges.append(p)
            alpha[j] += alpha[i] * p
            if i == j - 1 and j % 16 == 0:  # all edges into j are in: rescale what later places need
                scale = np.maximum(alpha[max(0, j - 24):j + 1].max(axis=0), 1e-300)
                alpha[max(0, j - 24):j + 1] /= scale
                log += np.log(scale)
        return alpha, edges, log + np.log(np.maximum(alpha[self.n], 1e-300))


def lattices(strings: list[str], pieces: dict[str, int], rows: int = 20_000) -> Iterator[tuple[list[int], Lattice]]:
    longest = min(20, max(map(len, pieces), default=1))  # the longest piece of letters has fewer than 20
    by_length: dict[int, list[int]] = {}
    for k, s in enumerate(strings):
        by_length.setdefault(len(s), []).append(k)
    for size, members in by_length.items():
        step = max(1, min(rows, rows * 10 // (size * longest)))
        for a in range(0, len(members), step):
            part = members[a:a + step]
            yield part, Lattice([strings[k] for k in part], pieces, longest)


def log_probabilities(strings: list[str], pieces: dict[str, int], table: np.ndarray) -> np.ndarray:
    """[word, language]; ``table`` has a row per piece, then the unknown character, then 0."""
    out = np.zeros((len(strings), table.shape[1]))
    for part, lattice in lattices([MARK + s for s in strings], pieces):
        out[part] = lattice.forward(table)[2]
    return out


def with_ends(p: np.ndarray) -> np.ndarray:
    """Adds the rows of the unknown character and of no piece."""
    return np.concatenate([p, np.full((1, p.shape[1]), UNKNOWN), np.zeros((1, p.shape[1]))])


def learn_pieces(strings: list[str], counts: np.ndarray, pieces: dict[str, int], rounds: int = 3, prior: float = 0.01) -> np.ndarray:
    """Piece probabilities of one language by expectation maximisation over words and their counts.
    Words of more than 40 letters are cut into stretches of 40; only the first begins a word."""
    cuts = [(k, a) for k, s in enumerate(strings) for a in range(0, len(s), 40)]
    counts = np.asarray(counts, float)[[k for k, _ in cuts]]
    strings = [("" if a else MARK) + strings[k][a:a + 40] for k, a in cuts]
    built = list(lattices(strings, pieces))
    p = np.full((len(pieces), 1), 1.0 / max(1, len(pieces)))
    for _ in range(rounds):
        table, expected = with_ends(p), np.zeros(len(pieces) + 2)
        for part, lattice in built:
            n, spans = lattice.n, lattice.spans
            probability = [table[lattice.ids[:, k], 0] for k in range(len(spans))]
            alpha, beta = np.zeros((n + 1, len(part))), np.zeros((n + 1, len(part)))
            alpha[0], beta[n] = 1.0, 1.0
            for k, (i, j) in enumerate(spans):
                alpha[j] += alpha[i] * probability[k]
            for k in range(len(spans) - 1, -1, -1):
                i, j = spans[k]
                beta[i] += beta[j] * probability[k]
            weight = counts[part] / np.maximum(alpha[n], 1e-300)
            for k, (i, j) in enumerate(spans):
                np.add.at(expected, lattice.ids[:, k], alpha[i] * beta[j] * probability[k] * weight)
        p = expected[:len(pieces), None] + prior
        p /= p.sum()
    return p[:, 0]


def learn(df: DataFrame, path: str, lang: str = "lang", text: str = "text", per_language: int = 250) -> tuple[list[str], np.ndarray]:
    """Languages and their piece table from ``df``, each from the ``per_language`` rows of the least text hash.

    The sample is the only bound: rows with a null language are left out, all others may be drawn."""
    from pyspark.sql import Window

    rows = df.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    # First the least hashes of every slice of a language, so that no task ranks a whole one.
    keyed = rows.select("lang", F.xxhash64("text").alias("hash")).distinct()
    slices = Window.partitionBy("lang", F.pmod("hash", F.lit(64))).orderBy("hash")
    few = keyed.withColumn("k", F.row_number().over(slices)).filter(F.col("k") <= per_language)
    few = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("hash"))).filter(F.col("k") <= per_language)
    few = F.broadcast(few.select("lang", "hash"))  # per_language rows per language
    sample = (rows.withColumn("hash", F.xxhash64("text")).join(few, ["lang", "hash"]).dropDuplicates(["lang", "hash"]))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tall = batch.assign(word=[words(t or "") for t in batch["text"]])[["lang", "word"]].explode("word").dropna()
            yield tall.groupby(["lang", "word"], as_index=False).size().rename(columns={"size": "n"})

    counts = sample.select("lang", "text").mapInPandas(counted, "lang string, word string, n long")
    counts = counts.groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("word")
        p = learn_pieces(group["word"].tolist(), group["n"].to_numpy(), vocabulary(path))
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "p": [p.astype("<f4").tobytes()]})

    learned = sorted(counts.groupBy("lang").applyInPandas(fit, "lang string, p binary").collect())
    table = np.stack([np.frombuffer(r["p"], "<f4") for r in learned], axis=1).astype(float) if learned else np.zeros((0, 0))
    return [r["lang"] for r in learned], table


class WordScores:
    """Scores of words seen so far, at most about ``limit`` between slices."""

    def __init__(self, path: str, table: np.ndarray, limit: int = 250_000):
        self.pieces, self.table, self.limit = vocabulary(path), with_ends(table), limit
        self.known: dict[str, int] = {}
        self.scores = np.zeros((1 << 16, table.shape[1]))

    def ready(self, units: list[str]) -> None:
        if len(self.known) > self.limit:
            self.known.clear()
        new = [u for u in set(units) if u not in self.known]
        if not new:
            return
        base = len(self.known)
        while base + len(new) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.scores[base:base + len(new)] = log_probabilities(new, self.pieces, self.table)
        self.known.update(zip(new, range(base, base + len(new))))

    def total(self, units: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
        return self.scores[at].sum(axis=0)


def predict(text: Column, path: str, languages: list[str], table: np.ndarray, slice_bytes: int = 1 << 21) -> Column:
    """STRUCT<lang_pred STRING, score DOUBLE>: the likeliest language and its posterior under equal
    priors; ('und', 0) where the text is null or has no letter, or nothing was learned."""
    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def best(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scores = WordScores(path, table) if languages else None
        for batch in batches:
            names, values = [], []
            for part in by_bytes(batch, slice_bytes):
                units = [words(t) for t in texts_of(part)]
                if scores:
                    scores.ready([u for us in units for u in us])
                for us in units:
                    if not us or not scores:
                        names.append("und")
                        values.append(0.0)
                        continue
                    total = scores.total(us)
                    total = np.exp(total - total.max())
                    k = int(total.argmax())
                    names.append(languages[k])
                    values.append(float(total[k] / total.sum()))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.float64())], ["lang_pred", "score"])

    return best(text)


def with_language(df: DataFrame, training: DataFrame, path: str, text: str = "text", lang: str = "lang", per_language: int = 250) -> DataFrame:
    """``df`` with lang_pred and score, learned from ``training`` (text, lang).  Every row is kept;
    an empty table gives an empty table; input columns named as the new ones give way."""
    languages, table = learn(small_batches(training), path, lang, text, per_language)
    df = plain(df, "lang_pred", "score")
    return df.withColumn("__best", predict(F.col(text), path, languages, table)).select(*df.columns, "__best.lang_pred", "__best.score")
