"""Subject areas of documents: a latent space, seed centroids and their refinement.

Texts become bags of words once. Words are weighted by their rarity within the text's language and projected on the leading right singular
vectors of the document-term matrix, found by subspace iteration: each pass multiplies all documents with a thin matrix and adds up thin
matrices. Seed centroids are the means of rated documents by subject and language. They are refined in rounds: every document goes to its
nearest centroid, the sure ones make the new centroids. From the sure documents each word's concentration on subjects gives a second
weighting, in which general words count nothing, with its own singular vectors; the documents sure in the first space seed its centroids and its own
sure documents refine them. A document has the subjects whose cosine in that space is above a threshold, at most two, if it has enough evidence.

Counts, weights, vectors and centroids come from all documents. To the driver go sums whose size is given by parameters: vocabulary, dimensions, subjects
and languages. The rated sample used for seeds is bounded by ``RATED`` documents, those first in the order of a hash.

Defined cases: null, empty and blanked texts, redirects and texts without words of the vocabulary have no subject. Spelt-out entities, letter case, accents, wrongly
decoded UTF-8 and markup don't matter. A missing or wrong language doesn't either: it is told by the words. Languages beyond the ``LANGUAGES`` most frequent, or of
fewer than ``LANGUAGE_DOCUMENTS`` documents, share one class. In scripts without blanks, pairs of characters are words. Texts of any length count whole.
Without rated documents nothing is assigned.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.session import ship, written

#: Most words of a language; the share of all documents, or of a language's, that has to contain one (and the least number).
VOCABULARY, LEAST_SHARE, LANGUAGE_WORDS, LEAST_DOCUMENTS = 6000, 0.0008, 0.01, 4
#: Languages with a class of their own, and the documents one needs; the class of the others.
LANGUAGES, LANGUAGE_DOCUMENTS, REST = 31, 30, "rest"
#: Singular vectors of the first space (the second has one for each subject and language); passes of subspace iteration and rounds of refinement in either.
DIMENSIONS, PASSES, ROUNDS = 64, 3, 3
PASSES_SECOND, ROUNDS_SECOND = 2, 1
#: Rated documents used for seeds.
RATED = 20_000
#: Cosine above which a subject is one; evidence (weighted occurrences) below which there is none; least concentration of a word on subjects.
COSINE, EVIDENCE, CONCENTRATION = 0.40, 2.0, 0.35
#: Sums that one task adds up.
FAN_IN = 32

_WORD = re.compile(r"[^\W\d_]{3,}")
#: Scripts written without blanks: Chinese, Japanese, Thai, Lao, Khmer, Burmese.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]+")
_REDIRECT = re.compile(r"\s*#\s*(?:redirect|weiterleitung|redirecci[oó]n)", re.IGNORECASE)
_WRONG = re.compile("[ÃÂ][\x80-\xffŒ-™]|â€")


def words(text: str) -> list[str]:
    """The words of a text, in one letter case and without accents."""
    pairs: list[str] = []
    if not text.isascii():
        if _WRONG.search(text):
            text = re.sub(r"[\x80-\xffŒ-™]+", _decoded, text)
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not "\u0300" <= c <= "\u036f")
        if _UNSPACED.search(text):
            pairs = [run[i : i + 2] for run in _UNSPACED.findall(text) for i in range(max(len(run) - 1, 1))]
            text = _UNSPACED.sub(" ", text)
    return _WORD.findall(text.lower()) + pairs


def _decoded(m: re.Match) -> str:
    """Characters that are UTF-8 read as a one-byte code, read rightly; others as they are."""
    try:
        return b"".join(bytes((ord(c),)) if c <= "\xff" else c.encode("cp1252") for c in m[0]).decode()
    except UnicodeError:
        return m[0]


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, lang, text) to (doc_id, lang, terms, counts), terms being 32-bit hashes of words."""
    codes: dict[str, int] = {}
    for b in batches:
        terms, counts = [], []
        for text in b.column(2).to_pylist():
            bag = Counter() if not text or _REDIRECT.match(text) else Counter(words(text))
            for w in bag:
                if w not in codes:
                    if len(codes) > 2_000_000:
                        codes.clear()
                    codes[w] = zlib.crc32(w.encode()) - 2**31
            terms.append([codes[w] if w in codes else zlib.crc32(w.encode()) - 2**31 for w in bag])
            counts.append(list(bag.values()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["doc_id", "lang", "terms", "counts"])


@dataclass(frozen=True)
class Space:
    """A latent space and the subjects' centroids in it; arrays sized by parameters."""

    axes: np.ndarray  # (terms, dimensions)
    gist: np.ndarray | None = None  # (terms,): concentration on subjects; in the first space words weigh by their rarity
    middle: np.ndarray | None = None  # (languages, dimensions): mean of a language's texts
    centroids: np.ndarray | None = None  # (centroids, dimensions)
    owner: np.ndarray | None = None  # subject of each centroid


@dataclass(frozen=True)
class Model:
    """What the passes know."""

    rarity: np.ndarray  # (terms, languages): weight of a word in a text of the language
    balance: np.ndarray | None = None  # (languages,): weight of a text in the singular vectors, so that rarer languages have their own
    first: Space | None = None
    second: Space | None = None


class _Rows:
    """Sparse rows of one batch; products with thin matrices go through the columns that the batch has."""

    def __init__(self, ids: np.ndarray, language: np.ndarray, idx: np.ndarray, count: np.ndarray, starts: np.ndarray):
        self.ids, self.language, self.idx, self.count = ids, language, idx, count
        self.row = np.repeat(np.arange(len(ids)), np.diff(np.append(starts, len(idx))))
        flags = np.zeros(int(idx.max()) + 1 if len(idx) else 0, bool)
        flags[idx] = True
        self.columns = np.flatnonzero(flags)
        self.place = (np.cumsum(flags) - 1)[idx]

    def by_row(self, x: np.ndarray) -> np.ndarray:
        """Sums of entries by row; rows without entries are 0."""
        return np.bincount(self.row, x, len(self.ids)).astype(np.float32)

    def dense(self, value: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.ids), len(self.columns)), np.float32)
        out[self.row, self.place] = value
        return out

    def weighed(self, m: Model, space: Space | None) -> tuple[np.ndarray, np.ndarray]:
        """(unit rows, evidence): logarithms of counts by the words' weights, and the weighted occurrences."""
        gist = None if space is None else space.gist
        weight = m.rarity[self.idx, self.language[self.row]] if gist is None else gist[self.idx]
        value = (np.log1p(self.count) * weight).astype(np.float32)
        norm = np.sqrt(self.by_row(value**2))
        return self.dense(value / np.maximum(norm, 1e-9)[self.row]), self.by_row(self.count * (weight > 0 if gist is None else weight))

    def back(self, x: np.ndarray, y: np.ndarray, terms: int) -> np.ndarray:
        """Transposed product: sums over rows by term."""
        out = np.zeros((terms, y.shape[1]))
        out[self.columns] = x.T @ y.astype(np.float32)
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def _batches(batches: Iterator[pa.RecordBatch], size: int = 1024) -> Iterator[_Rows]:
    for whole in batches:
        for at in range(0, whole.num_rows, size):
            b = whole.slice(at, size)
            idx, count = b.column(2), b.column(3)
            offsets = idx.offsets.to_numpy()
            yield _Rows(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(), idx.flatten().to_numpy(), count.flatten().to_numpy(), (offsets[:-1] - offsets[0]).astype(np.int64))


def _summed(compact: DataFrame, model: Model, work: Callable[[_Rows, Model], tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Adds up arrays over all documents: per partition, then in a tree whose depth follows the partitions, last on the driver. Their sizes don't depend on the data."""
    shared = compact.sparkSession.sparkContext.broadcast(model)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for rows in _batches(batches):
            got = work(rows, shared.value)
            total = got if total is None else tuple(a + b for a, b in zip(total, got))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in b.column(0).to_pylist():
                got = pickle.loads(x)
                total = got if total is None else tuple(a + c for a, c in zip(total, got))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["sums"])

    sums = compact.select("doc_id", "language", "idx", "counts").mapInArrow(partial, "sums binary")
    parts = compact.rdd.getNumPartitions()
    while parts > 2 * FAN_IN:
        parts = -(-parts // FAN_IN)
        sums = sums.repartition(parts).mapInArrow(add, "sums binary")
    total = None
    for r in sums.toLocalIterator():
        got = pickle.loads(bytes(r[0]))
        total = got if total is None else tuple(a + b for a, b in zip(total, got))
    shared.unpersist()
    return total


def _axes(compact: DataFrame, model: Model, space: Space, passes: int) -> Space:
    """The leading right singular vectors of the weighted document-term matrix, by subspace iteration from the space's axes."""
    terms = len(model.rarity)

    def work(r: _Rows, m: Model):
        x, _ = r.weighed(m, m.second)
        return (r.back(x, (x @ m.second.axes[r.columns]) * m.balance[r.language][:, None], terms),)

    for _ in range(passes):
        (z,) = _summed(compact, replace(model, second=space), work)
        space = replace(space, axes=np.linalg.qr(z)[0].astype(np.float32))
    return space


def _embedded(r: _Rows, m: Model, space: Space) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit rows, embeddings, evidence): texts in the space, as unit vectors, without what all texts of the language share."""
    x, evidence = r.weighed(m, space)
    e = x @ space.axes[r.columns]
    return x, _unit(e if space.middle is None else e - space.middle[r.language] * (evidence > 0)[:, None]), evidence


def _nearest(e: np.ndarray, space: Space, subjects: int) -> np.ndarray:
    """The cosine with the nearest centroid of each subject."""
    near = e @ space.centroids.T
    best = np.full((len(e), subjects), -1.0, np.float32)
    for s in range(subjects):
        mine = near[:, space.owner == s]
        if mine.shape[1]:
            best[:, s] = mine.max(1)
    return best


def _sure(best: np.ndarray, evidence: np.ndarray, least: float, margin: float, floor: float) -> np.ndarray:
    top = np.sort(best, 1)
    second = top[:, -2] if best.shape[1] > 1 else -1.0
    return (top[:, -1] > floor) & (top[:, -1] - second > margin) & (evidence >= least)


#: Least evidence, margin over the second subject and cosine of sure documents, in the first space and in the second.
SURE_FIRST, SURE_SECOND = (3.0, 0.1, 0.25), (2.0, 0.25, 0.5)


def fit(compact: DataFrame, seeds: dict[int, int], rarity: np.ndarray, subjects: int) -> Model:
    terms, languages = rarity.shape
    k = subjects * languages
    model = Model(rarity)
    of_language = lambda r: np.eye(languages, dtype=np.float32)[r.language]

    def languages_sums(r: _Rows, m: Model):
        x, evidence = r.weighed(m, None)
        told = of_language(r) * (evidence > 0)[:, None]
        return r.back(x, told, terms), told.sum(0, dtype=float)

    by_language, told = _summed(compact, model, languages_sums)
    model = replace(model, balance=(told.max(initial=1.0) / np.maximum(told, 1.0)).astype(np.float32))
    # embeddings are linear in the rows, so the middles of all passes come from one sum
    middle = lambda axes: (by_language.T @ axes / np.maximum(told, 1.0)[:, None]).astype(np.float32)
    start = np.linalg.qr(np.random.default_rng(11).standard_normal((terms, min(DIMENSIONS, terms))))[0].astype(np.float32)
    first = _axes(compact, model, Space(start), PASSES)
    first = replace(first, middle=middle(first.axes))
    seed_ids = np.array(sorted(seeds), np.int64)
    seed_of = np.array([seeds[i] for i in seed_ids], np.int64)

    def with_centroids(space: Space, sums: np.ndarray) -> Space:
        there = np.linalg.norm(sums, axis=1) > 1e-6
        return replace(space, centroids=_unit(sums[there]).astype(np.float32), owner=np.arange(k)[there] // languages)

    def seed_sums(r: _Rows, m: Model):
        _, e, _ = _embedded(r, m, m.first)
        at = np.minimum(np.searchsorted(seed_ids, r.ids), len(seed_ids) - 1)
        hit = np.flatnonzero(seed_ids[at] == r.ids)
        out = np.zeros((k, e.shape[1]))
        np.add.at(out, seed_of[at[hit]] * languages + r.language[hit], e[hit])
        return (out,)

    def sure_sums(labels: Callable[[Model], Space], into: Callable[[Model], Space], limits: tuple[float, float, float]):
        """Sums of the documents that are sure in one space, by subject and language: embeddings in another, documents of each term, documents."""

        def work(r: _Rows, m: Model):
            space, other = labels(m), into(m)
            x, e, evidence = _embedded(r, m, space)
            best = _nearest(e, space, subjects)
            s = np.flatnonzero(_sure(best, evidence, *limits))
            mine = best[s].argmax(1)
            if other is not space:
                e = _embedded(r, m, other)[1]
            out, chosen = np.zeros((k, e.shape[1])), np.zeros((len(e), subjects), np.float32)
            np.add.at(out, mine * languages + r.language[s], e[s])
            chosen[s, mine] = 1
            docs = r.back((r.dense(np.ones(len(r.idx), np.float32))), chosen, terms)
            return out, docs, np.bincount(mine, minlength=subjects).astype(float)

        return work

    # refined centroids stay tied to the rated documents
    anchor = _unit(_summed(compact, replace(model, first=first), seed_sums)[0])
    first = with_centroids(first, anchor)
    in_first = sure_sums(lambda m: m.first, lambda m: m.first, SURE_FIRST)
    for _ in range(ROUNDS):
        sums, docs, total = _summed(compact, replace(model, first=first), in_first)
        first = with_centroids(first, anchor + _unit(sums))
    model = replace(model, first=first)

    # words by their concentration on the subjects of the sure documents
    parts = (docs + 0.5) / np.maximum(total, 1.0)
    parts = parts / parts.sum(1, keepdims=True)
    gist = 1 + (parts * np.log(parts)).sum(1) / np.log(max(subjects, 2))
    gist = np.where(gist >= CONCENTRATION, gist, 0.0).astype(np.float32)
    by_words = np.stack([(parts.argmax(1) == s) * gist * by_language[:, l] for s in range(subjects) for l in range(languages)], 1)
    second = _axes(compact, model, Space(np.linalg.qr(by_words + 1e-6 * np.random.default_rng(12).standard_normal(by_words.shape))[0].astype(np.float32), gist), PASSES_SECOND)
    # the first space's sure documents seed the second, whose own ones refine it
    sums, docs, total = _summed(compact, replace(model, second=second), sure_sums(lambda m: m.first, lambda m: m.second, SURE_FIRST))
    second = with_centroids(second, sums)
    seeded = _unit(sums)
    for _ in range(ROUNDS_SECOND):
        sums, docs, total = _summed(compact, replace(model, second=second), sure_sums(lambda m: m.second, lambda m: m.second, SURE_SECOND))
        second = with_centroids(second, seeded + _unit(sums))
    return replace(model, first=None, second=second)


def assign(compact: DataFrame, model: Model, names: list[str]) -> DataFrame:
    """(doc_id, subject, cosine): at most two subjects of each document."""
    shared = compact.sparkSession.sparkContext.broadcast(model)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for r in _batches(batches):
            _, e, evidence = _embedded(r, m, m.second)
            best = _nearest(e, m.second, len(names))
            order = np.argsort(-best, axis=1, kind="stable")[:, :2]
            rank = np.take_along_axis(best, order, 1)
            doc, place = np.nonzero((evidence >= EVIDENCE)[:, None] & (rank >= COSINE))
            yield pa.RecordBatch.from_arrays(
                [pa.array(r.ids[doc], pa.int64()), pa.array([names[s] for s in order[doc, place]], pa.string()), pa.array(rank[doc, place], pa.float32())], names=["doc_id", "subject", "cosine"]
            )

    return compact.select("doc_id", "language", "idx", "counts").mapInArrow(rows_of, "doc_id long, subject string, cosine float")


def _vocabulary(spread: DataFrame, sizes: np.ndarray, everything: int) -> tuple[np.ndarray, np.ndarray]:
    """(terms, documents of each by language): words in a share of all documents or of a language's, of each language at most the VOCABULARY most frequent."""
    classes = [f"c{i}" for i in range(len(sizes))]
    enough = F.col("df") >= max(LEAST_DOCUMENTS, LEAST_SHARE * everything)
    for c, n in zip(classes, sizes):
        enough = enough | (F.col(c) >= max(LEAST_DOCUMENTS, LANGUAGE_WORDS * float(n)))
    kept = written(spread.filter(enough).select("term", "df", *classes))
    rows = reduce(DataFrame.unionByName, [kept.orderBy(F.desc(c), "term").limit(VOCABULARY) for c in classes]).distinct().collect()
    return np.array([r["term"] for r in rows], np.int64), np.array([[r[c] for c in classes] for r in rows], float).reshape(len(rows), len(classes))


def subject_areas(documents: DataFrame, rated: DataFrame, subjects: DataFrame) -> DataFrame:
    """(doc_id, subject, cosine). documents: doc_id, lang, text; rated: doc_id, subject, rater; subjects: a list of names, made by hand."""
    spark = documents.sparkSession
    ship(spark)
    names = [r[0] for r in subjects.select("subject").distinct().orderBy("subject").collect()]
    written_lang = F.lower(F.substring(F.trim("lang"), 1, 2))
    language = F.when(written_lang.rlike("^[a-z]{2}$") & (written_lang != "un"), written_lang)
    bags = written(documents.filter("text is not null and text <> ''").select(F.col("doc_id").cast("long"), language.alias("lang"), "text").mapInArrow(_bags, "doc_id long, lang string, terms array<int>, counts array<int>"))
    counted = bags.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # a row per two letters at most
    everything = sum(r["count"] for r in counted)
    empty = spark.createDataFrame([], "doc_id long, subject string, cosine float")
    if not everything or not names:
        return empty
    told = [r for r in counted if r["lang"] is not None]
    own = [r for r in told[:LANGUAGES] if r["count"] >= LANGUAGE_DOCUMENTS] or told[:1]
    rest = sum(r["count"] for r in told[len(own) :])
    languages = [r["lang"] for r in own] + [REST] * (rest > 0) or [REST]
    sizes = np.array([r["count"] for r in own] + [rest] * (rest > 0) or [everything], float)
    named = F.when(F.col("lang").isin(*languages), F.col("lang")).when(F.col("lang").isNotNull() | F.lit(not told), F.lit(REST))
    spread = bags.select(F.array_position(F.array(*map(F.lit, languages)), named).alias("c"), F.explode("terms").alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), *[F.count_if(F.col("c") == i + 1).alias(f"c{i}") for i in range(len(languages))]
    )
    codes, by_class = _vocabulary(spread, sizes, everything)
    if not len(codes):
        return empty
    spoken = np.log((by_class + 0.05) / (sizes + 0.1)).astype(np.float32)
    # a word's rarity in its language; words of the vocabulary that are in most texts of a language count little
    rarity = np.log((sizes + 1) / (np.minimum(by_class, sizes) + 1))
    rarity = np.where(by_class >= 2, np.maximum(rarity - 0.7, 0), 0).astype(np.float32)
    order = np.argsort(codes)
    known = spark.sparkContext.broadcast((codes[order], order, spoken))

    def compacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered, order, spoken = known.value
        for b in batches:
            flat, counts = b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy()
            at = np.minimum(np.searchsorted(ordered, flat), len(ordered) - 1)
            keep = ordered[at] == flat
            offsets = b.column(1).offsets.to_numpy() - b.column(1).offsets[0].as_py()
            upto = np.concatenate(([0], np.cumsum(keep)))[offsets].astype(np.int32)
            idx = order[at[keep]].astype(np.int32)
            row = np.repeat(np.arange(b.num_rows), np.diff(upto))
            spelt = np.stack([np.bincount(row, spoken[idx, l], b.num_rows) for l in range(spoken.shape[1])], 1).argmax(1)
            lists = [pa.ListArray.from_arrays(pa.array(upto), pa.array(x)) for x in (idx, counts[keep])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spelt.astype(np.int32)), *lists], names=["doc_id", "language", "idx", "counts"])

    compact = written(bags.select("doc_id", "terms", "counts").mapInArrow(compacted, "doc_id long, language int, idx array<int>, counts array<int>"))
    votes = rated.filter("doc_id is not null").join(F.broadcast(subjects.select("subject").distinct()), "subject").groupBy("doc_id", "subject").agg(F.countDistinct("rater").alias("n"))
    single = votes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.max("subject").alias("subject")).filter("k = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(RATED).collect()
    seeds = {r["doc_id"]: names.index(r["subject"]) for r in single}
    if not seeds:
        return empty
    return assign(compact, fit(compact, seeds, rarity, len(names)), names)
