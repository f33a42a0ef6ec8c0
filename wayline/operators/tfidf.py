"""TF-IDF weights and their truncated SVD, per domain, over whole texts.

A document's terms are counted where its row lies, so no text is ever shuffled, and texts are read once. The vocabulary comes from
summaries: each task hands on the counts of its most frequent terms and the largest count it left out, which bounds all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.operators.batches import pieces
from wayline.operators.ordered import top_n
from wayline.session import materialize

TERM = r"[\p{L}\p{N}_]{2,}"
MAX_FEATURES = 20_000
#: Entries of a vocabulary that is sent to all tasks; a larger one is joined.
SENT_TERMS = 2_000_000
#: Terms of a task's summary, as a multiple of the vocabulary's size, and distinct terms that a task counts before it hands on a summary.
SUMMARY = 16
DISTINCT = 1_000_000


def term_lists(docs: DataFrame, domain: str, doc: str, text: str = "text", stop_words: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(domain, doc, terms, tf): the distinct terms of every document and how often they stand in it. Ids are unique.

    ``limit`` cuts texts to so many characters first; without it whole texts are read.
    """
    whole = F.substring(text, 1, limit) if limit else F.col(text)
    found = docs.select(domain, doc, F.regexp_extract_all(F.lower(whole), F.lit(TERM), F.lit(0)).alias("terms"))
    stops = pa.array(sorted(stop_words or []), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            lists = batch.column(2)
            sizes = np.diff(np.asarray(lists.offsets))
            sizes[np.asarray(lists.is_null())] = 0
            coded = lists.flatten().dictionary_encode()
            words, code = coded.dictionary, np.asarray(coded.indices, np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            keep = ~np.asarray(pa.compute.is_in(words, value_set=stops))[code] if len(words) else np.zeros(0, bool)
            pair, tf = np.unique(row[keep] * max(1, len(words)) + code[keep], return_counts=True)
            at = np.concatenate([[0], np.cumsum(np.bincount(pair // max(1, len(words)), minlength=len(sizes)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(at), words.take(pa.array(pair % max(1, len(words))))), pa.ListArray.from_arrays(pa.array(at), pa.array(tf))],
                names=[domain, doc, "terms", "tf"])

    schema = T.StructType([T.StructField(c, found.schema[c].dataType) for c in (domain, doc)] + [T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("tf", T.ArrayType(T.LongType()))])
    return found.mapInArrow(run, schema)


def _summaries(lists: DataFrame, domain: str, size: int) -> DataFrame:
    """(domain, term, total, df, dropped): counts of each task's ``size`` most frequent terms by domain; the row without a term says
    the largest total and df among those left out."""
    schema = T.StructType([T.StructField(domain, lists.schema[domain].dataType), *T._parse_datatype_string("term string, total long, df long, kept_least long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, list[pa.Table]] = {}

        def merged(tables: list[pa.Table]) -> pa.Table:
            return pa.concat_tables(tables).group_by("term").aggregate([("n", "sum"), ("k", "sum")]).rename_columns(["term", "n", "k"])

        def out() -> pa.RecordBatch:
            parts = []
            for d, tables in held.items():
                whole = merged(tables).sort_by([("n", "descending"), ("term", "ascending")])
                left = whole["n"][size].as_py() if whole.num_rows > size else 0
                kept = whole.slice(0, size)
                n = kept.num_rows + 1
                parts.append(pa.table({domain: pa.array([d] * n, pa.string()), "term": pa.chunked_array([*kept["term"].chunks, pa.nulls(1, pa.string())], pa.string()), "total": pa.chunked_array([*kept["n"].chunks, pa.array([left], pa.int64())], pa.int64()),
                                       "df": pa.chunked_array([*kept["k"].chunks, pa.array([0], pa.int64())], pa.int64()), "kept_least": pa.array([left] * n, pa.int64())}))
            held.clear()
            return pa.concat_tables(parts).combine_chunks().to_batches()[0]

        for batch in pieces(batches, 1):
            tf, words = np.asarray(batch.column(2).flatten()), batch.column(1).flatten()
            sizes = np.diff(np.asarray(batch.column(1).offsets))
            coded = batch.column(0).dictionary_encode()
            of = np.asarray(coded.indices.fill_null(-1), np.int64)
            for i, d in [*enumerate(coded.dictionary.to_pylist()), (-1, None)]:
                use = np.flatnonzero(np.repeat(of == i, sizes))
                if len(use):
                    part = pa.table({"term": words.take(pa.array(use)), "n": tf[use], "k": np.ones(len(use), np.int64)})
                    held.setdefault(d, []).append(part.group_by("term").aggregate([("n", "sum"), ("k", "sum")]).rename_columns(["term", "n", "k"]))
            if sum(t.num_rows for tables in held.values() for t in tables) > DISTINCT:
                for d, tables in held.items():
                    held[d] = [merged(tables)]
                if sum(t.num_rows for (t,) in held.values()) > DISTINCT // 2:
                    yield out()
        if held:
            yield out()

    return lists.select(F.col(domain).cast("string"), "terms", "tf").mapInArrow(run, schema)


def _counted(lists: DataFrame, domain: str, max_features: int | None) -> DataFrame:
    """(domain, term, total, df) of the most frequent terms; ties go by term.

    Terms whose upper bound (their counts in the summaries, and the bound of every summary without them) reaches the last
    place's sure count are counted exactly. If a term that no summary holds could still be among them, the summaries grow.
    """
    size = SUMMARY * max_features if max_features else (1 << 62)
    exact = lists.select(domain, F.explode(F.arrays_zip("terms", "tf")).alias("x")).select(domain, F.col("x.terms").alias("term"), F.col("x.tf").alias("tf"))
    while True:
        parts = materialize(_summaries(lists, domain, size))
        unseen = parts.where("term IS NULL").groupBy(domain).agg(F.sum("total").alias("_e"))
        sums = parts.where("term IS NOT NULL").groupBy(domain, "term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"), F.sum("kept_least").alias("_k"))
        if not max_features or not unseen.where("_e > 0").limit(1).count():
            break  # nothing was left out: the sums are the counts
        place = materialize(top_n(sums, [domain], [F.desc("total"), F.col("term")], max_features, salt="term"))
        last = place.groupBy(domain).agg(F.min("total").alias("_t"), F.count(F.lit(1)).alias("_c"))
        limits = materialize(unseen.join(last, domain))
        if limits.where((F.col("_e") >= F.col("_t")) | (F.col("_c") < max_features)).where("_e > 0").limit(1).count():
            size *= 4
            continue
        may = sums.join(F.broadcast(limits), domain).where("total + _e - _k >= _t").select(domain, "term")
        sums = exact.join(may, [domain, "term"]).groupBy(domain, "term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
        break
    sums = sums.select(domain, "term", "total", "df")
    return top_n(sums, [domain], [F.desc("total"), F.col("term")], max_features, salt="term").drop("_rank") if max_features else sums


def vocabulary(lists: DataFrame, domain: str, max_features: int | None = MAX_FEATURES) -> DataFrame:
    """Most frequent terms of a domain with their smooth idf; ties go by term. ``lists``: rows of ``term_lists``, read several times."""
    n = lists.groupBy(domain).agg(F.count(F.lit(1)).alias("_n"))
    idf = F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1
    return _counted(lists, domain, max_features).join(F.broadcast(n), domain).select(domain, "term", "df", idf.alias("idf"))


def _sent(vocab: DataFrame, domain: str):
    """domain -> (terms in order, idf), for all tasks."""
    rows = vocab.select(domain, "term", "idf").orderBy(domain, "term").collect()
    held: dict[object, tuple[list, list]] = {}
    for r in rows:
        terms, idf = held.setdefault(r[0], ([], []))
        terms.append(r["term"])
        idf.append(r["idf"])
    return vocab.sparkSession.sparkContext.broadcast({d: (pa.array(t, pa.string()), np.array(i)) for d, (t, i) in held.items()})


def _weighted(batch: pa.RecordBatch, vocabularies) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """For the rows of each domain: (row of each entry, term number, weight, the domain's terms), rows of length 1."""
    lists, tf = batch.column(2), np.asarray(batch.column(3).flatten())
    sizes = np.diff(np.asarray(lists.offsets))
    row = np.repeat(np.arange(len(sizes)), sizes)
    names, words = np.array(batch.column(0).to_pylist(), object), lists.flatten()
    for d in dict.fromkeys(names.tolist()):
        if d not in vocabularies:
            continue
        terms, idf = vocabularies[d]
        use = np.flatnonzero((names == d)[row])
        at = pa.compute.index_in(words.take(pa.array(use)), value_set=terms)
        known = np.asarray(at.is_valid())
        use, at = use[known], np.asarray(at.drop_null(), np.int64)
        w = tf[use] * idf[at]
        length = np.sqrt(np.bincount(row[use], weights=w * w, minlength=len(sizes)))
        yield row[use], at, w / length[row[use]], terms


def tfidf(docs: DataFrame, domain: str, doc: str, text: str = "text", stop_words: list[str] | None = None,
          max_features: int | None = MAX_FEATURES, limit: int | None = None) -> DataFrame:
    """(domain, doc, term, weight) with L2-normalised documents.

    A vocabulary of up to SENT_TERMS entries is sent to the tasks and weights are made in the rows; a larger one is joined.
    """
    lists = materialize(term_lists(docs, domain, doc, text, stop_words, limit))
    vocab = materialize(vocabulary(lists, domain, max_features))
    if vocab.count() > SENT_TERMS:
        tf = lists.select(domain, doc, F.explode(F.arrays_zip("terms", "tf")).alias("x")).select(domain, doc, F.col("x.terms").alias("term"), F.col("x.tf").alias("tf"))
        w = tf.join(vocab, [domain, "term"]).withColumn("_w", F.col("tf") * F.col("idf"))
        norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(doc)))
        return w.select(domain, doc, "term", (F.col("_w") / norm).alias("weight"))
    sent = _sent(vocab, domain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            for row, at, weight, terms in _weighted(batch, sent.value):
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), terms.take(pa.array(at)), pa.array(weight)], names=[domain, doc, "term", "weight"])

    schema = T.StructType([*(T.StructField(c, lists.schema[c].dataType) for c in (domain, doc)), T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())])
    return lists.mapInArrow(run, schema)


#: Random directions beside the wanted ones, steps of the iteration, and the residual (as a share of the eigenvalue) that settles it.
EXTRA, STEPS, SETTLED = 10, 40, 1e-9
#: Entries of a group of rows of the sums that are exchanged.
BLOCK = 1 << 15


class SparseSVD:
    """Singular values and right vectors of every domain's rows: ``values[domain]``, ``vectors[domain]`` (terms x k), ``terms[domain]``."""

    def __init__(self, terms: dict, values: dict, vectors: dict, residuals: dict):
        self.terms, self.values, self.vectors, self.residuals = terms, values, vectors, residuals


def _gathered(rows: DataFrame) -> DataFrame:
    """The rows in two partitions a core at most, without a shuffle: every task hands on sums of the vocabulary's size, so their number must not grow with the input."""
    return rows.coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)


def _multiplied(rows: DataFrame, domain: str, blocks: dict) -> dict:
    """A'A V of every domain in one pass: rows are multiplied and added up in tasks, then by blocks of terms over all tasks."""
    sent = rows.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_direction = {d: np.ascontiguousarray(v.T) for d, v in sent.value.items()}
        held: dict[object, np.ndarray] = {}
        for batch in pieces(batches, 1):
            lists, weight = batch.column(1), np.asarray(batch.column(2).flatten())
            sizes = np.diff(np.asarray(lists.offsets))
            row, at = np.repeat(np.arange(len(sizes)), sizes), np.asarray(lists.flatten())
            names = np.array(batch.column(0).to_pylist(), object)
            for d in dict.fromkeys(names.tolist()):
                if d not in by_direction:
                    continue
                v = by_direction[d]
                use = (names == d)[row]
                r, a, w = row[use], at[use].astype(np.int64), weight[use]
                into = held.setdefault(d, np.zeros(v.shape))
                for c in range(len(v)):  # one direction at a time keeps the memory at the size of the batch
                    y = np.bincount(r, weights=w * v[c][a], minlength=len(sizes))
                    into[c] += np.bincount(a, weights=w * y[r], minlength=v.shape[1])
        for d, z in held.items():
            flat = np.ascontiguousarray(z.T).ravel()
            for at in range(0, len(flat), BLOCK):
                part = flat[at : at + BLOCK]
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.string()), pa.array([at], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.array(part))], names=["d", "at", "z"])

    summed = _gathered(rows.select(F.col(domain).cast("string"), "at", "weight")).mapInArrow(run, "d string, at long, z array<double>").groupBy("d", "at").agg(vector_to_array(Summarizer.sum(array_to_vector("z"))).alias("z"))
    out = {d: np.zeros(v.size) for d, v in blocks.items()}
    for batch in summed.toArrow().to_batches():  # terms x directions, bounded by the vocabulary
        for i, (d, at) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            z = np.asarray(batch.column(2)[i].values)
            out[d][at : at + len(z)] = z
    sent.destroy()
    return {d: z.reshape(blocks[d].shape) for d, z in out.items()}


def _orthonormal(z: np.ndarray, basis: np.ndarray | None) -> np.ndarray:
    """Directions of ``z`` that are new to ``basis``, orthonormal."""
    for _ in range(2):
        if basis is not None and basis.shape[1]:
            z = z - basis @ (basis.T @ z)
    q, r = np.linalg.qr(z)
    size = np.abs(np.diag(r))
    q = q[:, size > 1e-10 * max(1e-300, size.max(initial=0))]
    return q if basis is None else q - basis @ (basis.T @ q)


def sparse_svd(rows: DataFrame, domain: str, terms: dict, k: int = 10, seed: int = 42) -> SparseSVD:
    """The first k singular values and right vectors of every domain's sparse rows (domain, at, weight), all domains at once.

    A random block is multiplied by A'A; each product extends an orthonormal basis on the side of the terms, whose number the
    vocabulary bounds, and the wanted vectors are the best ones inside it. It ends when every residual |A'A v - s v| is
    nearly zero, or the basis holds the whole space. Signs are fixed by the largest absolute loading.
    """
    rng = np.random.default_rng(seed)
    wide = {d: min(k + EXTRA, len(t)) for d, t in terms.items()}
    block = {d: np.linalg.qr(rng.standard_normal((len(t), wide[d])))[0] for d, t in terms.items()}
    basis = {d: np.zeros((len(t), 0)) for d, t in terms.items()}
    image = {d: np.zeros((len(t), 0)) for d, t in terms.items()}
    small = {d: np.zeros((0, 0)) for d in terms}
    values, vectors, residuals = {}, {}, {}
    for _ in range(STEPS):
        open_ = {d: b for d, b in block.items() if b.shape[1]}
        if not open_:
            break
        for d, z in _multiplied(rows, domain, open_).items():
            basis[d], image[d] = np.concatenate([basis[d], block[d]], axis=1), np.concatenate([image[d], z], axis=1)
            with_new, n = basis[d].T @ z, len(small[d])
            corner = with_new[n:]
            small[d] = np.block([[small[d], with_new[:n]], [with_new[:n].T, (corner + corner.T) / 2]])
            value, y = np.linalg.eigh(small[d])
            top = np.argsort(-value)[: min(k, len(value))]
            v = basis[d] @ y[:, top]
            left = np.linalg.norm(image[d] @ y[:, top] - v * value[top], axis=0)
            values[d], vectors[d], residuals[d] = np.sqrt(np.maximum(0, value[top])), v, left
            done = (left <= SETTLED * np.maximum(value[top], 1e-300)).all() and len(top) == min(k, len(terms[d]))
            block[d] = np.zeros((len(z), 0)) if done or basis[d].shape[1] >= len(z) else _orthonormal(z, basis[d])[:, : len(z) - basis[d].shape[1]]
    for d, v in vectors.items():
        sign = np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
        vectors[d] = v * np.where(sign == 0, 1, sign)
    return SparseSVD(terms, values, vectors, residuals)


def numbered_rows(docs: DataFrame, domain: str, doc: str, text: str, stop_words: list[str] | None, max_features: int, limit: int | None = None) -> tuple[DataFrame, dict]:
    """((domain, doc, at, weight) with one sparse row per document, terms of every domain)."""
    lists = materialize(term_lists(docs, domain, doc, text, stop_words, limit))
    vocab = vocabulary(lists, domain, max_features)
    sent = _sent(vocab, domain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            n = batch.num_rows
            parts = list(_weighted(batch, sent.value))
            row = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
            order = np.argsort(row, kind="stable")
            at = np.concatenate([p[1] for p in parts])[order] if parts else np.zeros(0, np.int64)
            weight = np.concatenate([p[2] for p in parts])[order] if parts else np.zeros(0)
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(at.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(weight))], names=[domain, doc, "at", "weight"])

    schema = T.StructType([*(T.StructField(c, lists.schema[c].dataType) for c in (domain, doc)), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("weight", T.ArrayType(T.DoubleType()))])
    return materialize(lists.mapInArrow(run, schema)), {d: t.to_pylist() for d, (t, _) in sent.value.items()}


def projected(rows: DataFrame, domain: str, doc: str, svd: SparseSVD) -> DataFrame:
    """(domain, doc, vec): scores X V of every document; documents without a term score zero."""
    sent = rows.sparkSession.sparkContext.broadcast(svd.vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            lists, weight = batch.column(2), np.asarray(batch.column(3).flatten())
            sizes = np.diff(np.asarray(lists.offsets))
            row, at = np.repeat(np.arange(len(sizes)), sizes), np.asarray(lists.flatten())
            names, out = np.array(batch.column(0).to_pylist(), object), [[] for _ in sizes]
            for d in dict.fromkeys(names.tolist()):
                if d not in sent.value:
                    continue
                v, use = sent.value[d], (names == d)[row]
                scores = np.stack([np.bincount(row[use], weights=weight[use] * v[at[use], c], minlength=len(sizes)) for c in range(v.shape[1])], axis=1)
                for i in np.flatnonzero(names == d).tolist():
                    out[i] = scores[i].tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float64()))], names=[domain, doc, "vec"])

    schema = T.StructType([*(T.StructField(c, rows.schema[c].dataType) for c in (domain, doc)), T.StructField("vec", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(run, schema)


def truncated_svd(weights: DataFrame, doc: str, k: int = 10, max_features: int = MAX_FEATURES) -> tuple[DataFrame, list[float], DataFrame]:
    """Scores X V of the first k right singular vectors of one matrix given as (doc, term, weight), without centring.

    Returns (scores, singular values, components). The term side holds at most ``max_features`` rows (checked).
    """
    spark = weights.sparkSession
    terms = [r["term"] for r in weights.select("term").distinct().orderBy("term").limit(max_features + 1).collect()]
    if len(terms) > max_features:
        raise ValueError(f"more than {max_features} terms; build the weights with max_features")
    index = spark.createDataFrame(list(enumerate(terms)), "j int, term string")
    rows = weights.join(F.broadcast(index), "term").groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("j", "weight"))).alias("_v"))
    rows = materialize(rows.select(F.lit("").alias("_domain"), doc, F.col("_v.j").alias("at"), F.col("_v.weight").alias("weight")))
    svd = sparse_svd(rows, "_domain", {"": terms}, k)
    comps = spark.createDataFrame([(t, [float(x) for x in svd.vectors[""][i]]) for i, t in enumerate(terms)], "term string, loading array<double>")
    return projected(rows, "_domain", doc, svd).drop("_domain"), [float(s) for s in svd.values[""]], comps


def domain_vectors(docs: DataFrame, domain: str, doc: str, k: int = 10, text: str = "text",
                   stop_words: list[str] | None = None, max_features: int = MAX_FEATURES, limit: int | None = None) -> DataFrame:
    """(domain, doc, vec): k-dimensional TF-IDF vectors of every domain, all domains in the same passes; ``limit`` as in ``term_lists``."""
    rows, terms = numbered_rows(docs, domain, doc, text, stop_words, max_features, limit)
    return projected(rows, domain, doc, sparse_svd(rows, domain, terms, k))
