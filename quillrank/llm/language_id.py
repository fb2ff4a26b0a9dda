"""Language identification by Bayesian evidence fusion.

The likelihood of the text under byte-trigram models of the languages is combined with the declared language,
the address suffix and a prior of the host. Likelihoods of declarations and suffixes, and the priors, are counted
over all documents; the prior of a host is smoothed towards its domain, and that towards the whole corpus.
Text that no model fits is a hypothesis of its own: it is in a language other than those.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..sizing import lookup_join
from .registry import bounded_batches, unused
from .words import Words, slices

#: Distinct texts of each declared language that its model is fitted on, about; all if there are fewer.
FIT_ROWS = 1_000
#: Stands for the language of text that no model fits and that declares none.
UNKNOWN = "unknown"
#: Trigrams are counted in so many cells.
CELLS = 1 << 15
#: Share of a uniform model in each text model; a trigram that was never seen costs its logarithm.
UNIFORM = 0.5
#: Weight of the level above in the prior of a host or domain, in documents.
PRIOR_WEIGHT = 8.0
#: Neighbouring trigrams overlap, so each counts as a third of an observation.
OVERLAP = 1 / 3

_SYMBOL = np.full(256, 32, np.uint8)
_SYMBOL[97:123] = np.arange(97, 123)
_SYMBOL[65:91] = np.arange(97, 123)
_SYMBOL[128:] = np.arange(128, 256)


class Model(NamedTuple):
    languages: list[str]
    table: np.ndarray  # log probability of each cell, a column per language


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the trigrams of all texts, one after the other, and where each text begins.

    Letters are lower-cased, bytes above ASCII count as letters, all else as a space. A trigram has a letter
    in its middle, so a text without letters has none.
    """
    words = Words(column)
    s = np.concatenate([[np.uint8(32)], _SYMBOL[words.data], [np.uint8(32)]]).astype(np.uint32)
    at = np.flatnonzero(s[1:-1] != 32)
    code = (s[at] << np.uint32(16)) | (s[at + 1] << np.uint32(8)) | s[at + 2]
    cell = (code * np.uint32(0x9E3779B1)) >> np.uint32(17)
    return cell, np.searchsorted(at, words.text_start)


def fit(docs: DataFrame) -> Model:
    """Trigram models of all languages that ``(text, declared)`` has, from a bounded sample of each; Spark sums the counts.

    Languages are counted over all rows, so a rare one is learnt from what there is of it.
    """
    rows = docs.where("declared IS NOT NULL").select("declared", "text", F.xxhash64("text", F.lit(3)).alias("print"))
    texts = rows.groupBy("declared").agg(F.approx_count_distinct("print").alias("texts"))
    texts = materialize(texts.select("declared", F.greatest(F.lit(1), F.floor(F.col("texts") / FIT_ROWS)).alias("every")), "languages")
    names = sorted(r[0] for r in texts.select("declared").collect())
    place = {name: i for i, name in enumerate(names)}
    sample = lookup_join(rows, texts, "declared", spread_on="print").where(F.pmod("print", "every") == 0)
    sample = materialize(sample.select("text", "declared").distinct(), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                cell, edge = trigrams(part.column("text"))
                language = np.repeat([place[x] for x in part.column("declared").to_pylist()], np.diff(edge)).astype(np.int64)
                both, n = np.unique(language * CELLS + cell, return_counts=True)
                yield pa.RecordBatch.from_pydict({"language": pa.array(both // CELLS, pa.int32()), "cell": pa.array(both % CELLS, pa.int32()), "n": pa.array(n, pa.int64())})

    counts = np.zeros((CELLS, len(names)))
    found = sample.mapInArrow(count, "language int, cell int, n long").groupBy("language", "cell").agg(F.sum("n").alias("n")).toPandas()
    counts[found["cell"], found["language"]] += found["n"]
    share = counts / np.maximum(counts.sum(axis=0), 1)
    return Model(names, np.log((1 - UNIFORM) * share + UNIFORM / CELLS))


def _smoothed(counts: np.ndarray, above: np.ndarray) -> np.ndarray:
    return (counts + PRIOR_WEIGHT * above) / (counts.sum(axis=1, keepdims=True) + PRIOR_WEIGHT)


def _counts(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``(key, name)``: how many documents of a key each language has that it has any of, judged by the text alone."""
    each = rows.where(F.col(key).isNotNull() & (F.col("best") >= 0)).groupBy(key, "best").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(key).agg(F.collect_list(F.struct("best", "n")).alias(name))


def _total(rows: DataFrame, languages: int) -> np.ndarray:
    out = np.zeros(languages)
    for r in rows.where("best >= 0").groupBy("best").count().collect():
        out[r[0]] = r[1]
    return out


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: Column | None = None,
    declared: Column | None = None,
    host: Column | None = None,
    suffix: Column | None = None,
    model: Model | None = None,
    unknown: bool = False,
    key: Column | None = None,
) -> DataFrame:
    """``(doc_id, key, lang, posterior, accepted)``, one row per row of ``docs``.

    ``declared``, ``host`` and ``suffix`` are columns with the further evidence; a null value adds nothing. A
    declaration is read up to the first hyphen, in lower case. The domain of a host is its last two labels.

    ``lang`` is the language of the highest posterior. Text that every language fits worse than a uniform model does
    can be in another language: that is one more hypothesis, with priors and likelihoods like the others. Where it
    wins, ``lang`` is the declared language or else, if ``unknown`` is set, UNKNOWN. A document is rejected, with a null
    language, if its text has no letters (null, empty, digits only) or, unless ``unknown`` is set, if that
    hypothesis wins and nothing is declared. Repeated rows and null ids are documents like others; ``key`` is a hash
    of id and text unless it is given. Ties go to the first language in alphabetical order. Without any declared language nothing can be
    learnt, and no language is known.
    """
    return _identified(docs, id_col, text, declared, host, suffix, model, unknown, key).drop("declared")


def _code(declared: Column) -> Column:
    """A declaration up to the first hyphen, in lower case."""
    return F.nullif(F.lower(F.trim(F.split_part(declared, F.lit("-"), F.lit(1)))), F.lit(""))


def _identified(
    docs: DataFrame, id_col: str, text: Column | None, declared: Column | None, host: Column | None, suffix: Column | None,
    model: Model | None, unknown: bool, key: Column | None,
) -> DataFrame:
    """``identify`` with the declaration as it is read."""
    none = F.lit(None).cast("string")
    text = F.col("text") if text is None else text
    code = _code(F.col("lang") if declared is None else declared)
    host = F.col("source") if host is None else host
    rows = bounded_batches(docs).select(
        F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), code.alias("declared"), host.alias("host"),
        (none if suffix is None else suffix).alias("suffix"), (F.xxhash64(F.col(id_col).cast("string"), text) if key is None else key).alias("key"),
    )
    model = model or fit(rows)
    n = len(model.languages)
    sent = docs.sparkSession.sparkContext.broadcast(model.table)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            for part in slices(batch):
                cell, edge = trigrams(part.column("text"))
                count = np.diff(edge)
                total = np.zeros((part.num_rows, n + 1))
                total[:, n] = -count * np.log(CELLS)
                some = np.flatnonzero(count)
                for i in range(n if len(some) else 0):
                    total[some, i] = np.add.reduceat(table[cell, i], edge[some])
                best = np.where(count > 0, total.argmax(axis=1), -1)
                for row in np.flatnonzero(best == n):  # bytes above ASCII may be signs
                    if not any(map(str.isalpha, part.column("text")[int(row)].as_py())):
                        best[row] = -1
                columns = [part.column(c) for c in ("doc_id", "key", "declared", "host", "suffix")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(best, pa.int32()), pa.array(list(total * OVERLAP), pa.list_(pa.float64()))], ["doc_id", "key", "declared", "host", "suffix", "best", "text_evidence"])

    schema = "doc_id long, key long, declared string, host string, suffix string, best int, text_evidence array<double>"
    scored = rows.mapInArrow(score, schema).withColumn("domain", F.regexp_extract("host", r"([^.]*\.)?[^.]*$", 0))
    scored = materialize(scored, "evidence")
    overall = _total(scored, n + 1) + 1.0
    overall = overall / overall.sum()
    joined = scored
    for key in ("host", "domain", "declared", "suffix"):
        joined = lookup_join(joined, materialize(_counts(scored, key, f"{key}_counts"), "counts"), key, "left", spread_on="key")
    per_language = {c: _total(scored.where(f"{c} IS NOT NULL"), n + 1) for c in ("declared", "suffix")}
    distinct = {c: scored.select(c).distinct().count() + 1 for c in ("declared", "suffix")}
    names, other = model.languages, UNKNOWN if unknown else None

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            best = batch.column("best").to_numpy()
            own = (best[:, None] == np.arange(n + 1)).astype(float)

            def seen(name: str) -> tuple[np.ndarray, np.ndarray]:
                column = batch.column(f"{name}_counts")
                counts = np.zeros((batch.num_rows, n + 1))
                for row, found in enumerate(column.to_pylist()):
                    for x in found or []:
                        counts[row, x["best"]] = x["n"]
                return np.array(column.is_valid())[:, None], counts

            # A document is no evidence for itself, so it is taken off the counts it is part of.
            _, domain = seen("domain")
            _, host = seen("host")
            prior = _smoothed(np.maximum(host - own, 0), _smoothed(np.maximum(domain - own, 0), overall))
            evidence = np.array(batch.column("text_evidence").to_pylist(), float).reshape(-1, n + 1) + np.log(prior)
            for name in ("declared", "suffix"):
                known, counts = seen(name)
                likelihood = (np.maximum(counts - own, 0) + 0.5) / (np.maximum(per_language[name] - own, 0) + 0.5 * distinct[name])
                evidence += np.where(known, np.log(likelihood), 0.0)
            evidence -= evidence.max(axis=1, keepdims=True)
            posterior = np.exp(evidence) / np.exp(evidence).sum(axis=1, keepdims=True)
            lang = [None if b < 0 else names[w] if w < n else d or other for w, b, d in zip(posterior.argmax(axis=1), best, batch.column("declared").to_pylist())]
            ok = np.array([x is not None for x in lang])
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "key": batch.column("key"), "lang": pa.array(lang, pa.string()),
                "posterior": pa.array(np.where(ok, posterior.max(axis=1), 0.0)), "accepted": pa.array(ok), "declared": batch.column("declared"),
            })

    return joined.mapInArrow(fuse, "doc_id long, key long, lang string, posterior double, accepted boolean, declared string")


def drop_unidentified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unknown: bool = False, **evidence: Column) -> DataFrame:
    """``docs`` without the documents that ``identify`` rejects; all columns stay."""
    name = unused(docs, "_key")
    rejected = identify(docs, id_col, F.col(text_col), unknown=unknown, **evidence).where(~F.col("accepted")).select(F.col("key").alias(name)).distinct()
    marked = docs.withColumn(name, F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)))
    return lookup_join(marked, materialize(rejected, "rejected"), name, "left_anti", spread_on=name).select(*docs.columns)


def with_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", host_col: str = "source", unknown: bool = False) -> DataFrame:
    """``docs`` without the documents that ``identify`` rejects, with the language it finds in ``lang_col``; all columns stay.

    Only documents that are rejected, or whose language is not the declared one, are looked up.
    """
    name, found_name, kept_name = unused(docs, "_key"), unused(docs, "_found"), unused(docs, "_kept")
    parts = [F.col(id_col).cast("string"), F.col(text_col), F.col(lang_col), F.col(host_col)]
    key = F.xxhash64(*parts, *(p.isNull() for p in parts))  # rows that agree in these have the same language
    found = _identified(docs, id_col, F.col(text_col), F.col(lang_col), F.col(host_col), None, None, unknown, key)
    other = found.where(~F.col("accepted") | ~F.col("lang").eqNullSafe(F.col("declared"))).groupBy(F.col("key").alias(name))
    other = materialize(other.agg(F.min("lang").alias(found_name), F.min("accepted").alias(kept_name)), "languages")
    joined = lookup_join(docs.withColumn(name, key), other, name, "left", spread_on=name).where(F.coalesce(F.col(kept_name), F.lit(True)))
    return joined.withColumn(lang_col, F.coalesce(F.col(found_name), _code(F.col(lang_col)))).select(*docs.columns)
