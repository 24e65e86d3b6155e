"""Language identification by hyperdimensional profiles (operator 4).

Every letter has a random vector of +1 and -1. An n-gram's vector binds
(multiplies) its letters' vectors, each permuted (rotated) by its position; a
text's vector bundles (adds) those of all its n-grams, and a language's
prototype bundles all its training texts. A text gets the language whose
prototype has the largest cosine with its own vector.

Training covers all labelled rows: tasks bundle their rows into one vector per
language and Spark adds these up, so what is gathered is one vector per
language. Prototypes are broadcast after a check of their size
(``max_prototype_bytes``); more languages than that are an error.

Texts are lower-cased; every maximal run of other characters than letters is
one blank; an n-gram has three symbols, the middle one a letter. Letters are
symbols 1..127: a-z have one each, others share them by code point.

Defined results: a null text or one without a letter is ``und`` with score
0, as is everything if nothing could be learned; a null or empty language is not learned
from; a null id is not held out and not learned from; ties go to the first
language in order; the score is the cosine, 0 if negative, to six places;
repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.llm.common import by_size, id_crc, keep_table, ready

SYMBOLS = 128
UNDETERMINED = "und"
_NOT_LETTER = re.compile(r"[\W\d_]")
_TABLE: list[np.ndarray] = []  # symbol of every code point; one per worker process


def symbol_table() -> np.ndarray:
    if not _TABLE:
        t = np.zeros(0x110000, dtype=np.int64)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ord(ch.lower()[0])
                t[c] = low - 96 if 97 <= low <= 122 else 27 + low * 2654435761 % 4294967296 % (SYMBOLS - 27)
        _TABLE.append(t)
    return _TABLE[0]


def _pieces(texts: list[str], size: int) -> Iterator[list[tuple[int, str]]]:
    """(row, piece) lists of about ``size`` characters; longer texts are cut at a character that is no letter."""
    held, n = [], 0
    for row, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = at + size
            if end < len(text):
                m = _NOT_LETTER.search(text, end)
                end = m.start() if m else len(text)
            held.append((row, text[at:end]))
            n += end - at
            at = end
            if n >= size:
                yield held
                held, n = [], 0
    if held:
        yield held


def gram_counts(texts: list[str], size: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse counts of all n-grams: (row, n-gram, count)."""
    keys, counts = [], []
    for held in _pieces(texts, size):
        codes = np.frombuffer((" " + " ".join(p for _, p in held) + " ").encode("utf-32-le"), dtype="<u4")
        sizes = np.array([len(p) + 1 for _, p in held])
        sizes[0] += 1
        row = np.repeat(np.array([r for r, _ in held], dtype=np.int64), sizes)
        sym = symbol_table()[codes]
        keep = (sym > 0) | np.r_[True, sym[:-1] > 0]
        sym, row = sym[keep], row[keep]
        mid = np.flatnonzero(sym[1:-1]) + 1
        gram = (sym[mid - 1] * SYMBOLS + sym[mid]) * SYMBOLS + sym[mid + 1]
        k, n = np.unique(row[mid] * SYMBOLS**3 + gram, return_counts=True)
        keys.append(k)
        counts.append(n)
    if not keys:
        return (np.zeros(0, np.int64),) * 3
    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    return k // SYMBOLS**3, k % SYMBOLS**3, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def letter_vectors(width: int, seed: int) -> np.ndarray:
    """Letters' vectors at the three positions, rotated by 2, 1 and 0."""
    base = np.random.default_rng([seed, width]).integers(0, 2, (SYMBOLS, width), dtype=np.int8) * np.int8(2) - np.int8(1)
    return np.stack([np.roll(base, 2, axis=1), np.roll(base, 1, axis=1), base])


def gram_vectors(grams: np.ndarray, letters: np.ndarray) -> np.ndarray:
    bound = letters[0][grams // SYMBOLS**2]
    bound *= letters[1][grams // SYMBOLS % SYMBOLS]
    bound *= letters[2][grams % SYMBOLS]
    return bound


def _bundle(grams: np.ndarray, counts: np.ndarray, letters: np.ndarray) -> np.ndarray:
    total = np.zeros(letters.shape[2])
    for at in range(0, len(grams), 4096):
        total += counts[at:at + 4096].astype(np.float32) @ gram_vectors(grams[at:at + 4096], letters).astype(np.float32)
    return total


def learn_prototypes(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", width: int = 1024,
                     seed: int = 4) -> DataFrame:
    """One row per language: ``lang, vec`` (unnormalised bundle of all its texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_vectors(width, seed)
        sums: dict[str, np.ndarray] = {}
        for b in by_size(batches, "text", 1 << 22, 4096):
            langs, code = np.unique(np.array(b.column(0).to_pylist(), dtype=object), return_inverse=True)
            row, gram, n = gram_counts([t or "" for t in b.column(1).to_pylist()])
            k, inv = np.unique(code[row] * SYMBOLS**3 + gram, return_inverse=True)
            total = np.bincount(inv, n)
            for i, lang in enumerate(langs):
                own = k // SYMBOLS**3 == i
                sums[lang] = sums.get(lang, 0) + _bundle(k[own] % SYMBOLS**3, total[own], letters)
        if sums:
            yield pa.record_batch([pa.array(list(sums)), pa.array(list(sums.values()), pa.list_(pa.float64()))],
                                  names=["lang", "vec"])

    rows = ready(labelled).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    parts = rows.where("lang is not null and lang <> ''").mapInArrow(run, "lang string, vec array<double>")
    sums = (parts.select("lang", F.posexplode("vec").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")))
    return sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))),
                                                lambda s: s["x"]).alias("vec"))


def predict(docs: DataFrame, prototypes: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
            width: int = 1024, seed: int = 4, max_prototype_bytes: int = 1 << 28, evidence: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred, score`` (columns of those names are replaced). With ``evidence`` also ``n_grams``,
    the text's distinct n-grams, and ``set_score``, the best cosine of their bundle, each counted once: unlike
    the score it does not follow what a text repeats."""
    kept = keep_table(prototypes, "langid")
    if kept.count() * width * 8 > max_prototype_bytes:
        raise ValueError("too many languages for a broadcast of their prototypes; raise max_prototype_bytes")
    learned = sorted((r["lang"], r["vec"]) for r in kept.collect())
    langs = [x[0] for x in learned]
    table = np.array([x[1] for x in learned], dtype=np.float64).reshape(len(langs), width)
    table /= np.maximum(np.sqrt((table ** 2).sum(axis=1, keepdims=True)), 1e-300)
    shared = docs.sparkSession.sparkContext.broadcast(table.astype(np.float32))
    outs = ["lang_pred", "score", *(["n_grams", "set_score"] if evidence else [])]
    base = ready(docs).drop(*outs)
    names = base.columns
    at_text = names.index(text_col)

    def cosines(row, gram, n, letters: np.ndarray, protos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows with n-grams, and their cosines with all prototypes."""
        grams, col = np.unique(gram, return_inverse=True)
        rows, at = np.unique(row, return_inverse=True)
        vecs = np.zeros((len(rows), letters.shape[2]), dtype=np.float32)
        for g in range(0, len(grams), 4096):  # a slice of the n-grams at a time bounds memory
            own = (col >= g) & (col < g + 4096)
            counts = np.zeros((len(rows), min(4096, len(grams) - g)), dtype=np.float32)
            counts[at[own], col[own] - g] = n[own]
            vecs += counts @ gram_vectors(grams[g:g + 4096], letters).astype(np.float32)
        cos = vecs @ protos.T / np.maximum(np.sqrt(np.einsum("ij,ij->i", vecs, vecs)), 1e-30)[:, None]
        return rows, np.round(np.maximum(cos.astype(np.float64), 0.0), 6)

    def scores(texts: list[str], letters: np.ndarray, protos: np.ndarray) -> list[np.ndarray]:
        row, gram, n = gram_counts(texts)
        best, score, alike = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts))
        if len(row) and len(protos):
            rows, cos = cosines(row, gram, n, letters, protos)
            best[rows], score[rows] = cos.argmax(axis=1), np.minimum(cos.max(axis=1), 1.0)
            if evidence:
                rows, cos = cosines(row, gram, np.ones_like(n), letters, protos)
                alike[rows] = np.minimum(cos.max(axis=1), 1.0)
        return [best, score, np.bincount(row, minlength=len(texts)), alike]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, protos = letter_vectors(width, seed), shared.value
        for b in by_size(batches, text_col, most_rows=512):
            best, score, distinct, alike = scores([t or "" for t in b.column(at_text).to_pylist()], letters, protos)
            found = [langs[i] if i >= 0 else UNDETERMINED for i in best.tolist()]
            new = [pa.array(found, pa.string()), pa.array(score), pa.array(distinct), pa.array(alike)]
            yield pa.record_batch([*b.columns, *new[:len(outs)]], names=[*names, *outs])

    schema = type(base.schema)(list(base.schema.fields))
    for c, kind in zip(outs, ("string", "double", "long", "double")):
        schema = schema.add(c, kind)
    return base.mapInArrow(run, schema)


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.pmod(id_crc(id_col), F.lit(modulus)) == remainder, F.lit(False))


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             fold: tuple[int, int] = (3, 1), width: int = 1024, seed: int = 4, evidence: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred, score`` (and those of ``evidence``), learned from labelled rows outside the held-out fold
    (crc32 of the id as text, modulo ``fold[0]``, is ``fold[1]``)."""
    learn = docs.where(F.pmod(id_crc(id_col), F.lit(fold[0])) != fold[1])
    prototypes = learn_prototypes(learn, text_col=text_col, lang_col=lang_col, width=width, seed=seed)
    return predict(docs, prototypes, id_col=id_col, text_col=text_col, width=width, seed=seed, evidence=evidence)
