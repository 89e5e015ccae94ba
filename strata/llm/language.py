"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads every word on its own (its state starts anew at white space),
labels each of its bytes, and a document's probabilities are the mean over the
bytes of letters of the whole text. Equal words of a run of text have equal
labels, so each distinct word is read once and counted as often as it stands
there. The network is trained in numpy on words drawn evenly over the whole
texts of a bounded number of labelled documents (TRAIN_DOCS, TRAIN_WORDS).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import load, pick
from strata.llm.gru import ByteGRU
from strata.llm.words import flat, runs, word_hashes, word_spans

TRAIN_DOCS = 4000  #: labelled documents that are learned from, at most
TRAIN_WORDS = 64  #: words of each, evenly over its whole text
PIECE = 32  #: bytes; the state also starts anew within longer words
RUN_BYTES = 4 << 20
UNKNOWN = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[0x41:0x5B] = _IS_LETTER[0x61:0x7B] = _IS_LETTER[0x80:] = True


def _draw(words: int):
    def run(batches):
        for batch in batches:
            drawn = []
            for text in batch.column("text").to_pylist():
                data, off = flat(pa.array([text or ""]))
                starts, ends, _ = word_spans(data, off)
                at = np.unique(np.linspace(0, len(starts) - 1, min(words, len(starts))).astype(int)) if len(starts) else []
                drawn.append([data[starts[i]:ends[i]][:PIECE].tobytes() for i in at])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(drawn, pa.list_(pa.binary()))],
                                             names=["doc_id", "lang", "words"])

    return run


def train(docs: DataFrame, learn, id_col: str, text_col: str, lang_col: str, limit: int = TRAIN_DOCS, words: int = TRAIN_WORDS):
    """(languages, network) from rows that meet ``learn`` and have a lang; (languages, None) below two languages.

    At most ``limit`` documents are learned from, those with the smallest hash of doc_id.
    """
    known = pick(docs, id_col, lang_col).toDF("doc_id", "lang").where("lang IS NOT NULL").where(learn)
    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    if len(languages) < 2:
        return languages, None
    chosen = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)  # bounded by ``limit``
    texts = pick(docs, id_col, text_col, lang_col).toDF("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    kind = texts.schema["doc_id"].dataType.simpleString()
    drawn = texts.join(F.broadcast(chosen), "doc_id").mapInArrow(_draw(words), f"doc_id {kind}, lang string, words array<binary>")
    # one row for each chosen doc_id, however often it stands in the table
    rows = drawn.groupBy("doc_id").agg(F.min(F.struct("lang", "words")).alias("x")).select("x.*").collect()
    rows = sorted((r["lang"], [bytes(w) for w in r["words"]]) for r in rows)
    samples = [(w, languages.index(lang)) for lang, ws in rows for w in ws]
    if not samples:
        return languages, None
    network = ByteGRU(len(languages))
    lowered = np.frombuffer(b"".join(w for w, _ in samples), np.uint8)
    cuts = np.cumsum([0, *[len(w) for w, _ in samples]])
    lowered = _LOWER[lowered].tobytes()
    network.fit([lowered[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], np.array([y for _, y in samples]))
    return languages, network


def word_probabilities(network: ByteGRU, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every word the sum of its letters' class probabilities, and the number of its letters."""
    letters = np.concatenate([[0], np.cumsum(_IS_LETTER[data])])
    count = letters[ends] - letters[starts]
    total = np.zeros((len(starts), network.classes), np.float32)
    for n in np.unique(ends - starts):
        rows = np.flatnonzero(ends - starts == n)
        for k in range(0, len(rows), 8192):
            part = rows[k:k + 8192]
            x = data[starts[part][:, None] + np.arange(n)]
            p = network.probabilities(_LOWER[x])
            total[part] = np.einsum("tnc,nt->nc", p, _IS_LETTER[x].astype(np.float32))
    return total, count


def document_scores(network: ByteGRU, column):
    """Mean class probabilities over the letters of each text; zeros where there are none."""
    data, off = flat(column)
    for first, last in runs(off, RUN_BYTES):
        part, o = data[off[first]:off[last]], off[first:last + 1] - off[first]
        starts, ends, doc = word_spans(part, o)
        pieces = (ends - starts + PIECE - 1) // PIECE
        if len(starts) and pieces.max() > 1:
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            starts, stop, doc = np.repeat(starts, pieces) + nth * PIECE, np.repeat(ends, pieces), np.repeat(doc, pieces)
            ends = np.minimum(starts + PIECE, stop)
        out = np.zeros((last - first, network.classes))
        if len(starts):
            _, one, back = np.unique(word_hashes(part, starts, ends), return_index=True, return_inverse=True)
            total, count = word_probabilities(network, part, starts[one], ends[one])
            for c in range(network.classes):
                out[:, c] = np.bincount(doc, weights=total[back, c], minlength=last - first)
            out /= np.maximum(np.bincount(doc, weights=count[back], minlength=last - first), 1)[:, None]
        yield from out


def _predict(languages: list[str], network: ByteGRU | None):
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if network is None:
                lang = [languages[0] if languages else UNKNOWN] * n
                score = [1.0 if languages else 0.0] * n
            else:
                p = np.array(list(document_scores(network, batch.column("text")))).reshape(n, network.classes)
                best = p.argmax(axis=1) if n else np.zeros(0, int)
                lang = [languages[i] for i in best]
                score = np.clip(p.max(axis=1), 0, 1).tolist() if n else []
            known = batch.column("has_letter").to_pylist()
            lang = [x if k else UNKNOWN for x, k in zip(lang, known, strict=True)]
            score = [x if k else 0.0 for x, k in zip(score, known, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in batch.schema.names if c not in ("has_letter",)] + [pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                names=[c for c in batch.schema.names if c not in ("has_letter",)] + ["lang_pred", "score"])

    return run


def identify(docs: DataFrame, learn=None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple = (),
             train_docs: int = TRAIN_DOCS, with_text: bool = False) -> DataFrame:
    """Predicted language and score (0 to 1) of every whole text.

    ``learn`` is a condition on doc_id that says whose lang may be learned
    (default: all). Returns doc_id, lang_pred, score, the columns in ``keep`` and, if
    ``with_text``, text.
    A null text or one without a letter is ``und`` with score 0. Without any
    labelled row everything is ``und``; with one language only, it is that one.
    Repeated rows are rows of their own; an empty table gives no rows.
    """
    languages, network = train(docs, F.lit(True) if learn is None else learn, id_col, text_col, lang_col, train_docs)
    d = pick(docs, id_col, text_col, *keep).toDF("doc_id", "text", *[f"keep_{i}" for i in range(len(keep))])
    d = d.withColumn("has_letter", F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)))
    fields = ", ".join(f"{c} {t}" for c, t in d.dtypes if c != "has_letter")
    out = d.mapInArrow(_predict(languages, network), f"{fields}, lang_pred string, score double")
    return out.select("doc_id", "lang_pred", "score", *["text"] * with_text, *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)])


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """All ``documents``; learns from rows whose crc32(doc_id as text) mod 4 is not 2."""
    rest = F.crc32(F.col("doc_id").cast("string")) % 4
    out = identify(load(spark, sf_dir, "documents"), rest != 2)
    return out.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
