"""BM25 over a token table.

Documents and queries belong to a ``part`` (a corpus); sizes, frequencies and ranks are those of the part.
Only tokens that some query asks for ever leave their document, as numbers packed in one row a document;
document lengths are taken before that, so they count all tokens, and documents without tokens count too.
Pairs of a query and a document are never moved: documents and queries meet in tiles of a part, and a tile
returns the best documents of each query.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import batch
from ..functions.stem import added_stems, stem_word
from ..functions.text import QUERY_STOPWORDS, identifier_parts, identifier_tokens, idf, looks_like_identifier, query_words
from ..functions.words import ASCII_WORD, counted, found_words, word_tokens
from ..session import durable
from . import tiles as cut

K1, B = 1.5, 0.75
#: Tokens of queries that go to every task at once (about 20 MB); more take one pass over the documents a block.
FEW_TOKENS = 500_000
#: Documents and queries of a tile.
TILE_DOCUMENTS, TILE_QUERIES = cut.DOCUMENTS, cut.QUERIES
#: More than rounding to 6 digits can move a score.
SLACK = 2e-6
#: Words that a worker remembers.
KNOWN_WORDS = 200_000


def query_tokens(queries: DataFrame, symbols: DataFrame | None = None, stem: bool = False) -> DataFrame:
    """``part, qid, token, qtf`` of ``queries`` (part, qid, query): code tokens without common words, except
    those between backticks, that look like identifiers or that name a symbol (``part, name``, lower case)
    of the part, and the stems of their parts with ``stem``. A token that comes several times counts as often."""
    words = queries.select("part", "qid", F.explode(query_words(F.col("query"))).alias("w")).select("part", "qid", "w.word", "w.quoted")
    words = words.withColumn("low", F.lower("word"))
    common = F.col("low").isin(*QUERY_STOPWORDS) & ~F.col("quoted") & ~looks_like_identifier(F.col("word"))
    if symbols is not None:
        named = symbols.select("part", F.col("name").alias("low")).where(F.col("low").isin(*QUERY_STOPWORDS)).distinct().withColumn("named", F.lit(True))
        words = words.join(named, ["part", "low"], "left")
        common = common & F.col("named").isNull()
    kept = words.where(~common)
    every = identifier_tokens(F.col("word"))
    if stem:
        every = F.concat(every, added_stems(identifier_parts(F.col("word"))))
    tokens = kept.select("part", "qid", F.explode(every).alias("token"))
    return tokens.groupBy("part", "qid", "token").agg(F.count("*").alias("qtf"))


def _postings(wanted: dict[str, dict[str, int]], stem: bool):
    """The wanted tokens of each document, as the numbers of its part with their counts: packed, the numbers
    as differences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        # parts of words are few, and the same in all corpora
        once = lru_cache(KNOWN_WORDS)(stem_word) if stem else None
        cut = lambda w: word_tokens(w, once)
        for b in batches:
            if sum(map(len, known.values())) > KNOWN_WORDS:
                known.clear()
            dl, ids, tfs = [], [], []
            for part, text, words, tokens in zip(*(c.to_pylist() for c in (b.column(0), *b.columns[2:]))):
                own = known.setdefault(part, {})
                if tokens is not None:
                    n, found = counted(tokens, own, wanted.get(part, {}), lambda t: [t])
                else:
                    n, found = counted(ASCII_WORD.findall(text) if text is not None else words, own, wanted.get(part, {}), cut)
                dl.append(n)
                number = sorted(found)
                ids.append(_packed(np.diff(number, prepend=0)))
                tfs.append(_packed([found[i] for i in number]))
            yield batch(("part", "doc", "dl", "ids", "tfs"), (b.column(0), b.column(1), pa.array(dl, pa.int32()), pa.array(ids, pa.binary()), pa.array(tfs, pa.binary())))

    return run


def _packed(numbers) -> bytes:
    return zlib.compress(np.asarray(numbers, np.int32).tobytes(), 1) if len(numbers) else b""


def _numbers(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(zlib.decompress(r) if r else b"", np.int32) for r in column.to_pylist()]


def _ids(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The token numbers of all rows and how many each row has."""
    rows = _numbers(column)
    return np.concatenate([np.cumsum(r, dtype=np.int32) for r in rows] or [np.zeros(0, np.int32)]), np.fromiter(map(len, rows), np.int64, len(rows))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each number; under number -1 all documents (of the first block), with the sum of
    their lengths."""
    for b in batches:
        names = b.column(0).dictionary_encode()
        parts, codes = names.dictionary, names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ids, n = _ids(b.column(2))
        pairs, held = np.unique(np.repeat(codes, n) << 32 | ids, return_counts=True)
        first = b.column(3).to_numpy(zero_copy_only=False) == 0
        docs = np.bincount(codes[first], minlength=len(parts))
        total = np.bincount(codes[first], b.column(1).to_numpy(zero_copy_only=False)[first], len(parts)).astype(np.int64)
        code = np.concatenate([pairs >> 32, np.arange(len(parts))])
        ids = np.concatenate([pairs & 0xFFFFFFFF, np.full(len(parts), -1)]).astype(np.int32)
        total = np.concatenate([np.zeros(len(pairs), np.int64), total])
        yield batch(("part", "id", "n", "total"), (parts.take(pa.array(code)), pa.array(ids), pa.array(np.concatenate([held, docs])), pa.array(total)))


def _tile(n: int):
    """The documents of a tile that may be among the ``n`` best of each of its queries, with their sums."""

    def run(key: tuple, docs: pa.Table, queries: pa.Table) -> pa.Table:
        met = docs.column("doc").combine_chunks().dictionary_encode("encode")
        code, size = met.indices.to_numpy(zero_copy_only=False), len(met.dictionary)
        ids, each = _ids(docs.column("ids"))
        tf = np.concatenate(_numbers(docs.column("tfs")) or [np.zeros(0)]).astype(np.float64)
        at = np.repeat(code, each)
        if len(queries) and len(docs):
            length = K1 * ((1.0 - B) + B * docs.column("dl").to_numpy() / queries.column("avgdl")[0].as_py())
            below = tf + np.repeat(length, each)
            order = np.argsort(ids, kind="stable")
            ids, at, tf, below = ids[order], at[order], tf[order], below[order]
        asked = queries.column("qid").combine_chunks().dictionary_encode("encode")
        of = asked.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(of, kind="stable")
        of, token, weight = of[order], queries.column("id").to_numpy()[order], queries.column("w").to_numpy()[order]
        lo, hi = np.searchsorted(ids, token, "left"), np.searchsorted(ids, token, "right")
        starts = np.searchsorted(of, np.arange(len(asked.dictionary) + 1))
        sums = np.zeros(size)
        out_q, out_d, out_s = [], [], []
        for q in range(len(asked.dictionary)):
            sums[:] = 0.0
            for j in range(starts[q], starts[q + 1]):
                span = slice(lo[j], hi[j])
                sums[at[span]] += weight[j] * tf[span] * (K1 + 1.0) / below[span]
            best = np.flatnonzero(sums)
            score = sums[best]
            if len(best) > n:
                keep = score >= np.partition(score, -n)[-n] - SLACK
                best, score = best[keep], score[keep]
            out_q.append(np.full(len(best), q))
            out_d.append(best)
            out_s.append(score)
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        q, d, s = join(out_q, np.int64), join(out_d, np.int64), join(out_s, np.float64)
        return pa.table({"part": pa.array([key[0].as_py()] * len(q), pa.string()), "qid": asked.dictionary.take(pa.array(q)), "doc": met.dictionary.take(pa.array(d)), "score": pa.array(s)})

    return run


def bm25(documents: DataFrame, queries: DataFrame, n: int, stem: bool = False) -> DataFrame:
    """``part, qid, doc, score, bm25_rank``: the ``n`` best documents of each query (part, qid, token, qtf), of
    those with a common token. ``documents`` has part (string), doc, and tokens, or a text that is cut into code
    tokens here, with the stems of their parts with ``stem``; each doc comes once. Scores are rounded to 6
    digits before they are ranked; ties go to the smaller ``doc``."""
    queries = durable(queries.where("part is not null and token is not null"))
    numbered = durable(queries.select("part", "token").distinct().withColumn("id", F.row_number().over(Window.partitionBy("part").orderBy("token"))))
    if "text" in documents.columns:
        text, words = found_words(F.col("text"))
        tokens = F.lit(None).cast("array<string>")
    else:
        text, words, tokens = F.lit(None).cast("string"), F.lit(None).cast("array<string>"), F.coalesce("tokens", F.array().cast("array<string>"))
    rows = documents.where("part is not null").select("part", "doc", text.alias("text"), words.alias("words"), tokens.alias("tokens"))
    doc, qid = rows.schema["doc"].dataType.simpleString(), queries.schema["qid"].dataType.simpleString()
    blocks, held = max(1, math.ceil(numbered.count() / FEW_TOKENS)), None
    for i in range(blocks):
        found = numbered.where(F.pmod(F.xxhash64("token"), F.lit(blocks)) == i).toArrow().to_pydict()
        wanted: dict[str, dict[str, int]] = {}
        for part, token, number in zip(found["part"], found["token"], found["id"]):
            wanted.setdefault(part, {})[token] = number
        one = rows.mapInArrow(_postings(wanted, stem), f"part string, doc {doc}, dl int, ids binary, tfs binary").withColumn("block", F.lit(i))
        held = one if held is None else held.unionByName(one)
    held = durable(held)
    counts = durable(held.select("part", "dl", "ids", "block").mapInArrow(_frequencies, "part string, id int, n long, total long").groupBy("part", "id").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
    stats = counts.where("id = -1").select("part", F.col("n").alias("docs"), (F.col("total") / F.col("n")).alias("avgdl"))
    df = counts.where("id > 0").select("part", "id", F.col("n").alias("df"))
    weighted = queries.join(numbered, ["part", "token"]).join(df, ["part", "id"]).join(stats, "part")
    weighted = weighted.select("part", "qid", "id", (F.col("qtf") * idf(F.col("docs"), F.col("df"))).alias("w"), "avgdl")
    asked = queries.groupBy("part").agg(F.count_distinct("qid").alias("n"))
    met = cut.tiles(held.where(F.length("ids") > 0).drop("block"), weighted, stats.select("part", F.col("docs").alias("n")), asked, (TILE_DOCUMENTS, TILE_QUERIES))
    scores = met.applyInArrow(_tile(n), f"part string, qid {qid}, doc {doc}, score double")
    scores = scores.withColumn("score", F.round("score", 6)).where("score > 0")
    order = Window.partitionBy("part", "qid").orderBy(F.desc("score"), "doc")
    return scores.withColumn("bm25_rank", F.row_number().over(order)).where(F.col("bm25_rank") <= n)
