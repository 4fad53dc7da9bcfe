"""Token counts of whole texts by pre-tokens, exactly as a sentencepiece BPE model counts them.

Merges never cross some places of a text: before a word-start mark that follows something else, between letters and other
characters, and beside characters that no merged piece holds (digits, line feeds). The parts between such places are the
pre-tokens; a model is accepted only if every one of its pieces is a single pre-token of the pattern.

1. Every task counts its pre-tokens; Spark sums them, so each distinct pre-token has one row.
2. The library counts the pieces of each distinct pre-token, once.
3. Frequencies of a document's pre-tokens are joined to these counts and summed. The most frequent pre-tokens, as many as fit in
   HEAD_BYTES, are looked up in a broadcast table, so common words are never shuffled; the others are rows (document,
   pre-token, frequency) of a shuffled join. No list of token ids is made for any document.

Cases: a null text is empty and has no tokens; repeated rows are counted each for itself; null ids stay; bytes that are not UTF-8 count
as replacement characters; only the id and the text are read of the input, so other columns can't clash; an empty table gives none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Bytes of the frequent pre-tokens that are broadcast, with ENTRY bytes for each besides its text.
HEAD_BYTES, ENTRY = 24 << 20, 100
#: Distinct pre-tokens that a task holds before it hands them on, and words it remembers.
FLUSH = 300_000
MARK = "▁"
_ROW = "n_bytes long, n_head long, tail array<struct<piece:string,n:long>>"


class Pieces:
    """A sentencepiece BPE model with the pattern of its pre-tokens."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = f" AＡﬁ  é\t{MARK}\n "
        if m.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("the model normalises texts: its pre-tokens can't be found in the text itself")
        pieces = [m.id_to_piece(i) for i in range(m.vocab_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        held = set("".join(p for p in pieces if len(p) > 1))
        lone = "".join(c for c in map(chr, range(128)) if c not in held and c != " ")
        if "\n" not in lone:
            raise ValueError("the model merges line feeds")
        mixed = "".join(sorted({c for p in pieces for c in p if c.isalnum() and not c.isalpha()}))  # numerals that are no digits
        letter, single = rf"[^\W\d_{re.escape(mixed)}]", rf"[{re.escape(lone)}]"
        other = rf"(?:(?!{letter})[^{re.escape(lone)}{MARK}])"
        self.find = re.compile(rf"{MARK}+(?:{letter}+|{other}+)?|{letter}+|{single}|{other}+").findall
        if any(self.find(p) != [p] for p in pieces):
            raise ValueError("a piece of the model crosses the bounds of pre-tokens")

    def words(self, text: str) -> list[str]:
        """A text in a first, coarse cut, which parts() takes further.

        A word begins with a line feed, or with MARK if it is a pre-token behind that sign, or else stands behind a blank.
        """
        if not text:
            return []
        cut = text.replace("\n", " \n")
        if "  " in cut or text[0] == " " or MARK in text:
            return [MARK + p for p in self.find(MARK + text.replace(" ", MARK))]
        return cut.split(" ")

    def parts(self, word: str) -> list[str]:
        """The pre-tokens of one of words()."""
        if word.isalpha():
            return [MARK + word]
        if word[:1] == MARK:
            return [word[1:]]
        return self.find(word) if word[:1] == "\n" else self.find(MARK + word)

    def count(self, parts: list[str]) -> list[int]:
        """Pieces of each pre-token: it is held behind a line feed, which nothing merges with."""
        base = len(self.model.encode("\n"))
        return [len(ids) - base for ids in self.model.encode(["\n" + p for p in parts], num_threads=1)]


@lru_cache(maxsize=2)
def pieces_of(name: str) -> Pieces:
    """A model by its file's place, or by its name among the public tokenizers."""
    import os

    if not os.path.isabs(name):
        import public_tokenizers

        name = public_tokenizers.path(name)
    return Pieces(name)


def _texts(column: pa.Array) -> Iterator[str]:
    for x in column:
        yield x.as_py().decode("utf-8", "replace")


def _pre_tokens(name: str):
    def pre_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, seen = pieces_of(name), {}

        def hand_on() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["piece", "n"])
            seen.clear()
            return out

        for batch in batches:
            words: Counter[str] = Counter()
            for text in _texts(batch.column(0)):
                words.update(bpe.words(text))
                if len(words) > FLUSH:
                    _spread(bpe, words, seen)
            _spread(bpe, words, seen)
            if len(seen) > FLUSH:
                yield hand_on()
        yield hand_on()

    return pre_tokens


def _spread(bpe: Pieces, words: Counter[str], seen: dict[str, int]) -> None:
    for word, n in words.items():
        for p in bpe.parts(word):
            seen[p] = seen.get(p, 0) + n
    words.clear()


def _counted(name: str):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = pieces_of(name)
        for batch in batches:
            k = bpe.count(batch.column("piece").to_pylist())
            yield pa.record_batch([batch.column("piece"), batch.column("n"), pa.array(k, pa.int64())], names=["piece", "n", "k"])

    return counted


def _sums(name: str, held):
    """Documents with the summed counts of their frequent pre-tokens, and the frequencies of the others."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, head = pieces_of(name), held.value
        known: dict[str, int] = {}  # words of frequent pre-tokens only
        for batch in batches:
            size, total, bounds, names, often = [], [], [0], [], []
            for x in batch.column("text"):
                raw, tail = x.as_py(), {}
                words = bpe.words(raw.decode("utf-8", "replace"))
                counts = list(map(known.get, words))
                sum_ = sum(filter(None, counts))
                if None in counts:
                    for word, n in Counter(w for w, k in zip(words, counts) if k is None).items():
                        k, whole = 0, True
                        for p in bpe.parts(word):
                            got = head.get(p)
                            if got is None:
                                tail[p], whole = tail.get(p, 0) + n, False
                            else:
                                k += got
                        if whole and len(known) < FLUSH:
                            known[word] = k
                        sum_ += n * k
                size.append(len(raw))
                total.append(sum_)
                names += tail
                often += tail.values()
                bounds.append(len(names))
            rare = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(often, pa.int64())], names=["piece", "n"])
            tails = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rare)
            yield pa.record_batch([batch.column("id"), pa.array(size, pa.int64()), pa.array(total, pa.int64()), tails], names=["id", "n_bytes", "n_head", "tail"])

    return sums


def _head(counted: DataFrame) -> tuple[dict[str, int], float]:
    """The most frequent pre-tokens with their counts, as many whole classes of frequency as HEAD_BYTES hold; the least class taken."""
    level = F.floor(F.log2("n") * 4)
    classes = counted.groupBy(level.alias("level")).agg(F.sum(F.octet_length("piece").cast("long") + ENTRY).alias("bytes")).orderBy(F.desc("level")).collect()  # some 250 at most
    least, left = float("inf"), HEAD_BYTES
    for r in classes:
        left -= r["bytes"]
        if left < 0:
            break
        least = r["level"]
    got = counted.where(level >= F.lit(least)).select("piece", "k").toArrow()
    return dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist())), least


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (more than limit tokens) for every row. model: a file's place, or a name among the public tokenizers."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    slim = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    seen = slim.select("text").mapInArrow(_pre_tokens(model), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    counted = stored(seen.mapInArrow(_counted(model), "piece string, n long, k long"), "pre-tokens")
    head, least = _head(counted)
    held = docs.sparkSession.sparkContext.broadcast(head)
    kind = slim.schema["id"].dataType.simpleString()
    rows = stored(slim.mapInArrow(_sums(model, held), f"id {kind}, {_ROW}").withColumn("row", F.monotonically_increasing_id()), "token-sums")
    held.destroy()
    rare = counted.where(F.floor(F.log2("n") * 4) < F.lit(least)).select("piece", "k")
    asked = rows.where(F.size("tail") > 0).select("row", "id", "n_bytes", "n_head", F.explode("tail").alias("t"))
    summed = asked.select("row", "id", "n_bytes", "n_head", F.col("t.piece").alias("piece"), F.col("t.n").alias("n")).join(rare, "piece").groupBy("row", "id", "n_bytes", "n_head").agg(F.sum(F.col("n") * F.col("k")).alias("n_tail"))
    whole = rows.where(F.size("tail") == 0).select("row", "id", "n_bytes", "n_head", F.lit(0).cast("long").alias("n_tail"))
    total = F.col("n_head") + F.col("n_tail")
    return whole.unionByName(summed).select(F.col("id").alias(id_col), "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
