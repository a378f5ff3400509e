"""SentencePiece encoding and decoding with the pieces of a public model file.

An Aho-Corasick automaton over the pieces reads a text once; at each position its output links give
the pieces that end there, and each relaxes the best score of that position (Viterbi). The result is
the segmentation with the largest sum of piece scores, and among equal sums the one whose last piece
is longest. Characters that no piece covers become byte pieces.

Encoding loses nothing: blanks become U+2581 and a dummy blank is put in front, as the model asks,
while U+2581 itself and the control characters of the model are always written as bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Model file of the thin query; a parameter everywhere else.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: A worker remembers the pieces of so many distinct words at most, and only of words this short.
MEMO_WORDS = 400_000
MEMO_CHARS = 64


class Pieces:
    """The pieces of a model file, their automaton and the segmenter."""

    def __init__(self, model_file: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.size = sp.get_piece_size()
        self.bytes_at = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(self.size) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes_at.items()}
        if len(self.bytes_at) != 256 or self.size > 1 << 16:
            raise ValueError("a model with byte pieces and at most 65536 pieces is needed")
        self.text_of = {
            i: sp.id_to_piece(i)
            for i in range(self.size)
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
        }
        self.score_of = {i: sp.get_score(i) for i in self.text_of}
        self.byte_score = min(self.score_of.values(), default=0.0) - 10.0
        self.automaton = ahocorasick.Automaton()
        for i, piece in self.text_of.items():
            self.automaton.add_word(piece, (len(piece), self.score_of[i], i))
        self.automaton.make_automaton()
        # If no piece has a blank after another character, best paths never cross the start of a
        # word, so that words can be segmented one by one.
        self.by_word = not any(BLANK in p.lstrip(BLANK) for p in self.text_of.values())
        self.memo: dict[str, bytes] = {}

    def segment(self, text: str) -> list[int]:
        """Ids of the best segmentation of escaped text (blanks are U+2581; U+0000 stands for a
        literal U+2581, which no piece may cover)."""
        n = len(text)
        best, back = [0.0] * (n + 1), [(0, -1)] * (n + 1)
        at = 0  # positions up to ``at`` are settled
        for end, outputs in self._ends(text):
            while at < end:
                at += 1
                best[at], back[at] = best[at - 1] + self._byte_cost(text[at - 1]), (at - 1, -1)
            for size, score, piece in outputs:
                total = best[end - size] + score
                if total > best[end] or total == best[end] and size > end - back[end][0]:
                    best[end], back[end] = total, (end - size, piece)
        while at < n:
            at += 1
            best[at], back[at] = best[at - 1] + self._byte_cost(text[at - 1]), (at - 1, -1)
        out: list[int] = []
        while n:
            start, piece = back[n]
            if piece >= 0:
                out.append(piece)
            else:
                char = BLANK if text[start] == "\0" else text[start]
                out.extend(self.bytes_at[b] for b in reversed(char.encode()))
            n = start
        return out[::-1]

    def _byte_cost(self, char: str) -> float:
        return self.byte_score * len((BLANK if char == "\0" else char).encode())

    def _ends(self, text: str) -> Iterator[tuple[int, list[tuple[int, float, int]]]]:
        """Positions where pieces end, with those pieces: the automaton's output links."""
        last, found = -1, []
        for end, piece in self.automaton.iter(text):
            if end != last and found:
                yield last + 1, found
                found = []
            last = end
            found.append(piece)
        if found:
            yield last + 1, found

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, uint16. An empty text has none."""
        if not text:
            return np.zeros(0, np.uint16)
        if "\0" in text:  # its bytes go between the parts that are segmented
            ids: list[int] = []
            for i, part in enumerate(text.split("\0")):
                ids += ([self.bytes_at[0]] if i else []) + self.segment((BLANK if i == 0 else "") + _escape(part))
            return np.array(ids, np.uint16)
        escaped = BLANK + _escape(text)
        if not self.by_word:
            return np.array(self.segment(escaped), np.uint16)
        memo, out = self.memo, []
        for word in _WORDS.findall(escaped):
            ids = memo.get(word)
            if ids is None:
                ids = np.array(self.segment(word), np.uint16).tobytes()
                if len(word) <= MEMO_CHARS:
                    if len(memo) >= MEMO_WORDS:
                        memo.clear()
                    memo[word] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), np.uint16)

    def decode(self, ids: np.ndarray) -> str:
        """The text that was encoded."""
        if not len(ids):
            return ""
        if not hasattr(self, "raw"):
            self.raw = [b""] * self.size
            for i, piece in self.text_of.items():
                self.raw[i] = piece.replace(BLANK, " ").encode()
            for i, b in self.byte_of.items():
                self.raw[i] = bytes([b])
        return b"".join(map(self.raw.__getitem__, ids.tolist()))[1:].decode()


#: A run of blanks with the word behind it.
_WORDS = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")


def _escape(text: str) -> str:
    return text.replace(BLANK, "\0").replace(" ", BLANK) if BLANK in text else text.replace(" ", BLANK)


@lru_cache(maxsize=2)
def load(model_file: str) -> Pieces:
    return Pieces(model_file)


def encode(docs: DataFrame, model_file: str = MODEL, decode: bool = False) -> DataFrame:
    """All columns of ``docs``, n_tokens and token_ids (uint16, little endian); with ``decode`` also
    decoded, the text read back from token_ids.

    Whole texts are encoded, whatever their length; null and empty texts have no tokens and decode
    to an empty text. Rows that are repeated are encoded as often, equal texts alike, and an empty table gives no rows. Columns
    that already have these names are replaced. The model file is sent to the executors.
    """
    spark = docs.sparkSession
    spark.sparkContext.addFile(model_file)
    name = model_file.rsplit("/", 1)[-1]
    added = ["n_tokens", "token_ids", *(["decoded"] if decode else [])]
    kept = [c for c in docs.columns if c not in added]
    narrow = docs.select(*kept)
    fields = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema), "n_tokens bigint", "token_ids binary"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(SparkFiles.get(name))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [pieces.encode(t or "") for t in part["text"].to_pylist()]
                columns = [*part.columns, pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u2").tobytes() for x in ids], pa.binary())]
                if decode:
                    columns.append(pa.array([pieces.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [*kept, *added])

    return narrow.mapInArrow(run, ", ".join([*fields, *(["decoded string"] if decode else [])]))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of the text that they decode to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, decode=True).select(
        "doc_id",
        "n_tokens",
        "token_ids",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )
