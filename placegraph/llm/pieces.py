"""SentencePiece encoding and decoding with a shared-prefix Viterbi search.

Text is marked as the model was trained: a mark before the text and for each space.
No piece has a mark after another character, so the best segmentation of a text is
that of its marked words put together. Distinct words are searched in sorted order,
which walks their trie depth-first: the forward scores of the prefix that a word
shares with the one before stay as they are, and only the rest is computed.

The best segmentation is that of highest total piece score; on equal totals the
longer last piece wins. A character without a piece costs ten below the lowest score
and is written as its UTF-8 bytes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placegraph.llm.common import slices
from placegraph.llm.tokens import vocabulary

MARK = "▁"
_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
UNKNOWN_COST = 10.0
#: Bytes of words remembered in one Python worker, and texts whose new words are searched together.
REMEMBER = 150_000_000
LONGEST = 200
TOGETHER = 1024


class Pieces:
    """The vocabulary of a model file and the search over it."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.bytes_at = {}
        self.plain: list[bytes] = []
        #: Every ending of every piece; the whole ones with id and score.
        self.ends: dict[str, tuple[int, float] | None] = {}
        lowest = 0.0
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes_at[int(piece[3:5], 16)] = i
                self.plain.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.plain.append(b"")
            else:
                score = model.get_score(i)
                lowest = min(lowest, score)
                for k in range(1, len(piece)):
                    self.ends.setdefault(piece[k:], None)
                self.ends[piece] = (i, score)
                self.plain.append(piece.replace(MARK, " ").encode())
        if len(self.bytes_at) != 256:
            raise ValueError("the model has no byte pieces; unknown characters could not be decoded")
        self.unknown = lowest - UNKNOWN_COST
        self.known: dict[str, bytes] = {}
        self.held = 0

    def search(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of distinct words as little-endian unsigned 32-bit bytes."""
        ends, unknown, out = self.ends, self.unknown, {}
        best, back, ids = [0.0], [0], [-1]
        before = ""
        for word in sorted(words):
            same, most = 0, min(len(word), len(before))
            while same < most and word[same] == before[same]:
                same += 1
            del best[same + 1 :], back[same + 1 :], ids[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                top, at, which, start = -1e30, 0, -1, end - 1
                single = False
                while start >= 0:
                    part = word[start:end]
                    if part not in ends:
                        break
                    hit = ends[part]
                    if hit is not None:
                        single = single or start == end - 1
                        total = best[start] + hit[1]
                        if total >= top:
                            top, at, which = total, start, hit[0]
                    start -= 1
                if not single and best[end - 1] + unknown > top:
                    top, at, which = best[end - 1] + unknown, end - 1, -1
                best.append(top), back.append(at), ids.append(which)
            path, end = [], len(word)
            while end:
                start = back[end]
                if ids[end] >= 0:
                    path.append(ids[end])
                else:
                    path += [self.bytes_at[b] for b in reversed(word[start:end].encode("utf-8", "surrogatepass"))]
                end = start
            path.reverse()
            out[word] = np.array(path, "<u4").tobytes()
            before = word
        return out

    @staticmethod
    def words(text: str | None) -> list[str]:
        """Marked words of a text, the mark of each left out where it is one mark and a word."""
        if not text:
            return []
        plain = text.split(" ")
        if "" in plain or MARK in text:
            return [w[1:] if w[0] == MARK and len(w) > 1 and w[1] != MARK else "\0" + w for w in _WORDS.findall(MARK + text.replace(" ", MARK))]
        return plain if "\0" not in text else [w if w[0] != "\0" else "\0" + MARK + w for w in plain]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null and empty texts have none."""
        cut = [self.words(t) for t in texts]
        known = self.known
        new = {w for words in cut for w in words if w not in known}
        found = self.search([w[1:] if w[0] == "\0" else MARK + w for w in new])
        extra = {}
        for w in new:
            ids = found[w[1:] if w[0] == "\0" else MARK + w]
            if len(w) <= LONGEST:
                known[w] = ids
                self.held += 180 + 2 * len(w) + len(ids)
            else:
                extra[w] = ids
        get = known.__getitem__ if not extra else lambda w: extra[w] if w in extra else known[w]
        out = [b"".join(map(get, words)) for words in cut]
        if self.held > REMEMBER:
            self.known, self.held = {}, 0
        return out

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of a text's ids; without the space that stands for the first mark."""
        raw = b"".join(map(self.plain.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw[1:] if raw[:1] == b" " else raw


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The search of this Python worker for a model file."""
    if path not in _PIECES:
        _PIECES.clear()
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def _runs(batches, *columns):
    """Rows gathered up to ``TOGETHER``, so that many words share their prefixes."""
    held = [[] for _ in columns]
    for part in slices(batches, *columns):
        for have, more in zip(held, part):
            have += more
        if len(held[0]) >= TOGETHER:
            yield held
            held = [[] for _ in columns]
    if held[0]:
        yield held


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids`` of every row. Null and empty texts have an empty list; other columns are not read."""
    path = path or vocabulary("piece_bpe_32k.model")

    def run(batches):
        for ids, texts in _runs(batches, "doc_id", "text"):
            found = [np.frombuffer(b, "<u4").astype(np.int32) for b in pieces(path).encode(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``; a null list gives a null text."""
    path = path or vocabulary("piece_bpe_32k.model")

    def run(batches):
        for ids, lists in _runs(batches, "doc_id", "ids"):
            texts = [None if x is None else pieces(path).decode(np.array(x, "<u4").tobytes()).decode("utf-8", "replace") for x in lists]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id bigint, text string")


def piece_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_pieces, n_byte_pieces, ids_crc32, decoded_crc32, round_trip`` of every whole text.

    ``round_trip`` tells whether decoding gives the text back (a mark in a text comes
    back as the space it is read as). Null and empty texts have no pieces and hold.
    """
    path = path or vocabulary("piece_bpe_32k.model")
    names = ["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "decoded_crc32", "round_trip"]

    def run(batches):
        model = pieces(path)
        byte_ids = np.zeros(len(model.plain), bool)
        byte_ids[list(model.bytes_at.values())] = True
        for ids, texts in _runs(batches, "doc_id", "text"):
            raw = model.encode(texts)
            back = [model.decode(r) for r in raw]
            cols = [ids, [len(r) // 4 for r in raw], [int(byte_ids[np.frombuffer(r, "<u4")].sum()) for r in raw], [zlib.crc32(r) for r in raw],
                    [zlib.crc32(b) for b in back], [b == (t or "").replace(MARK, " ").encode("utf-8", "surrogatepass") for b, t in zip(back, texts)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 5 + [pa.bool_()])], names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} bigint" for n in names[:5]) + ", round_trip boolean")
