"""SentencePiece encoding and decoding by backtracking.

The model's merges join the two neighbours whose joined piece scores best, leftmost first. Instead of queueing merges,
an encoder takes the longest piece at each place (found for a whole chunk by one Aho-Corasick pass) and checks that it
may stand beside the piece before it: merging the two strings again must give exactly these two pieces. If it may not,
the next shorter piece is tried; if none is left, the place is marked as failed in a bitfield and the piece before it
is shortened. A sequence whose neighbours all agree is the model's own, since the first merge across a border would
also happen between the two neighbours alone.

No piece has the space mark behind another character, so texts fall into chunks that begin at a space mark and can be
encoded apart; characters in no piece stand alone and become byte pieces. Each task remembers the chunks it has met,
up to a fixed number. Pieces that merging cannot reach are left out of the automaton.

Defined results: null is the empty text, which has no ids. Repeated rows give equal results. Extra columns are not
read. A text is processed alone, in memory in proportion to its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SPACE = "▁"
MODEL = "piece_bpe_32k.model"
REMEMBERED = 250_000


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """Encoder and decoder of one model; made once per task from the model file."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.byte_ids = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(size) if model.is_byte(i)}
        self.scores = {
            model.id_to_piece(i): model.get_score(i) for i in range(size)
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        }
        self.ids = {p: model.piece_to_id(p) for p in self.scores}
        self.normalize = sentencepiece.SentencePieceNormalizer(model_file=path).normalize
        self.letters = {c for p in self.scores for c in p}
        if any(SPACE in p.lstrip(SPACE) for p in self.scores):
            raise ValueError("a piece of this model has a space mark inside; its texts do not fall into chunks")
        alone = "".join(re.escape(c) for c in "\n\r\t" if c not in self.letters)
        self.chunks = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else "")).findall
        self.found: dict[str, tuple[int, str, str]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        whole = [p for p in self.scores if len(p) == 1 or self.merge(p) == [p]]
        self.outputs = {p: (1, str(i), p.replace(SPACE, " ")) for p, i in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for p in whole:
            if len(p) > 1:
                self.automaton.add_word(p, (len(p), p))
        self.automaton.make_automaton()
        known = {*whole, *self.letters}
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in known), None) for p in known}

    def merge(self, text: str) -> list[str]:
        """The model's pieces of a short string, by its rule: best score first, leftmost among equals."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, where = None, -1
            for k in range(len(parts) - 1):
                score = scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, where = score, k
            if best is None:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def agree(self, left: str, right: str) -> bool:
        """Merging both again keeps the border between them."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= 400_000:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merge(left + right) == [left, right]
        return known

    def split(self, chunk: str) -> list[str]:
        """Pieces of a chunk by backtracking."""
        n = len(chunk)
        longest = list(chunk)  # one character where no piece begins
        for end, (size, piece) in self.automaton.iter(chunk):
            longest[end + 1 - size] = piece  # ends ascend, so the longest piece of a start comes last
        failed = 0  # a bit per place from which no way leads to the end
        pairs, shorter, agree = self.pairs, self.shorter, self.agree
        piece, last, taken, at = longest[0], None, [], 0
        while True:
            while piece is not None:
                end = at + len(piece)
                if not (failed and failed >> end & 1):
                    fits = last is None or pairs.get((last, piece))
                    if fits or (fits is None and agree(last, piece)):
                        break
                piece = shorter.get(piece)
            if piece is not None:
                taken.append(piece)
                if end == n:
                    return taken
                last, at = piece, end
                piece = longest[at]
            else:
                failed |= 1 << at
                piece = taken.pop()
                at -= len(piece)
                piece = shorter.get(piece)
                last = taken[-1] if taken else None

    def bytes_of(self, letter: str) -> tuple[int, str, str]:
        """Byte pieces of a character without a piece of its own."""
        raw = letter.encode("utf-8")
        return len(raw), ",".join(str(self.byte_ids[b]) for b in raw), raw.decode("utf-8", "replace")

    def chunk(self, chunk: str) -> tuple[int, str, str]:
        """Number of ids, the ids joined by commas, and what they decode to."""
        outputs = self.outputs
        parts = [outputs.get(p) or self.bytes_of(p) for p in self.split(chunk)]
        entry = (sum([p[0] for p in parts]), ",".join([p[1] for p in parts]), "".join([p[2] for p in parts]))
        if len(self.found) < REMEMBERED and n_bounded(chunk):
            self.found[chunk] = entry
        return entry

    def encode_decode(self, text: str) -> tuple[int, str, str]:
        """(number of ids, ids joined by commas, decoded text) of a whole text."""
        found, chunk = self.found, self.chunk
        parts = [found.get(c) or chunk(c) for c in self.chunks(self.normalize(text))]
        decoded = "".join([p[2] for p in parts])
        # The mark that the model puts before every text is dropped again.
        return sum([p[0] for p in parts]), ",".join([p[1] for p in parts]), decoded[1:] if decoded.startswith(" ") else decoded

    def encode(self, text: str) -> list[int]:
        joined = self.encode_decode(text)[1]
        return [int(i) for i in joined.split(",")] if joined else []

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces, with runs of byte pieces read as UTF-8."""
        pieces = {i: p for p, i in self.ids.items()}
        values = {i: b for b, i in self.byte_ids.items()}
        out, raw = [], bytearray()
        for i in [*ids, None]:
            if i in values:
                raw.append(values[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i in pieces:
                out.append(pieces[i].replace(SPACE, " "))
        text = "".join(out)
        return text[1:] if text.startswith(" ") and ids and pieces.get(ids[0], "").startswith(SPACE) else text


def n_bounded(chunk: str) -> bool:
    """Only chunks of ordinary length are remembered, so that memory is bounded."""
    return len(chunk) <= 40


_MADE: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _MADE:
        _MADE[path] = Pieces(path)
    return _MADE[path]


def tokens(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of (doc_id, text); with `ids` also the ids and the decoded text."""
    fields = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces(path)
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                columns: list[list] = [[] for _ in range(5)]
                for text in part.column(1):
                    n, joined, decoded = encoder.encode_decode(text.as_py() or "")
                    values = n, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest()
                    for column, value in zip(columns, values + ((([int(i) for i in joined.split(",")] if n else []), decoded) if ids else ()), strict=False):
                        column.append(value)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()][: 5 if ids else 3]
                names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(kinds)]
                yield pa.record_batch([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=False))], names=["doc_id", *names])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, fields)


def op6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return tokens(spark.read.parquet(f"{folder}/documents.parquet"), model_path())
