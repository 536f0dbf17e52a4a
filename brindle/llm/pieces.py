"""SentencePiece encoding and decoding by Viterbi over shared prefixes.

A text is cut into marked words: runs of the space mark with what follows, which
no piece of the model crosses. The distinct words of a batch are sorted, which
lines them up as the depth-first traversal of their trie; the forward states of
a word's characters stay on a stack, and the next word goes on from the last
character it shares with the one before.

For a unigram model, the state of a prefix is the best score with its last piece.
For a BPE model it is the last piece of the prefix's only valid segmentation: the
piece whose left neighbour, the last piece of the shorter prefix, would not have
been merged differently beside it. Both give the library's own ids.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm._words import slices

MARK = "▁"
_UNIGRAM, _BPE = 1, 2
_NORMAL, _UNKNOWN, _USER, _UNUSED, _BYTE = 1, 2, 4, 5, 6
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Fields of a protocol buffer message: (number, value)."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


class _Piece:
    """A piece, its id or else its only character, and which pieces it may stand right of."""

    __slots__ = ("text", "size", "code", "score", "fits")

    def __init__(self, text: str, code: int | str, score: float):
        self.text, self.size, self.code, self.score = text, len(text), code, score
        self.fits: dict[_Piece | None, bool] = {}


class _State(dict):
    """A state of an automaton over characters: next states by character, the state of the next shorter ending,
    and the pieces that end here, longest first."""

    __slots__ = ("model", "back", "endings")

    def __init__(self, model: PieceModel, back: _State | None = None):
        self.model, self.back, self.endings = model, back, ()

    def __missing__(self, c: str) -> _State:
        """The next state where no longer piece of the model begins like this."""
        back = self.back
        while back is not None and c not in back:
            back = back.back
        if back is None:
            state = _State(self.model, self.model.root)
            state.endings = (self.model.alone(c),)
            return state
        if self.model.added < 300_000:
            self.model.added += 1
            self[c] = back[c]
        return back[c]


class PieceModel:
    def __init__(self, blob: bytes):
        self.blob = blob
        self.pieces: list[str] = []
        self.types: list[int] = []
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.kind, self.dummy_prefix, self.squeeze = _UNIGRAM, True, True
        self.unknown, self.byte_ids = 0, [-1] * 256
        for number, value in _fields(blob):
            if number == 1:
                self._piece(dict(_fields(value)))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, _UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                self.dummy_prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
                if spec.get(2):
                    raise ValueError("models with a character map are not supported")
        if self.kind not in (_UNIGRAM, _BPE):
            raise ValueError("only unigram and BPE models are supported")
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("pieces that cross the start of a word are not supported")
        self.floor = min(self.scores.values(), default=0.0) - 10.0
        self.known: dict[str, _Piece] = {}
        self.judged = self.added = 0
        self.root = self._automaton()

    def _piece(self, spec: dict[int, bytes | int]) -> None:
        text, kind = spec.get(1, b"").decode(), spec.get(3, _NORMAL)
        number = len(self.pieces)
        self.pieces.append(text)
        self.types.append(kind)
        if kind in (_NORMAL, _USER, _UNUSED):
            self.ids[text] = number
            self.scores[text] = struct.unpack("<f", spec[2])[0] if 2 in spec else 0.0
        elif kind == _UNKNOWN:
            self.unknown = number
        elif kind == _BYTE:
            self.byte_ids[int(text[3:5], 16)] = number

    def marked(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return ((" " if self.dummy_prefix else "") + text).replace(" ", MARK)

    def merged(self, text: str) -> list[str]:
        """Byte-pair merges in order of score, leftmost first: the definition that the traversal must agree with."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _beside(self, left: _Piece | None, right: _Piece) -> bool:
        """Whether merges leave ``right`` whole beside ``left``, or at the start of a word."""
        if self.judged > 500_000:
            self.judged = 0
            for piece in self.known.values():
                piece.fits.clear()
        self.judged += 1
        texts = [left.text, right.text] if left else [right.text]
        found = right.fits[left] = self.merged("".join(texts)) == texts
        return found

    def coded(self, words: Iterable[str]) -> Iterator[list[int | str]]:
        """The pieces' ids of each of ``words``, which are best sorted; a character that is no piece stands for itself."""
        return self._coded_bpe(words) if self.kind == _BPE else self._coded_unigram(words)

    def segments(self, words: Iterable[str]) -> Iterator[list[str]]:
        """The pieces of each of ``words``, which are best sorted."""
        for own in self.coded(words):
            yield [x if isinstance(x, str) else self.pieces[x] for x in own]

    def alone(self, c: str) -> _Piece:
        """A character as a piece, which it can always be."""
        piece = self.known.get(c)
        if piece is None:
            piece = _Piece(c, c, self.floor)
            if len(self.known) < 100_000:
                self.known[c] = piece
        return piece

    def _automaton(self) -> _State:
        root = _State(self)
        for text, score in self.scores.items():
            node = root
            for c in text:
                if c not in node:
                    node[c] = _State(self, root)
                node = node[c]
            piece = self.known[text] = _Piece(text, self.ids[text], score)
            node.endings = (piece,)
        level = [(c, node, root) for c, node in root.items()]
        while level:
            deeper = []
            for c, node, above in level:
                back = above.back
                while back is not None and c not in back:
                    back = back.back
                node.back = root if back is None else back[c]
                rest = node.back.endings if node.back is not root else (self.alone(c),)
                node.endings = rest if node.endings[:1] == rest[:1] else node.endings + rest
                deeper += [(d, child, node) for d, child in node.items()]
            level = deeper
        return root

    def _coded_bpe(self, words: Iterable[str]) -> Iterator[list[int | str]]:
        beside = self._beside
        before, last, states = "", [None], [self.root]
        for word in words:
            shared = _shared(before, word)
            del last[shared + 1 :], states[shared + 1 :]
            node = states[shared]
            for i, c in enumerate(word[shared:], shared + 1):
                node = node[c]
                states.append(node)
                for piece in node.endings:
                    left = last[i - piece.size]
                    ok = piece.fits.get(left)
                    if beside(left, piece) if ok is None else ok:
                        last.append(piece)
                        break
                else:
                    raise AssertionError(f"no segmentation of {word[:i]!r}")
            before = word
            yield _back(len(word), last)

    def _coded_unigram(self, words: Iterable[str]) -> Iterator[list[int | str]]:
        before, best, last, states = "", [0.0], [None], [self.root]
        for word in words:
            shared = _shared(before, word)
            del best[shared + 1 :], last[shared + 1 :], states[shared + 1 :]
            node = states[shared]
            for i, c in enumerate(word[shared:], shared + 1):
                node = node[c]
                top, own = float("-inf"), None
                for piece in node.endings:  # of equal sums that with the longest last piece counts
                    score = best[i - piece.size] + piece.score
                    if score > top:
                        top, own = score, piece
                states.append(node)
                best.append(top)
                last.append(own)
            before = word
            yield _back(len(word), last)

    def piece_ids(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        if found is not None:
            return [found]
        spelled = [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]
        return [self.unknown] if -1 in spelled else spelled

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for pieces in self.segments(_WORD.findall(self.marked(text))):
            for piece in pieces:
                out += self.piece_ids(piece)
        return out

    def spelled(self, ids: Iterable[int]) -> str:
        """The marked text of ids; runs of bytes are put together again, invalid ones become U+FFFD."""
        out, run = [], bytearray()
        for i in ids:
            if self.types[i] == _BYTE:
                run.append(int(self.pieces[i][3:5], 16))
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            if self.types[i] in (_NORMAL, _USER, _UNUSED):
                out.append(self.pieces[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: Sequence[int]) -> str:
        text = self.spelled(ids).replace(MARK, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def _shared(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    k = 0
    while a[k] == b[k]:
        k += 1
    return k


def _back(at: int, last: list[_Piece | None]) -> list[int | str]:
    out = []
    while at:
        piece = last[at]
        out.append(piece.code)
        at -= piece.size
    out.reverse()
    return out


class Lexicon:
    """Ids and spelling of marked words met so far.

    When it holds ``most`` words they become the older generation, from which words that are met again
    move over; the rest is forgotten with the next change.
    """

    def __init__(self, model: PieceModel, most: int = 200_000):
        self.model, self.most = model, most
        self.clear()
        self.clear()

    def clear(self) -> None:
        self.older = (self.codes, self.flat, self.ends, self.spelling) if hasattr(self, "codes") else None
        self.codes: dict[str, int] = {}
        self.flat, self.ends, self.spelling = array("i"), array("q", [0]), []

    def learn(self, words: set[str]) -> None:
        new = words.difference(self.codes)
        known, ids, at, said = self.older
        for word in new.intersection(known):
            code = known[word]
            self.flat.extend(ids[at[code] : at[code + 1]])
            self.ends.append(len(self.flat))
            self.codes[word] = len(self.codes)
            self.spelling.append(said[code])
        fresh = sorted(new.difference(known))
        marked = [MARK + w if self.model.dummy_prefix and w[0] != MARK else w for w in fresh]
        flat, first = self.flat, len(self.codes)
        self.codes.update(zip(fresh, range(first, first + len(fresh))))
        self.spelling += marked  # pieces of the model are spelled as they stand
        for code, pieces in enumerate(self.model.coded(marked), first):
            try:
                flat.fromlist(pieces)
            except TypeError:  # with characters that are no piece
                at = len(flat)
                for piece in pieces:
                    flat.extend([piece] if isinstance(piece, int) else self.model.piece_ids(piece))
                self.spelling[code] = self.model.spelled(flat[at:])
            self.ends.append(len(flat))

    def _words(self, text: str) -> list[str]:
        """Marked words; where each has one mark, plain words that stand for them."""
        single = self.model.dummy_prefix and text and MARK not in text and "  " not in text and text[0] != " " and text[-1] != " "
        return text.split(" ") if single else _WORD.findall(self.model.marked(text))

    def encode(self, texts: Sequence[str | None]) -> Iterator[tuple[np.ndarray, str]]:
        """Ids of each text and what they decode to."""
        words = [self._words(t or "") for t in texts]
        distinct = set().union(*words) if words else set()
        if len(self.codes) + len(distinct) > self.most:
            self.clear()
        self.learn(distinct)
        ends, flat = np.frombuffer(self.ends, np.int64), np.frombuffer(self.flat, np.int32) if self.flat else np.empty(0, np.int32)
        get, say = self.codes.__getitem__, self.spelling
        for own in words:
            codes = np.fromiter(map(get, own), np.int64, len(own))
            begin, size = ends[codes], ends[codes + 1] - ends[codes]
            total = int(size.sum())
            shift = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else begin, size)
            text = "".join([say[c] for c in codes.tolist()]).replace(MARK, " ")
            yield flat[np.arange(total) + shift], text[1:] if self.model.dummy_prefix else text
        del ends, flat


_lexicons: dict[int, Lexicon] = {}


def _lexicon(blob: bytes) -> Lexicon:
    """One lexicon for each worker process and model, kept from task to task."""
    key = zlib.crc32(blob)
    if key not in _lexicons:
        _lexicons.clear()
        _lexicons[key] = Lexicon(PieceModel(blob))
    return _lexicons[key]


def _encoded(batches: Iterator[pa.RecordBatch], blob: bytes, with_ids: bool) -> Iterator[pa.RecordBatch]:
    lexicon = _lexicon(blob)
    for batch in batches:
        for a, b, texts in slices(batch, batch.schema.get_field_index("text")):
            n, sums, same, ids = [], [], [], []
            for text, (own, back) in zip(texts, lexicon.encode(texts)):
                n.append(len(own))
                sums.append(zlib.crc32(own.astype("<i4").tobytes()))
                same.append(back == (text or ""))
                if with_ids:
                    ids.append(own)
            out = [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(sums, pa.int64()), pa.array(same)]
            names = ["doc_id", "n_tokens", "ids_crc32", "round_trip"]
            if with_ids:
                at = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids).astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)


def encode_documents(docs: DataFrame, model: bytes, with_ids: bool = True) -> DataFrame:
    """Ids of each whole text under a SentencePiece model, and whether they decode to the text.

    Takes ``docs(doc_id, text, ...)`` and the bytes of a model file, which must be a unigram or
    BPE model without a character map. Returns a row for each input row: doc_id, n_tokens,
    ids_crc32 (of the ids as little-endian 32-bit numbers), round_trip, and ids unless
    ``with_ids`` is off. Null and empty texts have no ids and count as a round trip. A text that
    holds the space mark itself decodes to spaces and is no round trip. Characters outside the
    model are spelled in bytes, or are the unknown id where the model has no bytes. Repeated
    rows have the same ids. An empty table gives an empty result.
    """
    PieceModel(model)
    schema = "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _encoded(it, model, with_ids), schema)


def decode_documents(encoded: DataFrame, model: bytes) -> DataFrame:
    """doc_id and text of ``encoded(doc_id, ids)``; null ids give the empty text."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _lexicon(model).model
        for batch in batches:
            texts = [own.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(decoded, "doc_id long, text string")
