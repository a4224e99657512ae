"""SentencePiece ids and texts, each distinct marked word segmented once.

Where no piece has a marker behind another character, nothing is ever merged across the place before a run of markers,
so that the chunks between those places can be segmented one by one: the ids of a text are those of its chunks, one
after the other. Chunks are the strings of a dictionary (dictionary.py), ids are joined back by position. A model
whose pieces can cross markers, or which rewrites texts, is given whole texts as chunks, by the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import mapped
from .dictionary import Remembered, answered, blocks, bytes_of, joined, pack, strings_of, unpack
from .textvec import flat, slices

MARKER = "▁"
_loaded: dict[str, Pieces] = {}


def model_path() -> str:
    """The default model; installed on every node, never copied into this package."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The library's processor, and whether its chunks can be segmented one by one."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ends = self.model.bos_id(), self.model.eos_id()
        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        how = spec.normalizer_spec
        plain = not how.precompiled_charsmap and how.add_dummy_prefix and how.escape_whitespaces and not how.remove_extra_whitespaces and not spec.trainer_spec.treat_whitespace_as_suffix
        self.separable = bool(plain and not any(p.type == p.USER_DEFINED or MARKER in p.piece.lstrip(MARKER) for p in spec.pieces))
        self.lone = [self.model.piece_to_id(MARKER)]

    def ids(self, chunks: list[bytes]) -> list[list[int]]:
        """Ids of chunks, which stand here without the first marker: the library puts it there itself, but not before an empty text."""
        found = self.model.encode([c.decode() for c in chunks])
        return [ids if c or not self.separable else self.lone for c, ids in zip(chunks, found)]


def pieces(path: str) -> Pieces:
    """One processor for each process and model."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts cut before every run of markers and blanks, and the number of chunks of each; of a chunk but the first of its text one marker is left out."""
    buf, offs = flat(pc.replace_substring(texts.cast(pa.large_utf8()), MARKER, " "))
    blank = buf == 32
    start = blank.copy()
    start[1:] &= ~blank[:-1]
    first = offs[:-1][offs[:-1] < offs[1:]]
    own = np.zeros(len(buf), bool)  # the first chunk of a text begins with the marker that the library adds
    own[first] = True
    edges = np.flatnonzero(start | own)
    # a text's first run of blanks belongs to its first chunk; later runs lose one blank
    lost = start & ~own
    sizes = np.diff(np.append(edges, len(buf))) - lost[edges]
    return strings_of(buf[~lost], sizes), np.diff(np.searchsorted(edges, offs))


def whole(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Every text a chunk of its own."""
    return strings_of(*bytes_of(pc.fill_null(texts.cast(pa.large_binary()), b""))), np.ones(len(texts), np.int64)


def encode(docs: DataFrame, path: str | None = None, decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids): ids of every whole text with begin and end ids, as little-endian unsigned 32-bit numbers; decoded: also what `decode` adds.

    docs: doc_id, text. A null text is empty and has the two ends alone; rows that repeat give rows each; an empty table gives none; null
    doc_ids stay null; other columns are ignored. Ids equal those of the library for the whole text. The tables
    that it reads are `_parts` of the result, to be released by whoever has stored or dropped it.
    """
    path = path or model_path()
    model = pieces(path)
    begin, end = (np.array([i], np.uint32) for i in model.ends)
    coded = blocks(docs, chunks if model.separable else whole)

    def make():
        known = Remembered(pieces(path).ids)

        def answer(strings: pa.Array, often: np.ndarray) -> bytes:
            ids = known(strings.to_pylist())
            return pack(np.array([len(x) for x in ids], np.uint32), np.array([i for x in ids for i in x], np.uint32))

        return answer

    def build(names: list, counts: np.ndarray, codes: np.ndarray, order: np.ndarray, answers: list[bytes]) -> Iterator[pa.RecordBatch]:
        got = [unpack(a, np.uint32, np.uint32) for a in answers]
        sizes = np.concatenate([np.zeros(0, np.uint32), *(g[0] for g in got)]).astype(np.int64)
        ids = np.concatenate([np.zeros(0, np.uint32), *(g[1] for g in got)])
        size, at = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        size[order], at[order] = sizes, np.cumsum(sizes) - sizes
        first = np.concatenate(([0], np.cumsum(counts)))
        step = 256
        for k in range(0, len(names), step):
            of = codes[first[k] : first[min(k + step, len(names))]]
            n = size[of]
            ends = np.cumsum(n)
            flat_ids = ids[np.repeat(at[of] - ends + n, n) + np.arange(ends[-1] if len(n) else 0)]
            cuts = np.concatenate(([0], ends))[first[k : k + step + 1] - first[k]]
            out = [np.concatenate((begin, flat_ids[s:e], end)).astype("<u4") for s, e in zip(cuts, cuts[1:])]
            columns = [pa.array(names[k : k + step], pa.int64()), pa.array([len(x) for x in out], pa.int64()), pa.array([x.tobytes() for x in out], pa.binary())]
            if decoded:
                columns.append(pa.array(pieces(path).model.decode([x.tolist() for x in out]), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "text"][: len(columns)])

    answers = answered(coded, make)
    out = joined(coded, answers, build, "doc_id bigint, n_tokens bigint, ids binary" + ", text string" * decoded)
    out._parts = coded, answers
    return out


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, text): texts as the library's decode gives them for all ids. Null ids give a null text."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path).model
        for batch in batches:
            for b in slices(batch, "ids"):
                texts = [None if i is None else model.decode(np.frombuffer(i, "<u4").tolist()) for i in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "text"])

    return mapped(encoded.select("doc_id", "n_tokens", "ids"), run, "doc_id bigint, n_tokens bigint, ids binary, text string")
