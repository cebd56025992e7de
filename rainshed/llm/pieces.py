"""SentencePiece encoding and decoding that keeps the source bytes of every piece.

A text is normalised first: at each place the longest prefix that the compiled character map of the model holds is
replaced, spaces become U+2581, a leading one is added. The normaliser records for each normalised byte the source byte it
came from. The normalised text is merged (best score first, from the left among equals), and the byte range of every
piece is projected to the source through that record.

A model without a character map changes only spaces; the record is then computed from the pieces' lengths. Merges never
cross a segment border: the start of a run of U+2581, or a character that is in no piece of several characters. So
segments are merged on their own and the results kept in two generations of a bounded memo.

Edge cases: a null text is the empty text and has no pieces (the end id alone where it is asked for); repeated rows, null ids
and other columns do not matter, since each row is encoded on its own; texts of any length are encoded whole. An empty
normalised text has no pieces. The end id has an empty span at the end. Bytes of a replaced character lie at its start.
Models other than BPE with byte fallback, or with user-defined or unused pieces or a suffix space, are refused.
"""

from __future__ import annotations

import heapq
import itertools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joined, slices, table

SPACE = "▁"
MEMO_SEGMENTS = 250_000  # resolved segments of a generation; a worker keeps two
MEMO_LENGTH = 64  # longer segments are not kept
MOST_BYTES = 64 << 20  # a larger model file is not sent to the executors
ENCODED = "struct<ids:array<int>,starts:array<int>,ends:array<int>>"
_LOADED: dict[str, Model] = {}


class CharacterMap:
    """The compiled character map of a model: a double-array trie over bytes and the replacements it points to."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled, np.uint32, size // 4, 4).tolist() if size else []
        self.texts = compiled[4 + size :]

    def __bool__(self) -> bool:
        return bool(self.units)

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest key that ``data`` has at ``at``, and the key's length."""
        if not self.units:
            return None
        units, found = self.units, None
        node = self._children(units[0], 0)
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units) or units[node] & 0x800000FF != data[k]:
                break
            unit = units[node]
            node = self._children(unit, node)
            if unit >> 8 & 1:  # a key ends here; its value lies at the children's base
                found = units[node] & 0x7FFFFFFF, k + 1 - at
        if found is None:
            return None
        return self.texts[found[0] : self.texts.index(b"\0", found[0])], found[1]

    @staticmethod
    def _children(unit: int, node: int) -> int:
        return node ^ (unit >> 10) << (unit >> 6 & 8)


class Model:
    """Pieces, scores and normalisation of a model file."""

    def __init__(self, source: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto.FromString(source)
        kinds, spec = proto.ModelProto.SentencePiece, model.normalizer_spec
        taken = {p.type for p in model.pieces}
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE or kinds.BYTE not in taken:
            raise ValueError("only BPE models with byte fallback are encoded")
        if taken & {kinds.USER_DEFINED, kinds.UNUSED} or model.trainer_spec.treat_whitespace_as_suffix or not spec.escape_whitespaces:
            raise ValueError("user-defined or unused pieces, suffix spaces and unescaped spaces are not supported")
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.end = next((i for i, p in enumerate(model.pieces) if p.piece == model.trainer_spec.eos_piece), None)
        self.pieces = [p.piece for p in model.pieces]
        self.normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.of_byte = [0] * 256
        surfaces: list[bytes] = []
        self.kind = np.zeros(len(self.pieces), np.int8)  # 0 ordinary, 1 byte, 2 control, 3 unknown
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                byte = int(p.piece[3:5], 16)
                self.of_byte[byte], self.kind[i] = i, 1
                surfaces.append(bytes([byte]))
            elif p.type == kinds.CONTROL:
                self.kind[i] = 2
                surfaces.append(b"")
            elif p.type == kinds.UNKNOWN:
                self.kind[i] = 3
                surfaces.append(model.trainer_spec.unk_surface.encode())
            else:
                surfaces.append(p.piece.replace(SPACE, " ").encode())
        self.surfaces = pa.array(surfaces, pa.binary())
        normal = self.kind == 0
        self.norm_bytes = np.where(normal, [len(p.encode()) for p in self.pieces], self.kind == 1).astype(np.int64)
        self.source_bytes = np.where(normal, [len(s) for s in surfaces], self.kind == 1).astype(np.int64)
        order = {s: k for k, s in enumerate(sorted({p.score for p in model.pieces}, reverse=True))}
        self.rank = {p.piece: order[p.score] for p in model.pieces if p.type == kinds.NORMAL and len(p.piece) > 1}
        joining = sorted(set("".join(self.rank)) - {SPACE})
        inner = "[" + "".join(map(re.escape, joining)) + "]" if joining else "(?!)"
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):  # merges may cross spaces: the text is one segment
            self.segments, self.plain = re.compile(".+", re.S).findall, None
        else:
            self.segments = re.compile(f"{SPACE}+(?:{inner})*|(?:{inner})+|.", re.S).findall
            self.plain = re.compile(f" +(?:{inner})*|(?:{inner})+|.", re.S).findall
        if self.map or self.squeeze or not self.prefix:
            self.plain = None
        self.young: dict[str, bytes] = {}  # the ids of a segment, four bytes each
        self.old: dict[str, bytes] = {}

    # -- normalisation --------------------------------------------------------------------------------

    def _prefix(self, data: bytes, at: int) -> tuple[bytes, int]:
        """What the text at ``at`` normalises to, and the bytes it takes: a key of the map or one character."""
        if (found := self.map.longest(data, at)) is not None:
            return found
        first = data[at]
        size = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return data[at : at + size], size

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its bytes and its end, the source byte it came from."""
        data, at, space = text.encode(), 0, SPACE.encode()
        out, source = bytearray(), []
        if self.squeeze:
            while at < len(data):
                new, taken = self._prefix(data, at)
                if new != b" ":
                    break
                at += taken
        if at == len(data):
            return "", np.zeros(1, np.int64)
        if self.prefix:
            out += space
            source += [at] * 3
        after_space = self.squeeze
        while at < len(data):
            new, taken = self._prefix(data, at)
            same = new == data[at : at + taken]
            if after_space:
                new = new.lstrip(b" ")
            if new:
                for k, byte in enumerate(new):
                    if byte == 32:
                        out += space
                        source += [at] * 3
                    else:
                        out.append(byte)
                        source.append(at + k if same else at)
                after_space = self.squeeze and new.endswith(b" ")
            at += taken
        while self.squeeze and out.endswith(space):
            at = source[len(out) - 3]
            del out[-3:], source[-3:]
        return out.decode(), np.array([*source, at], np.int64)

    # -- merging --------------------------------------------------------------------------------------

    def merge(self, segment: str) -> tuple[int, ...]:
        """Merge the characters of a segment: the pair of best score first, from the left among equals."""
        rank, n = self.rank.get, len(segment)
        parts: list[str | None] = list(segment)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i in range(n - 1) if (r := rank(segment[i : i + 2])) is not None]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            entry = pop(heap)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if parts[i] is None or j >= n or rank(both := parts[i] + parts[j]) != entry >> 32:
                continue
            parts[i], parts[j], k = both, None, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (r := rank(both + parts[k])) is not None:
                    push(heap, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := rank(parts[h] + both)) is not None:
                push(heap, r << 32 | h)
        ids, known = [], self.normal.get
        for part in parts:
            if part is None:
                continue
            if (i := known(part)) is not None:
                ids.append(i)
            else:
                ids += [self.of_byte[b] for b in part.encode()]
        return tuple(ids)

    def merged(self, segments: list[str], spaced: bool) -> np.ndarray:
        """Ids of segments; ``spaced`` segments still hold the spaces of the source."""
        found = list(map(self.young.get, segments))
        if None in found:
            for k, ids in enumerate(found):
                if ids is None:
                    segment = segments[k]
                    if (ids := self.young.get(segment)) is None:
                        if (ids := self.old.get(segment)) is None:
                            ids = np.array(self.merge(segment.replace(" ", SPACE) if spaced else segment), np.int32).tobytes()
                        if len(segment) <= MEMO_LENGTH:
                            self.young[segment] = ids
                    found[k] = ids
            if len(self.young) > MEMO_SEGMENTS:
                self.old, self.young = self.young, {}
        return np.frombuffer(b"".join(found), np.int32)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a text, and the first and the end byte of each in the UTF-8 of the text."""
        if text and self.plain and SPACE not in text:
            ids = self.merged(self.plain(" " + text), True)
            ends = np.cumsum(self.source_bytes[ids]) - 1
            return ids, np.concatenate([[0], ends[:-1]]), ends
        normal, source = self.normalise(text)
        ids = self.merged(self.segments(normal), False)
        ends = np.cumsum(self.norm_bytes[ids])
        return ids, source[ends - self.norm_bytes[ids]], source[ends]

    # -- decoding -------------------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        """The text of any ids; bytes that are no character become U+FFFD."""
        out, run, started = [], bytearray(), False
        for i in [*ids, None]:
            if i is not None and self.kind[i] == 1:
                run.append(self.surfaces[i].as_py()[0])
                continue
            if run:
                out.append(_characters(bytes(run)))
                run, started = bytearray(), True
            if i is None or self.kind[i] == 2:
                continue
            piece = self.surfaces[i].as_py().decode()
            if not started and self.kind[i] == 0 and (self.prefix or self.squeeze) and piece.startswith(" "):
                piece = piece[1:]
                started = not self.squeeze or bool(piece)
            else:
                started = started or bool(piece)
            out.append(piece)
        return "".join(out)

    def decode_all(self, ids: pa.ListArray) -> pa.Array:
        """Texts of lists of ids. What was made by ``encode`` needs no Python object per id; the rest goes id by id."""
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        at = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(ids).fill_null(0))])
        data, places = joined(self.surfaces, flat)
        data, cuts = memoryview(data), places[at].tolist()
        out, missing = [], ids.is_null().to_numpy(zero_copy_only=False)
        for k, (a, b) in enumerate(itertools.pairwise(cuts)):
            own = flat[at[k] : at[k + 1]]
            if missing[k]:
                out.append(None)
                continue
            text = None
            if len(own) and not self.squeeze and self.kind[own[0]] == 0 and (self.kind[own] != 3).all():
                text = _as_encoded(bytes(data[a:b]), self.prefix)
            out.append(text if text is not None else self.decode(own.tolist()))
        return pa.array(out, pa.string())


def _as_encoded(data: bytes, prefix: bool) -> str | None:
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return text[1:] if prefix and text.startswith(" ") else text


def _characters(data: bytes) -> str:
    """UTF-8 text, each byte that begins no character as U+FFFD."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def load(spark: SparkSession, path: str):
    """Send a model file to the executors: a few hundred kB whatever the corpus holds; checked here."""
    with open(path, "rb") as file:
        source = file.read()
    if len(source) > MOST_BYTES:
        raise ValueError(f"{path}: a model of more than 64 MB is not broadcast")
    Model(source)  # refuse unsupported models before any task starts
    return spark.sparkContext.broadcast((f"{path}:{xxhash.xxh3_64_hexdigest(source)}", source))


def model_of(sent) -> Model:
    key, source = sent.value
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Model(source)
    return _LOADED[key]


def encode(text: Column | str, model, end_id: bool = False, decoded: bool = False) -> Column:
    """STRUCT of arrays: ids, and the start and end byte of each in the source text. ``model`` comes from ``load``.

    With ``decoded`` also the text of the ids, from the same worker: ids that went through ``decode`` would be sent to a
    second worker a task, with a model of its own.
    """

    @F.arrow_udf(ENCODED.replace(">>", ">,decoded:string>") if decoded else ENCODED)
    def pieces_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = model_of(model)
        end, none = np.array([m.end] if end_id else [], np.int32), np.zeros(1, np.int64)
        for batch in batches:  # what goes back is sent in small parts, as it is larger than the texts
            for piece in slices(batch):
                parts, counts = [], [0]
                for s in piece.to_pylist():
                    ids, starts, ends = m.encode(s or "")
                    last = (ends[-1:] if len(ends) else none)[: len(end)]
                    parts += [(ids, starts, ends), (end, last, last)]
                    counts.append(len(ids) + len(end))
                at = pa.array(np.cumsum(counts), pa.int32())
                flat = [pa.array(np.concatenate(column).astype(np.int32)) for column in zip(*parts, strict=True)]
                lists = [pa.ListArray.from_arrays(at, column) for column in flat]
                if decoded:
                    lists.append(m.decode_all(lists[0]))
                yield pa.StructArray.from_arrays(lists, ["ids", "starts", "ends", "decoded"][: len(lists)])

    return pieces_of(text)


def decode(ids: Column | str, model) -> Column:
    """STRING of an array of ids; null stays null."""

    @F.arrow_udf("string")
    def texts_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = model_of(model)
        for batch in batches:
            yield from map(m.decode_all, slices(batch))

    return texts_of(ids)


def encode_documents(docs: DataFrame, path: str, text: str = "text", out: str = "pieces", end_id: bool = False) -> DataFrame:
    """``docs`` with the column ``out`` of ids and spans (replaced if there is one of that name)."""
    return docs.withColumn(out, encode(text, load(docs.sparkSession, path), end_id))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text by the public 32k model with an end id, their text, and the source bytes the pieces span."""
    import public_tokenizers

    model = load(spark, public_tokenizers.path("piece_bpe_32k.model"))
    docs = table(spark, sf_dir, "documents").select("doc_id", encode("text", model, end_id=True, decoded=True).alias("p"))
    return docs.select(
        "doc_id",
        F.size("p.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("p.ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("p.decoded", 256).alias("decoded_sha256"),
        F.aggregate(F.zip_with("p.starts", "p.ends", lambda a, b: b - a), F.lit(0), lambda a, b: a + b).cast("long").alias("n_spanned"),
    )
