"""SentencePiece encoding by streaming Viterbi, and decoding."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean
from .common import pieces as slices
from .common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "\u2581"
#: Stretches of at most so many characters, and twice so many of them, whose ids a worker keeps.
SHORT, KEPT = 64, 1 << 16
#: Bytes of text that are encoded at a time.
PIECE = 4_000_000


class Codec:
    """The pieces and scores of a model file, and streaming encoding and decoding with them."""

    def __init__(self, model: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {self.text[i]: i for i in plain}
        self.score = {i: float(np.float32(sp.get_score(i))) for i in plain}
        self.plain = np.zeros(n, bool)
        self.plain[plain] = True
        self.bytes = {v: k for k, v in self.byte.items()}
        self.unknown = min(self.score.values()) - 10.0
        self.longest = max(map(len, self.ids))
        # no piece holds these two characters in a row, so every path has a boundary between them
        self.inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.kept: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        # the trie of the pieces: character to (node, id of the piece that ends there, its score)
        self.trie: dict[str, tuple] = {}
        for p, i in self.ids.items():
            node = self.trie
            for c in p[:-1]:
                node = node.setdefault(c, ({}, None, 0.0))[0]
            node[p[-1]] = (node[p[-1]][0] if p[-1] in node else {}, i, self.score[i])
        for c in {p[0] for p in self.ids if p[0] not in self.ids}:  # such a character stands for its bytes
            self.trie[c] = (self.trie[c][0], -1, self.unknown)
        self.names = pa.array([self.text[i].replace(SPACE, " ") if self.plain[i] else "" for i in range(n)], pa.string())
        # a line feed that no piece holds stands alone on every path
        self.alone = not any("\n" in p for p in self.ids)

    def viterbi(self, chars: str) -> list[int]:
        """Ids of the best-scoring path over chars, earlier starts winning ties.

        Boundaries come one by one. A window is kept of the boundaries since the last committed one: score, backpointer and
        id. Where no piece reaches over a boundary all paths meet there: the ids up to it are committed and the window
        starts anew. A window four times as long as the longest piece is searched for a boundary further back that all
        surviving paths share, and again whenever it has doubled, so that the work stays linear in the text.
        """
        n, out, widest = len(chars), [], 4 * self.longest
        root, unknown, none = self.trie, self.unknown, float("-inf")
        base, far, limit = 0, 0, widest
        room = min(n, 2 * widest) + 1  # a text that fits in the window is one window
        best, back, used = [none] * room, [0] * room, [0] * room
        best[0] = 0.0
        for at in range(n):
            if n > widest and at > base:
                meet = base
                if far == at:
                    meet = at
                elif at - base >= limit:
                    meet = self._meeting(at, far, base, back)
                    limit = max(widest, 2 * (at - base))
                if meet > base:
                    out += self._path(chars, base, meet, back, used)
                    drop = meet - base
                    best, back, used, base = best[drop:], back[drop:], used[drop:], meet
                    if far == at:
                        limit = widest
                if at - base + self.longest >= len(best):
                    more = widest + self.longest
                    best += [none] * more
                    back += [0] * more
                    used += [0] * more
            here, node, end = best[at - base], root, at
            for c in chars[at : at + self.longest]:
                step = node.get(c)
                if step is None:
                    if end > at:
                        break
                    step = root, -1, unknown  # no piece begins so: the character's bytes
                node, i, s = step
                end += 1
                if i is not None:
                    s += here
                    j = end - base
                    if s > best[j]:
                        best[j], back[j], used[j] = s, at, i
                    if end > far:
                        far = end
                    if node is root:
                        break
        return out + self._path(chars, base, n, back, used)

    def _path(self, chars: str, base: int, end: int, back: list, used: list) -> list[int]:
        """The ids from base to end."""
        ids: list[int] = []
        while end > base:
            i, start = used[end - base], back[end - base]
            ids += [i] if i >= 0 else [self.byte[x] for x in reversed(chars[start:end].encode("utf-8"))]
            end = start
        return ids[::-1]

    @staticmethod
    def _meeting(at: int, far: int, base: int, back: list) -> int:
        """The last boundary that all paths to the boundaries from at to far share."""
        live, count = bytearray(far - base + 1), far - at + 1
        live[at - base :] = b"\1" * count
        for x in range(far - base, 0, -1):
            if live[x]:
                if count == 1:
                    return base + x
                up = back[x] - base
                count -= live[up]
                live[up] = 1
        return base

    def stretch(self, chars: str) -> list[int]:
        """viterbi() of a stretch; those of short ones are kept. Once KEPT have come, those that do not come again go with the
        next KEPT."""
        found = self.kept.get(chars)
        if found is None:
            found = self.older.get(chars)
            if found is None:
                found = self.viterbi(chars)
            if len(chars) <= SHORT:
                if len(self.kept) >= KEPT:
                    self.kept, self.older = {}, self.kept
                self.kept[chars] = found
        return found

    def stretches(self, text: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Texts with their spaces marked, cut before every mark that follows another character, and the row of each part."""
        marked = pc.binary_join_element_wise(SPACE, pc.replace_substring(text, " ", SPACE), "")
        if self.inner:  # pieces may hold marks inside: no cut is safe
            return marked, np.arange(len(marked))
        cut = pc.replace_substring_regex(marked, f"([^{SPACE}]){SPACE}", "\\1\x00" + SPACE)
        if self.alone:
            cut = pc.replace_substring(cut, "\n", "\x00\n\x00")
        lists = pc.split_pattern(cut, "\x00")
        return pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)

    def encode(self, text: pa.Array) -> pa.ListArray:
        """Ids of each text, as a list array; empty texts have none, null texts null."""
        full = pc.fill_null(pc.greater(pc.binary_length(text), 0), False)
        null = pc.is_null(text).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(full.to_numpy(zero_copy_only=False))
        some = text.filter(full)
        nul = pc.match_substring(some, "\x00").to_numpy(zero_copy_only=False)
        parts, of = self.stretches(pc.if_else(pa.array(~nul), some, ""))
        enc = parts.dictionary_encode()
        known = [self.stretch(x) for x in enc.dictionary.to_pylist()]
        size = np.fromiter(map(len, known), np.int64, len(known))
        flat = np.fromiter(chain.from_iterable(known), np.int32, int(size.sum()))
        start = np.cumsum(size) - size
        which = enc.indices.to_numpy(zero_copy_only=False)
        each = size[which]
        ids = flat[np.repeat(start[which] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))]
        n = np.zeros(len(text), np.int64)
        np.add.at(n, rows[of], each)
        if nul.any():  # a text with the cut mark itself goes through in one stretch
            own = {int(rows[k]): self.viterbi(SPACE + some[int(k)].as_py().replace(" ", SPACE)) for k in np.flatnonzero(nul)}
            offsets = np.concatenate(([0], np.cumsum(n)))
            lists = [None if null[k] else own.get(k, ids[offsets[k] : offsets[k + 1]]) for k in range(len(text))]
            return pa.array(lists, pa.list_(pa.int32()))
        offsets = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32), mask=np.concatenate((null, [False])))
        return pa.ListArray.from_arrays(offsets, pa.array(ids))

    def decode_all(self, lists: pa.ListArray) -> pa.Array:
        """decode() of every list: pieces are taken and joined by row; rows with byte pieces go one by one."""
        flat = lists.flatten()
        ids = flat.to_numpy(zero_copy_only=False)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        edges = np.concatenate(([0], np.cumsum(sizes)))
        other = np.concatenate(([0], np.cumsum(~self.plain[ids])))
        odd = np.flatnonzero(other[edges[1:]] > other[edges[:-1]])
        taken = self.names.take(flat)  # its bytes are all texts in a row; only their edges are wanted
        taken = taken.combine_chunks() if isinstance(taken, pa.ChunkedArray) else taken
        offsets = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset : taken.offset + len(taken) + 1][edges] if len(taken) else np.zeros(len(edges), np.int32)
        raw = np.frombuffer(taken.buffers()[2], np.uint8) if len(taken) else np.zeros(0, np.uint8)
        raw, offsets = raw[offsets[0] : offsets[-1]], offsets - offsets[0]
        lead = offsets[:-1][offsets[1:] > offsets[:-1]]
        lead = lead[raw[lead] == 32]
        keep = np.ones(len(raw), bool)
        keep[lead] = False
        offsets = offsets - np.searchsorted(lead, offsets)
        text = pa.StringArray.from_buffers(len(lists), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw[keep]))
        text = pc.if_else(pc.is_valid(lists), text, pa.scalar(None, pa.string()))
        if not len(odd):
            return text
        out = np.array(text.to_numpy(zero_copy_only=False), object)
        for k in odd:
            out[k] = self.decode(ids[edges[k] : edges[k + 1]].tolist())
        return pa.array(out, pa.string())

    def decode(self, ids: list[int] | None) -> str | None:
        """The text of ids: pieces joined, byte pieces as UTF-8, marks as spaces, without the leading mark."""
        if ids is None:
            return None
        a = np.asarray(ids, np.int64)
        if not len(a):
            return ""
        plain = self.plain[a]
        name = self.text
        if plain.all():
            text = "".join([name[i] for i in ids])
        else:
            held, raw = [], bytearray()
            for i in ids:
                if (x := self.bytes.get(i)) is not None:
                    raw.append(x)
                    continue
                if raw:
                    held.append(raw.decode("utf-8", "replace"))
                    raw = bytearray()
                held.append(name[i] if self.plain[i] else "")
            text = "".join(held) + raw.decode("utf-8", "replace")
        return text.replace(SPACE, " ")[1:] if text.startswith(SPACE) else text.replace(SPACE, " ")


_CODECS: dict[str, Codec] = {}


def codec_of(model: str) -> Codec:
    """The codec of a model, made once by a worker."""
    if model not in _CODECS:
        _CODECS[model] = Codec(model)
    return _CODECS[model]


def encode(docs: DataFrame, model: str = MODEL, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep and ids, the SentencePiece ids of column text.

    Null text: null ids; empty text: none. A text that holds the mark U+2581 itself encodes like one with a space there,
    as in the model's own library. Rows and their order within partitions stay; repeated rows give equal rows.
    """
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for b in lean(slices(batches, "text", PIECE)):
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in names], codec.encode(b.column("text").cast(pa.string()))], [*names, "ids"])

    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in names)
    return docs.select(*names, *(["text"] if "text" not in names else [])).mapInArrow(run, f"{fields}, ids array<int>")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded with decoded, the text of column ids."""
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                c = b.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([*c.columns, codec.decode_all(c.column("ids"))], [*names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{fields}, decoded string")


def round_trip(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids, same): the ids of each text, and whether decoding them gives the text back (marks count as spaces).

    Null text: null ids, which decode to null; empty text: no ids. Repeated rows give equal rows; other columns take no
    part; no rows: none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for b in lean(slices(batches, "text", PIECE)):
            text = b.column("text").cast(pa.string())
            ids = codec.encode(text)
            same = pc.equal(pc.fill_null(codec.decode_all(ids), "\x00"), pc.fill_null(pc.replace_substring(text, SPACE, " "), "\x00"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids, same], ["doc_id", "ids", "same"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, same boolean")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the number and digest of its ids, and whether they decode to the text; null text: none, empty: 0."""
    out = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_digest"), F.col("same").alias("round_trip"))
