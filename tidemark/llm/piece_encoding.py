"""Encoding and decoding for merge-type piece vocabularies.

A text's symbols are its characters, white space as U+2581. An agenda holds every adjacent pair that
is itself a piece; the best score merges first, the leftmost among equals, and brings its two new
neighbours onto the agenda. Symbols that are no piece become the byte pieces of their UTF-8.

No piece joins a character and a following U+2581, and none holds a line feed, so merges never cross
those places: texts are cut there, and each distinct chunk is merged once and remembered (a bounded
table). Chunks that are new in a batch merge together, one row of numpy arrays each. In every batch
one text is also encoded by the sentencepiece library; if the ids differ, the library encodes that
whole batch, and rows that had differed say so in `batch_checked`.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import small_batches, table, trimmed

SPACE = "▁"
MODEL = "piece_bpe_32k.model"
#: Chunks in either of the two tables that a worker remembers (about 250 bytes each): when the young one is full, it becomes the old one.
CACHE = 300_000
#: Texts that are encoded together, and of which one is compared with the library.
TOGETHER = 256
#: Texts of more characters are not preferred when the one to compare is chosen.
CHECKED_CHARS = 4000
#: Chunks of up to so many characters are merged in rows of that width, longer ones one by one.
WIDTHS = (6, 9, 12, 16, 24, 40)
#: Rows that are merged together, which bounds the arrays of a very long text.
ROWS = 4096
NO_PIECE = 1 << 30
_KEY, _BITS = 1 << 22, 19
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_CHUNK = re.compile(r" ( *[^ ]*)")


class Vocabulary:
    """Pieces by text and by id. Characters that are no piece get ids from `size` on, by code point; nothing merges with them."""

    def __init__(self, path: str):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size, self.end = sp.get_piece_size(), sp.eos_id()
        self.ids: dict[str, int] = {}
        self.bytes: list[int] = [sp.unk_id()] * 256
        scores: dict[str, float] = {}
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                scores[piece], self.ids[piece] = sp.get_score(i), i
        odd = [p for p in self.ids if SPACE in p.lstrip(SPACE) or "\n" in p]
        if odd:
            raise ValueError(f"pieces cross the places where texts are cut: {odd[:5]}")
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.ranks = {p: order[s] for p, s in scores.items()}  # 0 merges first; equal scores have equal ranks
        self.char_ids = np.arange(0x110000, dtype=np.int64) + self.size
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char_ids[ord(p)] = i
        pairs = [(a, b, p) for p in self.ids for k in range(1, len(p)) if (a := self.ids.get(p[:k])) is not None and (b := self.ids.get(p[k:])) is not None]
        self.tables = self._tables(np.array([a * _KEY + b for a, b, _ in pairs], np.int64), np.array([self.ids[p] for *_, p in pairs], np.int64), np.array([self.ranks[p] for *_, p in pairs], np.int32))

    @staticmethod
    def _tables(keys, merged, ranks) -> list[tuple]:
        """Hash tables of pairs; what finds its slot taken goes to the next table."""
        out, left = [], np.arange(len(keys))
        while len(left):
            mult = np.uint64(_MULTIPLIERS[len(out) % len(_MULTIPLIERS)] + 2 * len(out))
            slot = ((keys[left].astype(np.uint64) * mult) >> np.uint64(64 - _BITS)).astype(np.int64)
            _, first = np.unique(slot, return_index=True)
            k, m, r = np.full(1 << _BITS, -1, np.int64), np.zeros(1 << _BITS, np.int32), np.full(1 << _BITS, NO_PIECE, np.int32)
            at, put = slot[first], left[first]
            k[at], m[at], r[at] = keys[put], merged[put], ranks[put]
            out.append((mult, k, m, r))
            left = np.delete(left, first)
        return out

    def look_up(self, left, right) -> tuple:
        """Ranks and ids of the pieces that pairs of ids make; NO_PIECE where they make none."""
        keys = left * _KEY + right
        rank, merged = np.full(keys.shape, NO_PIECE, np.int32), np.zeros(keys.shape, np.int32)
        for mult, k, m, r in self.tables:
            slot = ((keys.astype(np.uint64) * mult) >> np.uint64(64 - _BITS)).astype(np.int64)
            hit = k[slot] == keys
            rank, merged = np.where(hit, r[slot], rank), np.where(hit, m[slot], merged)
        return rank, merged

    def merge_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of chunks whose white space is already U+2581."""
        out: list = [None] * len(texts)
        by_size: dict[int, list[int]] = {}
        for i, t in enumerate(texts):
            by_size.setdefault(next((w for w in WIDTHS if len(t) <= w), 0), []).append(i)
        for width, rows in by_size.items():
            if width:
                symbols = [x for at in range(0, len(rows), ROWS) for x in self._merge_rows([texts[i] for i in rows[at : at + ROWS]], width)]
            else:
                symbols = [self._merge_long(texts[i]) for i in rows]
            for i, s in zip(rows, symbols, strict=True):
                out[i] = s if max(s, default=0) < self.size else [x for c in s for x in ([c] if c < self.size else self._bytes_of(c))]
        return out

    def _bytes_of(self, symbol: int) -> list[int]:
        return [self.bytes[b] for b in chr(symbol - self.size).encode("utf-8", "replace")]

    def _merge_rows(self, texts: list[str], width: int) -> list[list[int]]:
        """One row a chunk: each round takes the best entry off every row's agenda, the leftmost among equals."""
        n = len(texts)
        chars = np.frombuffer("".join(t.ljust(width, "\n") for t in texts).encode("utf-32-le"), np.uint32).reshape(n, width)
        lengths = np.fromiter(map(len, texts), np.int64, n)
        columns = np.arange(width + 1)
        symbols = np.full((n, width + 1), -1, np.int64)
        symbols[:, :width] = np.where(columns[:width] < lengths[:, None], self.char_ids[chars], -1)
        agenda, merged = self.look_up(symbols[:, :-1], symbols[:, 1:])
        agenda[symbols[:, 1:] < 0] = NO_PIECE
        live = np.arange(n)
        done = np.empty((n, width + 1), np.int64)
        while len(live):
            at = agenda.argmin(axis=1)
            rows = np.arange(len(live))
            more = agenda[rows, at] != NO_PIECE
            if not more.all():
                done[live[~more]] = symbols[~more]
                live, symbols, agenda, merged, at = live[more], symbols[more], agenda[more], merged[more], at[more]
                rows = np.arange(len(live))
                if not len(live):
                    break
            symbols[rows, at] = merged[rows, at]
            symbols = np.take_along_axis(symbols, np.minimum(columns + (columns > at[:, None]), width), 1)
            take = np.minimum(columns[:width] + (columns[:width] > at[:, None]), width - 1)
            agenda, merged = np.take_along_axis(agenda, take, 1), np.take_along_axis(merged, take, 1)
            agenda[:, -1] = NO_PIECE
            for where, r in ((at, rows), (at - 1, rows[at > 0])):
                where = where[r] if len(r) < len(rows) else where
                rank, into = self.look_up(symbols[r, where], symbols[r, where + 1])
                agenda[r, where], merged[r, where] = np.where(symbols[r, where + 1] < 0, NO_PIECE, rank), into
        counts = (done >= 0).sum(axis=1).tolist()
        return [row[:c] for row, c in zip(done.tolist(), counts, strict=True)]

    def _merge_long(self, text: str) -> list[int]:
        """One long chunk: the agenda as a heap over a linked list of symbols."""
        symbols, n, rank = list(text), len(text), self.ranks.get
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(r, i, pair) for i in range(n - 1) if (r := rank(pair := symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            j = after[i] if symbols[i] else n
            if j >= n or symbols[i] + symbols[j] != pair:
                continue  # one of the two was merged meanwhile
            symbols[i], symbols[j] = pair, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank(p := pair + symbols[k])) is not None:
                    heapq.heappush(agenda, (r, i, p))
            h = before[i]
            if h >= 0 and (r := rank(p := symbols[h] + pair)) is not None:
                heapq.heappush(agenda, (r, h, p))
        return [self.ids[s] if s in self.ids else self.size + ord(s) for s in symbols if s]


def chunks(text: str) -> list[str]:
    """The text's chunks without the U+2581 that each has at its start; '\\n...' has none, as nothing was before its line feed."""
    if not text:
        return []
    text = text.replace(SPACE, " ")
    if "  " in text or text[0] == " " or text[-1] == " " or " \n" in text or "\n " in text:
        out = []
        for part in _CHUNK.findall(" " + text):
            first, *rest = part.split("\n")
            out.append(first)
            out += ["\n" + x for x in rest]
        return out
    first, *rest = text.split("\n")
    out = first.split(" ")
    for line in rest:
        words = line.split(" ")
        words[0] = "\n" + words[0]
        out += words
    return out


class Encoder:
    """Ids of whole texts through a bounded table of chunks, each with its ids as text."""

    def __init__(self, path: str, cache: int = CACHE):
        self.vocabulary, self.limit = Vocabulary(path), cache
        self.known: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def learn(self, new: list[str]) -> None:
        ids = self.vocabulary.merge_all([c.replace(" ", SPACE) if c[:1] == "\n" else SPACE + c.replace(" ", SPACE) for c in new])
        self.known.update(zip(new, [" ".join(map(str, i)) for i in ids], strict=True))

    def encode(self, texts: list[str | None]) -> list[tuple[list[int], str]]:
        """(ids, ids as text) of each text."""
        if len(self.known) > self.limit:
            self.known, self.old = {}, self.known
        parts = [chunks(t or "") for t in texts]
        known, old = self.known, self.old
        missing = {c for p in parts for c in p if c not in known}
        known.update((c, old[c]) for c in missing if c in old)
        if new := [c for c in missing if c not in old]:
            self.learn(new)
        end = str(self.vocabulary.end)
        out = []
        for p in parts:
            said = " ".join([*map(known.__getitem__, p), end])
            out.append((np.fromstring(said, np.int64, sep=" ").tolist(), said))
        return out

    def checked(self, texts: list[str | None]) -> list[tuple[list[int], str, bool]]:
        """As encode(), the longest text also by the library; if it disagrees, so are all of them."""
        mine = self.encode(texts)
        longest = max(range(len(texts)), key=lambda i: (min(len(texts[i] or ""), CHECKED_CHARS), -i))
        library = self.vocabulary.library
        if library.encode(texts[longest] or "", add_eos=True) == mine[longest][0]:
            return [(*m, True) for m in mine]
        theirs = [library.encode(t or "", add_eos=True) for t in texts]
        return [(i, " ".join(map(str, i)), i == m[0]) for i, m in zip(theirs, mine, strict=True)]


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str | None = None, *, with_ids: bool = False) -> DataFrame:
    """docs (with text) -> the same rows with n_tokens, ids_sha256, decoded, batch_checked, and ids if asked for.

    Each whole text gets its pieces and the end id, no sampling; decoded is the library's
    decode(ids). batch_checked: the text of its batch that was compared had the library's ids, or this row did when all were compared. Null and empty texts have the end id alone and decode to the empty text.
    Rows are independent; a worker holds the vocabulary, one batch and a bounded table.
    """
    path = path or model_path()
    added = [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded", "string", pa.string()), ("batch_checked", "boolean", pa.bool_())]
    if with_ids:
        added.append(("ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32())))
    names = [c for c in docs.columns if c not in {a[0] for a in added}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        decode = encoder.vocabulary.library.decode
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                b = whole.slice(at, TOGETHER)
                cols: list[list] = [[] for _ in added]
                for ids, said, agreed in encoder.checked(b.column("text").to_pylist()):
                    row = (len(ids), hashlib.sha256(said.encode()).hexdigest(), decode(ids), agreed, ids)
                    for col, x in zip(cols, row, strict=False):
                        col.append(x)
                arrays = [pa.array(c, kind) for c, (_, _, kind) in zip(cols, added, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + arrays, names=names + [a[0] for a in added])

    schema = docs.select(*names).schema
    for name, kind, _ in added:
        schema = schema.add(name, kind)
    return small_batches(docs).mapInArrow(trimmed(run), schema)


def op10_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), "batch_checked")
